"""Queries over the transfer graph."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import TRIAL_RULES
from riskloom.operators import graph as g
from riskloom.plans import risk
from riskloom.plans.registry import oracle, query
from riskloom.sources.generated import PERIOD, Bank

SINCE = PERIOD.window_start
EDGES = """edges AS (SELECT sender_account_id AS source, receiver_account_id AS target, count(*) AS n, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_usd,
  min(ts) AS first_ts, max(ts) AS last_ts FROM txn WHERE status = 'completed' AND sender_account_id IS NOT NULL AND receiver_account_id IS NOT NULL GROUP BY 1, 2)"""
FLAGS = "flags AS (SELECT DISTINCT entity_id AS customer_id FROM alerts WHERE status = 'open')"
V = "CAST({} AS VARCHAR)"
PROJECTION = EDGES + """,
pe AS (
  SELECT concat('customer:', customer_id) AS source, concat('account:', account_id) AS target, 'OWNS' AS rel, 1 AS n FROM accounts
  UNION ALL SELECT concat('account:', source), concat('account:', target), 'TRANSFERRED_TO', n FROM edges
  UNION ALL SELECT concat('customer:', a.customer_id), concat('device:', device_id), 'USES_DEVICE', count(*) FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE t.status = 'completed' AND device_id IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT concat('customer:', a.customer_id), concat('ip:', ip_address), 'USES_IP', count(*) FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE t.status = 'completed' AND device_id IS NOT NULL AND ip_address IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT concat('account:', sender_account_id), concat('merchant:', merchant_id), 'PAID', count(*) FROM txn WHERE status = 'completed' AND merchant_id IS NOT NULL AND sender_account_id IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT DISTINCT concat('customer:', customer_id), concat(identifier_type, ':', substring(value_hash, 1, 16)), 'HAS_IDENTIFIER', 1 FROM identifiers),
pn AS (SELECT id, split_part(id, ':', 1) AS kind FROM (SELECT source AS id FROM pe UNION SELECT target FROM pe UNION SELECT concat('customer:', customer_id) FROM customers UNION SELECT concat('merchant:', merchant_id) FROM merchants) x),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM pe UNION ALL SELECT target FROM pe) x GROUP BY 1),
adj AS (SELECT DISTINCT id, nxt FROM (SELECT source AS id, target AS nxt FROM pe UNION ALL SELECT target, source FROM pe) x WHERE id <> nxt)"""
PVIEWS = "txn accounts customers merchants identifiers alerts"


def projected(b: Bank, staged: bool = True) -> tuple[DataFrame, DataFrame]:
    return g.projection(b.txn, b.customers, b.accounts, b.merchants, b.identifiers, b.alerts, staged)


@query("ag10_transfer_edges", oracle("txn", "SELECT e.source, e.target, e.n, e.total_usd, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us, s.ids FROM edges e JOIN (SELECT source, target, string_agg(CAST(transaction_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM (SELECT sender_account_id AS source, receiver_account_id AS target, transaction_id, row_number() OVER (PARTITION BY sender_account_id, receiver_account_id ORDER BY ts, transaction_id) AS rn FROM txn WHERE status = 'completed' AND sender_account_id IS NOT NULL AND receiver_account_id IS NOT NULL) x WHERE rn <= 5 GROUP BY 1, 2) s ON s.source = e.source AND s.target = e.target", EDGES))
def _(b):
    return g.transfer_edges(b.txn).select("source", "target", "n", "total_usd", F.unix_micros("first_ts").alias("first_us"),
                                          F.unix_micros("last_ts").alias("last_us"), F.array_join(F.col("sample_txn_ids").cast("array<string>"), ",").alias("ids"))


@query("ag11_usage_edges", oracle("txn accounts", """
SELECT 'device' AS kind, a.customer_id AS owner, CAST(device_id AS VARCHAR) AS item, count(*) AS n FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE t.status = 'completed' AND device_id IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'ip', a.customer_id, ip_address, count(*) FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE t.status = 'completed' AND device_id IS NOT NULL AND ip_address IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'merchant', sender_account_id, CAST(merchant_id AS VARCHAR), count(*) FROM txn WHERE status = 'completed' AND merchant_id IS NOT NULL AND sender_account_id IS NOT NULL GROUP BY 2, 3"""))
def _(b):
    device, ip, paid = g.usage_edges(b.txn, b.accounts)
    return (device.select(F.lit("device").alias("kind"), F.col("customer_id").alias("owner"), F.col("device_id").cast("string").alias("item"), "n")
            .union(ip.select(F.lit("ip"), "customer_id", "ip_address", "n"))
            .union(paid.select(F.lit("merchant"), "account_id", F.col("merchant_id").cast("string"), "n")))


@query("gr01_projection_edges", oracle(PVIEWS, "SELECT source, target, rel, n FROM pe", PROJECTION))
def _(b):
    return projected(b, staged=False)[1]


@query("gr01_projection_nodes", oracle(PVIEWS, "SELECT id, kind, EXISTS (SELECT 1 FROM flags f WHERE concat('customer:', f.customer_id) = pn.id) AS open_alert FROM pn", PROJECTION + ",\n" + FLAGS))
def _(b):
    return projected(b)[0]


@query("gr02_graph_stats", oracle(PVIEWS, "SELECT 'node' AS what, kind AS name, count(*) AS n FROM pn GROUP BY 2 UNION ALL SELECT 'edge', rel, count(*) FROM pe GROUP BY 2", PROJECTION))
def _(b):
    return g.graph_stats(*projected(b))


@query("gr03_related_entities", oracle(PVIEWS, """
SELECT seed, id, hops, reached > 150 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, id) AS rn, count(*) OVER (PARTITION BY seed) AS reached FROM (
  SELECT seed, id, min(hops) AS hops FROM (SELECT seed, seed AS id, 0 AS hops FROM seeds UNION ALL SELECT seed, id, 1 FROM l1
    UNION ALL SELECT l1.seed, a.nxt, 2 FROM l1 JOIN adj a ON a.id = l1.id WHERE l1.id NOT IN (SELECT id FROM hubs)) x GROUP BY 1, 2) y) z WHERE rn <= 150""",
  PROJECTION + """,
hubs AS (SELECT n.id FROM pn n JOIN deg d ON d.id = n.id WHERE kind IN ('merchant', 'ip') OR (degree > 60 AND kind <> 'customer')),
seeds AS (SELECT concat('customer:', customer_id) AS seed FROM customers), l1 AS (SELECT seed, nxt AS id FROM seeds JOIN adj ON adj.id = seed)"""))
def _(b):
    nodes, edges = projected(b)
    seeds = b.customers.select(g.node("customer", F.col("customer_id")).alias("seed"))
    return g.related(nodes, edges, seeds, 2, 150).withColumn("hops", F.col("hops").cast("long"))


@query("gr04_shared_devices", oracle("txn accounts", """
SELECT customer_id, device_id, n_customers FROM (SELECT *, count(*) OVER (PARTITION BY device_id) AS n_customers FROM (
  SELECT DISTINCT a.customer_id, device_id FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE t.status = 'completed' AND device_id IS NOT NULL) x) y WHERE n_customers >= 2"""))
def _(b):
    return g.shared_devices(g.usage_edges(b.txn, b.accounts)[0])


HOPS = 6
PATHS = EDGES + """,
le AS (SELECT source, target FROM edges WHERE source <> target),
pairs AS (SELECT DISTINCT sender_account_id AS source, receiver_account_id AS target FROM txn WHERE status = 'failed' AND sender_account_id IS NOT NULL AND receiver_account_id IS NOT NULL AND sender_account_id <> receiver_account_id),
q0 AS (SELECT DISTINCT source, source AS node, [source] AS path, 0 AS hops FROM pairs)""" + "".join(f""",
q{d} AS (SELECT * FROM q{d - 1} UNION ALL SELECT source, node, path, {d} FROM (SELECT q.source, e.target AS node, min(list_append(q.path, e.target)) AS path FROM q{d - 1} q JOIN le e ON e.source = q.node
  WHERE q.hops = {d - 1} GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM q{d - 1} s WHERE s.source = x.source AND s.node = x.node))""" for d in range(1, HOPS + 1))


@query("gr05_shortest_path", oracle("txn", f"SELECT p.source, p.target, array_to_string(path, '>') AS path, hops FROM pairs p JOIN q{HOPS} q ON q.source = p.source AND q.node = p.target WHERE hops > 0", PATHS))
def _(b):
    """Routes of money for every refused transfer's two accounts."""
    pairs = (b.txn.filter("status = 'failed' AND sender_account_id <> receiver_account_id")
             .select(F.col("sender_account_id").alias("source"), F.col("receiver_account_id").alias("target")).distinct())
    p = g.shortest_paths(g.transfer_edges(b.txn, 0), pairs, HOPS)
    return p.select("source", "target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.col("hops").cast("long").alias("hops"))


@query("gr06_connected_accounts", oracle("txn accounts", """
SELECT seed, account_id, hops, via, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, account_id) AS rank FROM (
  SELECT seed, account_id, arg_min(hops, p) AS hops, arg_min(via, p) AS via FROM (
    SELECT a.account_id AS seed, b.account_id, 0 AS hops, 'same_owner' AS via, 0 AS p FROM accounts a JOIN accounts b ON a.customer_id = b.customer_id AND a.account_id <> b.account_id
    UNION ALL SELECT s.account_id, b.account_id, 1, concat('shared_device:', CAST(min(d.device_id) AS VARCHAR)), 1 FROM accounts s JOIN du m ON m.customer_id = s.customer_id JOIN du d ON d.device_id = m.device_id AND d.customer_id <> s.customer_id
      JOIN accounts b ON b.customer_id = d.customer_id GROUP BY 1, 2
    UNION ALL SELECT seed, nxt, min(h), 'transfers', 1 + min(h) FROM (
      SELECT s.account_id AS seed, w.nxt, 1 AS h FROM accounts s JOIN wy w ON w.id = s.account_id
      UNION ALL SELECT s.account_id, v.nxt, 2 FROM accounts s JOIN wy w ON w.id = s.account_id JOIN wy v ON v.id = w.nxt) t WHERE nxt <> seed GROUP BY 1, 2) u GROUP BY 1, 2) x) y WHERE rank <= 100""",
  EDGES + """,
wy AS (SELECT DISTINCT id, nxt FROM (SELECT source AS id, target AS nxt FROM edges UNION ALL SELECT target, source FROM edges) x WHERE id <> nxt),
du AS (SELECT DISTINCT a.customer_id, device_id FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE t.status = 'completed' AND device_id IS NOT NULL)""").replace("'transfers', 1 + min(h)", "'transfers', 1.5 + min(h)"))
def _(b):
    c = g.connected_accounts(g.transfer_edges(b.txn, 0), b.accounts, g.usage_edges(b.txn, b.accounts)[0], b.accounts, 2, 100)
    return c.withColumn("hops", F.col("hops").cast("long"))




def cycles_of(length: int) -> str:
    """SQL of the simple cycles of `length` accounts over `le`, from their smallest account on."""
    names = ["e1.source", *[f"e{i}.target" for i in range(1, length)]]
    steps = "".join(f" JOIN le e{i} ON e{i}.source = e{i - 1}.target" + (f" AND e{i}.target > e1.source AND e{i}.target NOT IN ({', '.join(names[1:i])})" if i < length else " AND e1.source = e%d.target" % length)
                    for i in range(2, length + 1))
    return f"SELECT [{', '.join(names)}] AS cycle, {length} AS length FROM le e1{steps} WHERE e1.source < e1.target"


CANDIDATES = "le AS (SELECT source, target FROM edges WHERE last_ts >= {ws} AND source <> target),\ncand AS (" + "\nUNION ALL ".join(
    cycles_of(n) for n in range(2, TRIAL_RULES.cycle_length + 1)) + ")"


@query("gr07_candidate_cycles", oracle("txn", "SELECT array_to_string(cycle, '>') AS cycle, length FROM cand", EDGES + "," + CANDIDATES))
def _(b):
    c = g.candidate_cycles(g.transfer_edges(b.txn, 0), TRIAL_RULES.cycle_length, SINCE)
    return c.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), F.col("length").cast("long").alias("length"))


@query("gr17_cycle_listing", oracle("txn", """
SELECT array_to_string(c.cycle, '>') AS cycle, length, b.cycle IS NOT NULL AS time_ordered, u0 AS start_usd FROM cand c LEFT JOIN best b ON b.cycle = c.cycle""",
    EDGES + "," + CANDIDATES + "," + risk.CYCLES))
def _(b):
    c = g.listed_cycles(g.transfer_edges(b.txn, 0), b.txn, b.period.window_start, b.period.end, TRIAL_RULES)
    return c.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), F.col("length").cast("long").alias("length"), "time_ordered", "start_usd")


@query("gr08_trace_funds", oracle("txn accounts", """
SELECT seed, array_to_string(path, '>') AS path, hops, min_usd, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops DESC, min_usd DESC, path) AS rank FROM (
  SELECT path[1] AS seed, path, hops, min_usd FROM f1 UNION ALL SELECT path[1], path, hops, min_usd FROM f2 UNION ALL SELECT path[1], path, hops, min_usd FROM f3) x) y WHERE rank <= 50""",
  EDGES + f""",
le AS (SELECT * FROM edges WHERE last_ts >= TIMESTAMP '{SINCE}'),
f1 AS (SELECT [source, target] AS path, target AS node, 1 AS hops, total_usd AS min_usd, first_ts FROM le JOIN accounts ON account_id = source WHERE source <> target),
f2 AS (SELECT list_append(path, target) AS path, target AS node, 2 AS hops, least(min_usd, total_usd) AS min_usd, e.first_ts FROM f1 JOIN le e ON e.source = node WHERE NOT list_contains(path, target) AND e.last_ts >= f1.first_ts),
f3 AS (SELECT list_append(path, target) AS path, target AS node, 3 AS hops, least(min_usd, total_usd) AS min_usd, e.first_ts FROM f2 JOIN le e ON e.source = node WHERE NOT list_contains(path, target) AND e.last_ts >= f2.first_ts)"""))
def _(b):
    t = g.trace_funds(g.transfer_edges(b.txn, 0), b.accounts, "out", 3, SINCE, 50)
    return t.select("seed", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.col("hops").cast("long").alias("hops"), "min_usd", "rank")


def clusters(b: Bank):
    nodes, edges = projected(b)
    return g.suspicious_clusters(nodes, edges, g.open_alert_customers(b.alerts).join(b.customers, "customer_id", "left_semi"))


CLUSTER = PROJECTION + ",\n" + FLAGS + """,
big AS (SELECT id FROM deg WHERE degree > 60),
kept AS (SELECT id, nxt FROM adj WHERE split_part(nxt, ':', 1) IN ('customer', 'account', 'device', 'phone', 'email', 'address')),
seeds AS (SELECT concat('customer:', customer_id) AS seed FROM flags),
c0 AS (SELECT seed, seed AS id, 0 AS hops FROM seeds)""" + "".join(f""",
c{d} AS (SELECT * FROM c{d - 1} UNION ALL SELECT DISTINCT c.seed, k.nxt, {d} FROM c{d - 1} c JOIN kept k ON k.id = c.id WHERE c.hops = {d - 1} {"AND c.id NOT IN (SELECT id FROM big)" if d > 1 else ""}
  AND NOT EXISTS (SELECT 1 FROM c{d - 1} s WHERE s.seed = c.seed AND s.id = k.nxt))""" for d in range(1, 5)) + """,
members AS (SELECT seed, id FROM c4),
und AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM pe WHERE source <> target),
inn AS (SELECT m.seed, u.a, u.b FROM und u JOIN members m ON m.id = u.a JOIN members k ON k.seed = m.seed AND k.id = u.b),
summary AS (SELECT m.seed, count(*) AS size, count(*) FILTER (id LIKE 'customer:%') AS customers, count(*) FILTER (id LIKE 'account:%') AS accounts, count(*) FILTER (id LIKE 'device:%') AS devices,
  count(*) FILTER (id IN (SELECT concat('customer:', customer_id) FROM flags)) AS flagged FROM members m GROUP BY 1)"""


@query("gr09_suspicious_cluster", oracle(PVIEWS, """
SELECT s.*, CASE WHEN size > 1 THEN round(2.0 * coalesce(m, 0) / (size * (size - 1)), 4) ELSE 0 END AS density FROM summary s LEFT JOIN (SELECT seed, count(*) AS m FROM inn GROUP BY 1) e ON e.seed = s.seed""", CLUSTER))
def _(b):
    return clusters(b)[2]


@query("gr09_degree_centrality", oracle(PVIEWS, """
SELECT seed, id, centrality, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY centrality DESC, id) AS rank FROM (
  SELECT m.seed, m.id, round(coalesce(d, 0) / (size - 1), 4) AS centrality FROM members m JOIN summary s ON s.seed = m.seed AND size > 1
  LEFT JOIN (SELECT seed, id, count(*) AS d FROM (SELECT seed, a AS id FROM inn UNION ALL SELECT seed, b FROM inn) x GROUP BY 1, 2) e ON e.seed = m.seed AND e.id = m.id) y) z WHERE rank <= 5""", CLUSTER))
def _(b):
    members, inner, _ = clusters(b)
    return g.degree_centrality(members, inner)


@query("gr09_betweenness")
def _(b):
    _, inner, summary = clusters(b)
    return g.betweenness(inner, summary, limit=None)


COUNTER = "SELECT DISTINCT customer_id, other FROM (SELECT a.customer_id, e.target AS other FROM edges e JOIN accounts a ON a.account_id = e.source WHERE last_ts >= {ws} UNION ALL SELECT a.customer_id, e.source FROM edges e JOIN accounts a ON a.account_id = e.target WHERE last_ts >= {ws}) x WHERE NOT EXISTS (SELECT 1 FROM accounts o WHERE o.account_id = x.other AND o.customer_id = x.customer_id)"


@query("gr10_counterparties", oracle("txn accounts", COUNTER, EDGES))
def _(b):
    return g.counterparties(g.transfer_edges(b.txn, 0), b.accounts, b.period.window_start)


TWO = EDGES + """,
le AS (SELECT source, target, n, total_usd FROM edges WHERE last_ts >= {ws}),
touch AS (SELECT source AS account_id, target AS other, 'out' AS direction, n, total_usd FROM le UNION ALL SELECT target, source, 'in', n, total_usd FROM le),
first AS (SELECT customer_id, other AS account_id, 1 AS degree, CASE WHEN count(DISTINCT direction) = 2 THEN 'both' ELSE min(direction) END AS direction, sum(n) AS n, round(sum(total_usd), 2) AS total_usd, NULL::BIGINT AS via_account
  FROM touch JOIN accounts a USING (account_id) WHERE NOT EXISTS (SELECT 1 FROM accounts o WHERE o.account_id = other AND o.customer_id = a.customer_id) GROUP BY 1, 2),
hubs AS (SELECT account_id FROM (SELECT source AS account_id FROM le UNION ALL SELECT target FROM le) x GROUP BY 1 HAVING count(*) > 60),
second AS (SELECT customer_id, account_id, 2 AS degree, direction, n, total_usd, via_account FROM (
  SELECT f.customer_id, t.other AS account_id, t.direction, t.n, t.total_usd, f.account_id AS via_account, row_number() OVER (PARTITION BY f.customer_id, t.other ORDER BY f.account_id, t.direction DESC) AS rn
  FROM first f JOIN touch t ON t.account_id = f.account_id WHERE f.account_id NOT IN (SELECT account_id FROM hubs)
    AND NOT EXISTS (SELECT 1 FROM accounts o WHERE o.account_id = t.other AND o.customer_id = f.customer_id) AND NOT EXISTS (SELECT 1 FROM first p WHERE p.customer_id = f.customer_id AND p.account_id = t.other)) x WHERE rn = 1)"""


@query("gr11_customer_counterparties", oracle("txn accounts", "SELECT customer_id, account_id, degree, direction, CAST(n AS BIGINT) AS n, total_usd, via_account FROM first UNION ALL SELECT customer_id, account_id, degree, direction, n, total_usd, via_account FROM second", TWO))
def _(b):
    edges = g.transfer_edges(b.txn, 0)
    hubs = g.degrees(g.live(edges, SINCE)).filter(F.col("degree") > g.HUB_DEGREE).select(F.col("id").alias("account_id"))
    return g.customer_counterparties(edges, b.accounts, 2, SINCE, hubs).withColumn("degree", F.col("degree").cast("long"))


@query("gr12_shared_beneficiaries", oracle("txn accounts", """
SELECT a.customer_id, e.source AS paid_from, e.target AS beneficiary_account, o.customer_id AS beneficiary_owner, count(DISTINCT p.customer_id) AS n_other_customers
FROM edges e JOIN accounts a ON a.account_id = e.source LEFT JOIN accounts o ON o.account_id = e.target JOIN edges x ON x.target = e.target JOIN accounts p ON p.account_id = x.source AND p.customer_id <> a.customer_id
WHERE e.last_ts >= {ws} AND x.last_ts >= {ws} AND o.customer_id IS DISTINCT FROM a.customer_id GROUP BY 1, 2, 3, 4""", EDGES))
def _(b):
    return g.shared_beneficiaries(g.transfer_edges(b.txn, 0), b.accounts, b.period.window_start)


COMMON_SQL = """SELECT {g} e.target AS account_id, o.customer_id AS owner_customer_id, count(DISTINCT e.source) AS n_sources, round(sum(e.total_usd), 2) AS total_usd, sum(e.n) AS n_transactions
FROM edges e JOIN src s ON s.account_id = e.source LEFT JOIN accounts o ON o.account_id = e.target WHERE NOT EXISTS (SELECT 1 FROM src x WHERE x.account_id = e.target {w}) GROUP BY ALL HAVING count(DISTINCT e.source) >= 2"""


@query("gr13_common_recipients", oracle("txn accounts alerts", COMMON_SQL.format(g="", w=""), EDGES + "," + FLAGS + ", src AS (SELECT account_id FROM accounts JOIN flags USING (customer_id))"))
def _(b):
    """Accounts paid by several accounts of customers with an open alert."""
    src = b.accounts.join(g.open_alert_customers(b.alerts), "customer_id", "left_semi")
    return g.common_recipients(g.transfer_edges(b.txn, 0), b.accounts, src)


@query("gr14_flagged_recipients", oracle(PVIEWS, COMMON_SQL.format(g="s.seed,", w="AND x.seed = s.seed"), CLUSTER + """,
src AS (SELECT DISTINCT seed, a.account_id FROM (SELECT seed, id FROM members WHERE id IN (SELECT concat('customer:', customer_id) FROM flags) UNION SELECT seed, seed FROM seeds) m JOIN accounts a ON concat('customer:', a.customer_id) = m.id)"""))
def _(b):
    members = clusters(b)[0]
    flagged = members.filter("open_alert AND kind = 'customer' OR id = seed").select("seed", "id").distinct()
    src = flagged.join(b.accounts.select(g.node("customer", F.col("customer_id")).alias("id"), "account_id"), "id").select("seed", "account_id")
    return g.common_recipients(g.transfer_edges(b.txn, 0), b.accounts, src, 2, None, "seed")


@query("gr15_fan_patterns", oracle("txn accounts alerts", """
SELECT x.account_id, a.customer_id AS owner_customer_id, CASE WHEN s >= 5 AND r >= 5 THEN 'fan_in+fan_out' WHEN s >= 5 THEN 'fan_in' ELSE 'fan_out' END AS pattern, s AS distinct_senders, r AS distinct_receivers, in_usd, out_usd,
  a.customer_id IN (SELECT customer_id FROM flags) AS flagged FROM (
  SELECT coalesce(i.account_id, o.account_id) AS account_id, coalesce(s, 0) AS s, coalesce(r, 0) AS r, coalesce(in_usd, 0) AS in_usd, coalesce(out_usd, 0) AS out_usd FROM
    (SELECT target AS account_id, count(*) AS s, CAST(sum(CAST(total_usd AS DECIMAL(18,2))) AS DOUBLE) AS in_usd FROM edges WHERE last_ts >= {ws} GROUP BY 1) i
    FULL JOIN (SELECT source AS account_id, count(*) AS r, CAST(sum(CAST(total_usd AS DECIMAL(18,2))) AS DOUBLE) AS out_usd FROM edges WHERE last_ts >= {ws} GROUP BY 1) o ON o.account_id = i.account_id) x
LEFT JOIN accounts a ON a.account_id = x.account_id WHERE s >= 5 OR r >= 5""", EDGES + "," + FLAGS))
def _(b):
    return g.fan_patterns(g.transfer_edges(b.txn, 0), b.accounts, b.alerts, b.period.window_start)


FLOW = EDGES + "," + FLAGS + f""",
le AS (SELECT source, target, n, total_usd FROM edges WHERE last_ts >= TIMESTAMP '{SINCE}'),
tw AS (SELECT source AS id, target AS nxt, 'downstream' AS role, source, target FROM le UNION ALL SELECT target, source, 'upstream', source, target FROM le),
hubs AS (SELECT id FROM tw GROUP BY 1 HAVING count(*) > 60),
s0 AS (SELECT customer_id AS seed, account_id AS id, 0 AS depth, 'subject' AS roles FROM accounts),
s1 AS (SELECT seed, nxt AS id, 1 AS depth, string_agg(DISTINCT role, '+' ORDER BY role) AS roles FROM s0 JOIN tw USING (id) WHERE NOT EXISTS (SELECT 1 FROM s0 z WHERE z.seed = s0.seed AND z.id = nxt) GROUP BY 1, 2),
s2 AS (SELECT seed, nxt AS id, 2 AS depth, string_agg(DISTINCT role, '+' ORDER BY role) AS roles FROM s1 JOIN tw USING (id) WHERE s1.id NOT IN (SELECT id FROM hubs)
  AND NOT EXISTS (SELECT 1 FROM s0 z WHERE z.seed = s1.seed AND z.id = nxt) AND NOT EXISTS (SELECT 1 FROM s1 z WHERE z.seed = s1.seed AND z.id = nxt) GROUP BY 1, 2),
al AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS rn, count(*) OVER (PARTITION BY seed) > 60 AS truncated FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) x),
nodes AS (SELECT seed, id, depth, roles, truncated FROM al WHERE rn <= 60)"""


@query("gr16_flow_nodes", oracle("txn accounts alerts", """
SELECT n.seed, n.id AS account_id, n.depth, n.roles, n.truncated, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, a.customer_id AS owner_customer_id, a.customer_id IN (SELECT customer_id FROM flags) AS flagged, n.id IN (SELECT id FROM hubs) AS is_hub
FROM nodes n LEFT JOIN accounts a ON a.account_id = n.id LEFT JOIN (SELECT target, count(*) AS c FROM le GROUP BY 1) i ON i.target = n.id LEFT JOIN (SELECT source, count(*) AS c FROM le GROUP BY 1) o ON o.source = n.id""", FLOW))
def _(b):
    return g.flow_subgraph(g.transfer_edges(b.txn, 0), b.accounts, b.alerts, b.customers, 2, SINCE)[0].withColumn("depth", F.col("depth").cast("long"))


@query("gr16_flow_edges", oracle("txn accounts alerts", """
SELECT seed, source, target, depth, n, total_usd, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, total_usd DESC, source, target) AS rank FROM (
  SELECT x.seed, x.source, x.target, min(x.depth) AS depth, any_value(l.n) AS n, any_value(l.total_usd) AS total_usd FROM (
    SELECT seed, source, target, 1 AS depth FROM s0 JOIN tw USING (id) UNION ALL SELECT seed, source, target, 2 FROM s1 JOIN tw USING (id) WHERE s1.id NOT IN (SELECT id FROM hubs)) x
  JOIN le l ON l.source = x.source AND l.target = x.target JOIN nodes p ON p.seed = x.seed AND p.id = x.source JOIN nodes q ON q.seed = x.seed AND q.id = x.target GROUP BY 1, 2, 3) y) z WHERE rank <= 250""", FLOW))
def _(b):
    e = g.flow_subgraph(g.transfer_edges(b.txn, 0), b.accounts, b.alerts, b.customers, 2, SINCE)[1]
    return e.select("seed", "source", "target", F.col("depth").cast("long").alias("depth"), "n", "total_usd", "rank")


@query("gr18_account_owner_flags", oracle("accounts alerts", "SELECT account_id, customer_id, customer_id IN (SELECT customer_id FROM flags) AS flagged FROM accounts", FLAGS))
def _(b):
    return g.account_owners(b.accounts, b.alerts)


@query("gr19_relation_degrees", oracle(PVIEWS, "SELECT id, rel, count(*) AS degree FROM (SELECT source AS id, rel FROM pe UNION ALL SELECT target, rel FROM pe WHERE source <> target) x GROUP BY 1, 2", PROJECTION))
def _(b):
    return g.relation_degrees(projected(b, staged=False)[1])

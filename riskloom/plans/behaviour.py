"""Queries over transactions: scans, lookups, joins, statistics and windows."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.numeric import money_sum, rnd, top_k
from riskloom.operators import orient as ori
from riskloom.operators import profile as prof
from riskloom.operators.detectors import identifier_groups
from riskloom.operators.quantiles import exact_quantiles, value_counts
from riskloom.operators.windows import rolling, rolling_band, rolling_max, with_previous
from riskloom.plans.registry import oracle, query
from riskloom.sources import dataset
from riskloom.sources.generated import Bank


def legs(b: Bank, grain: str = "customer") -> DataFrame:
    return ori.legs_for(b.txn, b.accounts, b.period, grain)


# -------------------------------------------------------------------------------------------- projections, filters
@query("p01_orient", oracle("legs", """
SELECT entity_id, direction, period, count(*) AS n, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS usd,
  sum(transaction_id) AS id_sum FROM legs GROUP BY ALL"""))
def _(b):
    return legs(b).groupBy("entity_id", "direction", "period").agg(
        F.count(F.lit(1)).alias("n"), money_sum(F.col("amount_usd")).alias("usd"), F.sum("transaction_id").alias("id_sum"))


@query("p02_time_window", oracle("txn", """
SELECT transaction_id, amount_usd FROM txn WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'"""))
def _(b):
    return b.txn.filter(ori.between("ts", datetime(2024, 1, 10), datetime(2024, 1, 12, 12))).select("transaction_id", "amount_usd")


@query("p03_period_split", oracle("txn", """
SELECT CASE WHEN ts < {ws} THEN 'base' ELSE 'win' END AS period, count(*) AS n FROM txn WHERE ts >= {bs} AND ts <= {we} GROUP BY 1"""))
def _(b):
    rows = b.txn.filter(ori.between("ts", b.period.baseline_start, b.period.end))
    return rows.groupBy(ori.split_period("ts", b.period).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("p04_account_transactions", oracle("txn accounts customers", """
SELECT t.transaction_id, t.amount_usd FROM txn t WHERE ts >= {ws} AND ts <= {we} AND (
  t.sender_account_id IN (SELECT account_id FROM accounts a JOIN customers c USING (customer_id) WHERE c.segment = 'HOUSEHOLD')
  OR t.receiver_account_id IN (SELECT account_id FROM accounts a JOIN customers c USING (customer_id) WHERE c.segment = 'HOUSEHOLD'))"""))
def _(b):
    chosen = b.accounts.join(b.customers.filter("segment = 'HOUSEHOLD'").select("customer_id"), "customer_id", "left_semi")
    return ori.for_accounts(b.txn, chosen, b.period.window_start, b.period.end).select("transaction_id", "amount_usd")


@query("p05_device_transactions", oracle("txn", """
SELECT transaction_id, epoch_us(ts) // 1000000 AS sec FROM txn WHERE device_id = 7 ORDER BY ts, transaction_id LIMIT 40"""))
def _(b):
    return ori.device_history(b.txn, 7, 40).select("transaction_id", F.unix_seconds("ts").alias("sec"))


@query("p06_latest_transactions", oracle("legs", """
SELECT entity_id, transaction_id, rank, total, total > 5 AS truncated FROM (
  SELECT entity_id, transaction_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, transaction_id DESC) AS rank,
    count(*) OVER (PARTITION BY entity_id) AS total FROM legs) x WHERE rank <= 5"""))
def _(b):
    return ori.latest_per_customer(legs(b), 5).select("entity_id", "transaction_id", "rank", "total", "truncated")


@query("p07_point_lookups", oracle("customers accounts merchants devices investigations txn", """
SELECT 'customer' AS kind, CAST(customer_id AS VARCHAR) AS id, segment AS detail FROM customers WHERE customer_id = 12
UNION ALL SELECT 'account', CAST(account_id AS VARCHAR), status FROM accounts WHERE account_id = 12
UNION ALL SELECT 'transaction', CAST(transaction_id AS VARCHAR), status FROM txn WHERE transaction_id = 12
UNION ALL SELECT 'merchant', CAST(merchant_id AS VARCHAR), risk_profile FROM merchants WHERE merchant_id = 2
UNION ALL SELECT 'device', CAST(device_id AS VARCHAR), device_type FROM devices WHERE device_id = 12
UNION ALL SELECT 'investigation', CAST(investigation_id AS VARCHAR), status FROM investigations WHERE investigation_id = 14"""))
def _(b):
    def one(df, kind, key, value, detail):
        return df.filter(F.col(key) == value).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"),
                                                     F.col(detail).alias("detail"))
    return (one(b.customers, "customer", "customer_id", 12, "segment")
            .union(one(b.accounts, "account", "account_id", 12, "status"))
            .union(one(b.txn, "transaction", "transaction_id", 12, "status"))
            .union(one(b.merchants, "merchant", "merchant_id", 2, "risk_profile"))
            .union(one(b.devices, "device", "device_id", 12, "device_type"))
            .union(one(b.investigations, "investigation", "investigation_id", 14, "status")))


@query("p08_entity_search", oracle("customers accounts merchants devices", """
SELECT branch, entity_type, entity_id FROM (
  SELECT * FROM (SELECT 1 AS branch, 'customer' AS entity_type, CAST(customer_id AS VARCHAR) AS entity_id FROM customers WHERE CAST(customer_id AS VARCHAR) LIKE '12%' ORDER BY 3 LIMIT 15)
  UNION ALL SELECT * FROM (SELECT 2, 'account', CAST(account_id AS VARCHAR) AS i FROM accounts WHERE CAST(account_id AS VARCHAR) LIKE '12%' ORDER BY i LIMIT 15)
  UNION ALL SELECT * FROM (SELECT 3, 'device', CAST(device_id AS VARCHAR) AS i FROM devices WHERE CAST(device_id AS VARCHAR) LIKE '12%' ORDER BY i LIMIT 15)
  UNION ALL SELECT * FROM (SELECT 4, 'merchant', CAST(merchant_id AS VARCHAR) AS i FROM merchants WHERE CAST(merchant_id AS VARCHAR) LIKE '12%' ORDER BY i LIMIT 15)) x
ORDER BY branch, entity_id LIMIT 15"""))
def _(b):
    return ori.search_entities("12", 15, b.customers, b.accounts, b.devices, b.merchants, b.txn).withColumn(
        "branch", F.col("branch").cast("long"))


@query("p11_known_ids", oracle("txn merchants accounts", """
SELECT 'merchant' AS kind, x.id, m.merchant_id IS NOT NULL AS known, m.risk_profile AS detail
FROM (SELECT DISTINCT merchant_id AS id FROM txn WHERE merchant_id IS NOT NULL) x LEFT JOIN merchants m ON m.merchant_id = x.id
UNION ALL SELECT 'account', x.id, a.account_id IS NOT NULL, a.status
FROM (SELECT DISTINCT receiver_account_id AS id FROM txn WHERE receiver_account_id IS NOT NULL) x LEFT JOIN accounts a ON a.account_id = x.id"""))
def _(b):
    m = ori.known_ids(b.txn, b.merchants, "merchant_id", "merchant_id", ("risk_profile",))
    a = ori.known_ids(b.txn, b.accounts, "receiver_account_id", "account_id", ("status",))
    return (m.select(F.lit("merchant").alias("kind"), "id", "known", F.col("risk_profile").alias("detail"))
            .union(a.select(F.lit("account"), "id", "known", F.col("status"))))


@query("p12_active_customers", oracle("txn accounts", """
SELECT DISTINCT a.customer_id FROM accounts a JOIN (
  SELECT sender_account_id AS id FROM txn WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND ts <= {we}
  UNION SELECT receiver_account_id FROM txn WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND ts <= {we}) t ON t.id = a.account_id"""))
def _(b):
    return ori.active_customers(b.txn, b.accounts, b.period.end - timedelta(days=1), b.period.end)


# ------------------------------------------------------------------------------------------------------------ joins
@query("j01_account_owner", oracle("txn accounts", """
SELECT t.transaction_id, a.customer_id FROM txn t LEFT JOIN accounts a ON a.account_id = t.sender_account_id"""))
def _(b):
    from riskloom.functions.numeric import join_optional
    own = b.accounts.select(F.col("account_id").alias("__acc"), "customer_id")
    return join_optional(b.txn, own, "sender_account_id", "__acc", "transaction_id").select("transaction_id", "customer_id")


@query("j02_shared_identifiers", oracle("identifiers", """
SELECT a.customer_id, a.identifier_type, count(DISTINCT b.customer_id) + 1 AS customers
FROM identifiers a JOIN identifiers b ON a.identifier_type = b.identifier_type AND a.value_hash = b.value_hash AND a.customer_id <> b.customer_id
GROUP BY 1, 2"""))
def _(b):
    return identifier_groups(b.identifiers).select("customer_id", "identifier_type", "customers")


@query("j03_device_users", oracle("txn accounts", """
SELECT t.device_id, a.customer_id, count(*) AS n_transactions, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE device_id IS NOT NULL AND ts >= {bs} AND ts <= {we} GROUP BY 1, 2"""))
def _(b):
    return ori.device_users(b.txn, b.accounts, b.period.baseline_start, b.period.end).select(
        "device_id", "customer_id", "n_transactions", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("j04_high_risk_payments", oracle("legs merchants", """
SELECT l.entity_id, l.transaction_id, l.amount_usd FROM legs l JOIN merchants m ON m.merchant_id = l.merchant_id
WHERE m.risk_profile = 'high' AND direction = 'out' AND status = 'completed'"""))
def _(b):
    from riskloom.operators.detectors import high_risk_payments
    from riskloom.plans.risk import frames
    return high_risk_payments(frames(b)).select("entity_id", "transaction_id", "amount_usd")


@query("j08_orphans", oracle("txn accounts merchants devices customers", """
SELECT 'account' AS kind, count(*) AS n FROM txn t WHERE receiver_account_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = t.receiver_account_id)
UNION ALL SELECT 'merchant', count(*) FROM txn t WHERE merchant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM merchants a WHERE a.merchant_id = t.merchant_id)
UNION ALL SELECT 'device', count(*) FROM txn t WHERE device_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM devices a WHERE a.device_id = t.device_id)
UNION ALL SELECT 'owner', count(*) FROM accounts t WHERE NOT EXISTS (SELECT 1 FROM customers a WHERE a.customer_id = t.customer_id)"""))
def _(b):
    def orphans(kind, rows, column, reference, key):
        ids = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("c"))
        gone = ids.join(reference.select(F.col(key).alias("id")), "id", "left_anti")
        return gone.agg(F.lit(kind).alias("kind"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return (orphans("account", b.txn, "receiver_account_id", b.accounts, "account_id")
            .union(orphans("merchant", b.txn, "merchant_id", b.merchants, "merchant_id"))
            .union(orphans("device", b.txn, "device_id", b.devices, "device_id"))
            .union(orphans("owner", b.accounts, "customer_id", b.customers, "customer_id")))


# ----------------------------------------------------------------------------------------- aggregations, statistics
AMOUNT_SQL = """
SELECT x.entity_id, x.period, n, median, mad_sigma, p95, p99, max, mean, total_usd FROM (
  SELECT entity_id, period, count(*) AS n, floor(quantile_cont(amount_usd, 0.5) * 100 + 0.5) / 100 AS median,
    floor(quantile_cont(amount_usd, 0.95) * 100 + 0.5) / 100 AS p95, floor(quantile_cont(amount_usd, 0.99) * 100 + 0.5) / 100 AS p99,
    floor(max(amount_usd) * 100 + 0.5) / 100 AS max,
    floor(CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS mean,
    floor(CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) * 100 + 0.5) / 100 AS total_usd
  FROM legs WHERE direction = 'out' AND status = 'completed' GROUP BY 1, 2) x
JOIN (SELECT l.entity_id, l.period, floor(quantile_cont(abs(amount_usd - m), 0.5) * 1.4826 * 100 + 0.5) / 100 AS mad_sigma
  FROM legs l JOIN (SELECT entity_id, period, quantile_cont(amount_usd, 0.5) AS m FROM legs WHERE direction = 'out' AND status = 'completed' GROUP BY 1, 2) c
    ON c.entity_id = l.entity_id AND c.period = l.period
  WHERE direction = 'out' AND status = 'completed' GROUP BY 1, 2) y ON y.entity_id = x.entity_id AND y.period = x.period"""


@query("ag02_amount_stats", oracle("legs", AMOUNT_SQL))
def _(b):
    return prof.amount_stats(legs(b).filter(prof.is_out() & prof.done()), prof.KEYS)


DAILY_SQL = """
SELECT entity_id, period, floor(s1 / d * 1000 + 0.5) / 1000 AS daily_mean,
  floor(sqrt((d * s2 - s1 * s1) / (d * d)) * 1000 + 0.5) / 1000 AS daily_std, daily_max
FROM (SELECT entity_id, period, CAST(sum(c) AS DOUBLE) AS s1, CAST(sum(c * c) AS DOUBLE) AS s2, max(c) AS daily_max,
        CASE WHEN period = 'base' THEN 21.0 ELSE 11.0 END::DOUBLE AS d
      FROM (SELECT entity_id, period, CAST(ts AS DATE) AS day, count(*) AS c FROM legs WHERE direction = 'out' GROUP BY 1, 2, 3) q GROUP BY 1, 2) z"""


@query("ag03_daily_counts", oracle("legs", DAILY_SQL))
def _(b):
    return prof.daily_stats(legs(b).filter(prof.is_out()), b.period)


ROLL_SQL = """
SELECT entity_id, period, max_count, min(sec) AS start_sec FROM (
  SELECT *, max(c) OVER (PARTITION BY entity_id, period) AS max_count FROM (
    SELECT entity_id, period, sec, count(*) OVER (PARTITION BY entity_id, period ORDER BY sec RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING) AS c
    FROM legs WHERE direction = 'out') a) z WHERE c = max_count GROUP BY 1, 2, 3"""


@query("ag04_rolling_max", oracle("legs", ROLL_SQL))
def _(b):
    return rolling_max(legs(b).filter(prof.is_out()), prof.KEYS, 3600)


@query("ag05_rolling_band", oracle("legs", """
SELECT entity_id, period, c AS max_count, CAST(s AS DOUBLE) AS total_usd, sec AS start_sec FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, period ORDER BY c DESC, s DESC, sec DESC) AS rn FROM (
    SELECT entity_id, period, sec, count(*) OVER w AS c, sum(CAST(amount_usd AS DECIMAL(18,2))) OVER w AS s FROM legs
    WHERE direction = 'out' AND status = 'completed'
    WINDOW w AS (PARTITION BY entity_id, period ORDER BY sec RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING)) a) z WHERE rn = 1"""))
def _(b):
    return rolling_band(legs(b).filter(prof.is_out() & prof.done()), prof.KEYS, 86400, "amount_usd")


@query("ag06_mix", oracle("legs", """
SELECT entity_id, period, concat(transaction_type, '|', channel) AS key, count(*) AS n,
  round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY entity_id, period), 9) AS share
FROM legs WHERE direction = 'out' GROUP BY 1, 2, 3"""))
def _(b):
    return prof.mix(legs(b), ["transaction_type", "channel"]).withColumn("share", F.round("share", 9))


@query("ag07_counterparties", oracle("legs", """
SELECT entity_id, period, 'in' AS side, count(DISTINCT coalesce(CAST(other_account AS VARCHAR), external_counterparty, 'UNKNOWN')) AS n
FROM legs WHERE direction = 'in' GROUP BY 1, 2
UNION ALL SELECT entity_id, period, 'out', count(DISTINCT coalesce(CAST(other_account AS VARCHAR), external_counterparty))
FROM legs WHERE direction = 'out' AND status = 'completed' AND transaction_type = 'transfer' GROUP BY 1, 2"""))
def _(b):
    rows = legs(b)
    return (prof.distinct_counterparties(rows, "in").select("entity_id", "period", F.lit("in").alias("side"), "n")
            .union(prof.distinct_counterparties(rows, "out").select("entity_id", "period", F.lit("out"), "n")))


JSD_SQL = """
SELECT entity_id, na AS n_base, nb AS n_win, greatest(0.0, least(1.0, sum(p * log2(p / ((p + q) / 2)) / 2 + q * log2(q / ((p + q) / 2)) / 2))) AS jsd FROM (
  SELECT entity_id, na, nb, (a / na + 1e-12) / (1.0 + k * 1e-12) AS p, (b / nb + 1e-12) / (1.0 + k * 1e-12) AS q FROM (
    SELECT entity_id, key, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, sum(a) OVER w AS na, sum(b) OVER w AS nb, count(*) OVER w AS k FROM (
      SELECT entity_id, concat(transaction_type, '|', channel) AS key, count(*) FILTER (period = 'base') AS a, count(*) FILTER (period = 'win') AS b
      FROM legs WHERE direction = 'out' GROUP BY 1, 2) c WINDOW w AS (PARTITION BY entity_id)) d WHERE na > 0 AND nb > 0) e GROUP BY 1, 2, 3"""


@query("ag08_mix_divergence", oracle("legs", f"SELECT entity_id, CAST(n_base AS BIGINT) AS n_base, CAST(n_win AS BIGINT) AS n_win, round(jsd, 6) AS jsd FROM ({JSD_SQL}) j"))
def _(b):
    return prof.mix_divergence(prof.mix_counts(legs(b), ["transaction_type", "channel"])).withColumn("jsd", F.round("jsd", 6))


PEER_SQL = """
SELECT segment, count(*) AS n, quantile_cont(amount_usd, 0.5) AS p50_usd, quantile_cont(amount_usd, 0.95) AS p95_usd, quantile_cont(amount_usd, 0.99) AS p99_usd
FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id JOIN customers c ON c.customer_id = a.customer_id
WHERE ts >= {bs} AND ts < {ws} AND t.status = 'completed' GROUP BY 1"""


@query("ag09_peer_percentiles", oracle("txn accounts customers", f"""
SELECT segment, n, round(p50_usd, 6) AS p50_usd, round(p95_usd, 6) AS p95_usd, round(p99_usd, 6) AS p99_usd FROM ({PEER_SQL}) x"""))
def _(b):
    p = prof.peer_amounts(b.txn, b.accounts, b.customers, b.period.baseline_start, b.period.window_start)
    return p.select("segment", "n", *[F.round(c, 6).alias(c) for c in ("p50_usd", "p95_usd", "p99_usd")])


@query("ag01_period_stats", oracle("legs", f"""
SELECT b.*, coalesce(a.n, 0) AS out_n, a.median AS out_median, a.p99 AS out_p99, coalesce(d.daily_max, 0) AS daily_max,
  coalesce(d.daily_mean, 0) AS daily_mean, coalesce(d.daily_std, 0) AS daily_std, coalesce(r.max_count, 0) AS max_outbound_60min,
  floor(b.distinct_inbound_counterparties * 30.0 / CASE WHEN b.period = 'base' THEN 20.0 ELSE 10.0 END * 100 + 0.5) / 100 AS distinct_inbound_per_30d
FROM (SELECT entity_id, period, count(*) FILTER (direction = 'out') AS n_outbound, count(*) FILTER (direction = 'in') AS n_inbound,
    count(*) FILTER (direction = 'internal') AS n_internal, count(*) FILTER (direction = 'out' AND status <> 'completed') AS n_failed_outbound,
    array_to_string(list_sort(list_distinct(list(country) FILTER (direction <> 'internal'))), ',') AS countries,
    count(DISTINCT device_id) FILTER (direction = 'out') AS n_devices,
    count(DISTINCT coalesce(CAST(other_account AS VARCHAR), external_counterparty, 'UNKNOWN')) FILTER (direction = 'in') AS distinct_inbound_counterparties
  FROM legs GROUP BY 1, 2) b
LEFT JOIN ({AMOUNT_SQL}) a ON a.entity_id = b.entity_id AND a.period = b.period
LEFT JOIN ({DAILY_SQL}) d ON d.entity_id = b.entity_id AND d.period = b.period
LEFT JOIN ({ROLL_SQL}) r ON r.entity_id = b.entity_id AND r.period = b.period"""))
def _(b):
    s = prof.period_stats(legs(b), b.period)
    return s.select("entity_id", "period", "n_outbound", "n_inbound", "n_internal", "n_failed_outbound",
                    F.array_join("countries", ",").alias("countries"), "n_devices", "distinct_inbound_counterparties", "out_n",
                    "out_median", "out_p99", "daily_max", "daily_mean", "daily_std", "max_outbound_60min",
                    "distinct_inbound_per_30d")


def activity_sql(hours: dict[str, int], base: str, until: str) -> str:
    """SQL of activity in windows that end with the period, against the outbound rows of twenty days before the longest."""
    scale = ", ".join(f"('{w}', {h}.0E0/24.0E0/20.0E0, INTERVAL {h} HOUR)" for w, h in hours.items())
    return f"""
SELECT w.span, x.entity_id, x.out_count, x.out_failed, x.out_usd, x.in_count, x.distinct_beneficiaries, x.distinct_senders,
  floor(coalesce(bc, 0) * w.scale * 100 + 0.5) / 100 AS expected_count,
  CASE WHEN floor(coalesce(bc, 0) * w.scale * 100 + 0.5) / 100 > 0 THEN floor(x.out_count / (floor(coalesce(bc, 0) * w.scale * 100 + 0.5) / 100) * 100 + 0.5) / 100 END AS vs_baseline
FROM (VALUES {scale}) w(span, scale, width)
JOIN LATERAL (SELECT entity_id, count(*) FILTER (direction = 'out') AS out_count, count(*) FILTER (direction = 'out' AND status <> 'completed') AS out_failed,
    coalesce(CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) FILTER (direction = 'out' AND status = 'completed') AS DOUBLE), 0) AS out_usd,
    count(*) FILTER (direction = 'in') AS in_count,
    count(DISTINCT coalesce(CAST(other_account AS VARCHAR), external_counterparty)) FILTER (direction = 'out' AND status = 'completed' AND transaction_type = 'transfer') AS distinct_beneficiaries,
    count(DISTINCT coalesce(CAST(other_account AS VARCHAR), external_counterparty, 'UNKNOWN')) FILTER (direction = 'in') AS distinct_senders
  FROM legs WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - w.width GROUP BY entity_id) x ON true
LEFT JOIN (SELECT entity_id, count(*) FILTER (direction = 'out') AS bc FROM legs
  WHERE ts > TIMESTAMP '{base}' AND ts <= TIMESTAMP '{until}' GROUP BY 1) y ON y.entity_id = x.entity_id"""


def activity(b: Bank, hours: dict[str, int] | None = None) -> DataFrame:
    a = prof.activity_windows(legs(b), b.period.end, 20, hours)
    return a.select(F.col("window").alias("span"), "entity_id", "out_count", "out_failed", "out_usd", "in_count", "distinct_beneficiaries",
                    "distinct_senders", "expected_count", "vs_baseline")


@query("ag12_activity_windows", oracle("legs", activity_sql({"1h": 1, "24h": 24, "7d": 168}, "2024-01-04 00:00:00", "2024-01-24 00:00:00")))
def _(b):
    """Three windows, so that twenty days of the generated month are left as baseline."""
    return activity(b, {"1h": 1, "24h": 24, "7d": 168})


@query("ag12_all_activity_windows", oracle("legs", activity_sql(prof.ACTIVITY_WINDOWS, "2023-12-12 00:00:00", "2024-01-01 00:00:00")))
def _(b):
    return activity(b)


HIST = """CASE WHEN risk_score < 20 THEN '0-20' WHEN risk_score < 40 THEN '20-40' WHEN risk_score < 60 THEN '40-60' WHEN risk_score < 80 THEN '60-80' WHEN risk_score < 101 THEN '80-100' END"""


@query("ag13_dashboard", oracle("txn customers accounts merchants devices alerts investigations", f"""
SELECT 'rows' AS metric, 'transactions' AS key, count(*) AS n FROM txn UNION ALL SELECT 'rows', 'customers', count(*) FROM customers
UNION ALL SELECT 'rows', 'accounts', count(*) FROM accounts UNION ALL SELECT 'rows', 'merchants', count(*) FROM merchants
UNION ALL SELECT 'rows', 'devices', count(*) FROM devices
UNION ALL SELECT 'open_alerts', severity, count(*) FROM alerts WHERE status = 'open' GROUP BY 2
UNION ALL SELECT 'investigations', status, count(*) FROM investigations GROUP BY 2
UNION ALL SELECT 'risk', {HIST}, count(*) FROM investigations WHERE risk_score IS NOT NULL AND risk_score < 101 GROUP BY 2"""))
def _(b):
    def size(name, df):
        return df.agg(F.lit("rows").alias("metric"), F.lit(name).alias("key"), F.count(F.lit(1)).alias("n"))

    def groups(metric, df, key):
        return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
    return (size("transactions", b.txn).union(size("customers", b.customers)).union(size("accounts", b.accounts))
            .union(size("merchants", b.merchants)).union(size("devices", b.devices))
            .union(groups("open_alerts", b.alerts.filter("status = 'open'"), F.col("severity")))
            .union(groups("investigations", b.investigations, F.col("status")))
            .union(groups("risk", b.investigations.filter("risk_score < 101"), F.expr(HIST))))


@query("ag14_account_balance", oracle("txn accounts", """
SELECT a.account_id, CAST(CAST(a.balance AS DECIMAL(18,2)) + coalesce(i.s, 0) - coalesce(o.s, 0) AS DOUBLE) AS balance FROM accounts a
LEFT JOIN (SELECT receiver_account_id AS id, sum(CAST(amount AS DECIMAL(18,2))) AS s FROM txn WHERE status = 'completed' GROUP BY 1) i ON i.id = a.account_id
LEFT JOIN (SELECT sender_account_id AS id, sum(CAST(amount AS DECIMAL(18,2))) AS s FROM txn WHERE status = 'completed' GROUP BY 1) o ON o.id = a.account_id"""))
def _(b):
    return account_balances(b.txn, b.accounts)


def account_balances(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Opening balance plus completed inflow minus completed outflow: one signed sum per account."""
    amt = F.col("amount").cast("decimal(18,2)")
    sides = F.filter(F.array(F.struct(F.col("receiver_account_id").alias("account_id"), amt.alias("d")),
                             F.struct(F.col("sender_account_id").alias("account_id"), (-amt).cast("decimal(18,2)").alias("d"))),
                     lambda x: x["account_id"].isNotNull())
    net = (txn.filter("status = 'completed'").select(F.explode(sides).alias("x")).groupBy(F.col("x.account_id").alias("account_id"))
           .agg(F.sum("x.d").alias("net")))
    bal = F.col("balance").cast("decimal(18,2)") + F.coalesce(F.col("net"), F.lit(0))
    return accounts.join(net, "account_id", "left").select("account_id", bal.cast("double").alias("balance"))


@query("ag15_device_seen", oracle("txn devices", """
SELECT d.device_id, epoch_us(least(d.first_seen, coalesce(u.a, d.first_seen))) AS first_us, epoch_us(coalesce(u.b, d.last_seen)) AS last_us
FROM devices d LEFT JOIN (SELECT device_id, min(ts) AS a, max(ts) AS b FROM txn WHERE device_id IS NOT NULL GROUP BY 1) u ON u.device_id = d.device_id"""))
def _(b):
    used = b.txn.filter("device_id IS NOT NULL").groupBy("device_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return b.devices.join(used, "device_id", "left").select(
        "device_id", F.unix_micros(F.least("first_seen", "a")).alias("first_us"),
        F.unix_micros(F.coalesce("z", "last_seen")).alias("last_us"))


# ------------------------------------------------------------------------------------------------ windows, set operations
@query("w01_rolling_frame", oracle("legs", """
SELECT entity_id, sec, max(c) AS in_width, CAST(max(s) AS DOUBLE) AS usd FROM (
  SELECT entity_id, sec, count(*) OVER w AS c, sum(CAST(amount_usd AS DECIMAL(18,2))) OVER w AS s FROM legs WHERE direction = 'in'
  WINDOW w AS (PARTITION BY entity_id ORDER BY sec RANGE BETWEEN CURRENT ROW AND 43200 FOLLOWING)) a GROUP BY 1, 2"""))
def _(b):
    r = rolling(legs(b).filter(prof.is_in()), ["entity_id"], 43200, "amount_usd")
    return r.select("entity_id", "sec", "in_width", F.col("amount_in_width").cast("double").alias("usd"))


@query("w02_previous_row", oracle("legs", """
SELECT entity_id, transaction_id, lag(transaction_id) OVER (PARTITION BY entity_id ORDER BY ts, transaction_id) AS prev_transaction_id
FROM legs WHERE direction = 'out'"""))
def _(b):
    rows = legs(b).filter(prof.is_out()).select("entity_id", "transaction_id", "ts", "sec")
    return with_previous(rows, ["entity_id"], ["ts", "transaction_id"], ["transaction_id"], F.floor(F.col("sec") / 86400)
                         ).select("entity_id", "transaction_id", "prev_transaction_id")


@query("w05_first_occurrence", oracle("txn", """
SELECT transaction_id, row_number() OVER (PARTITION BY sender_account_id, receiver_account_id ORDER BY transaction_id) > 1 AS repeated
FROM txn WHERE sender_account_id IS NOT NULL AND receiver_account_id IS NOT NULL"""))
def _(b):
    return repeated_keys(b.txn.filter("sender_account_id IS NOT NULL AND receiver_account_id IS NOT NULL"),
                         ["sender_account_id", "receiver_account_id"], "transaction_id").select("transaction_id", "repeated")


def repeated_keys(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """True for every row but the first of its key: the first is one minimum per key, not a sort of the group."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("__first"))
    return rows.join(first, keys).withColumn("repeated", F.col(order) > F.col("__first")).drop("__first")


@query("t02_top_k_flows", oracle("txn", """
SELECT sender_account_id, receiver_account_id, usd, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sender_account_id ORDER BY usd DESC, receiver_account_id) AS rank FROM (
    SELECT sender_account_id, receiver_account_id, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS usd FROM txn
    WHERE status = 'completed' AND sender_account_id IS NOT NULL AND receiver_account_id IS NOT NULL GROUP BY 1, 2) a) z WHERE rank <= 10"""))
def _(b):
    sums = (b.txn.filter("status = 'completed' AND sender_account_id IS NOT NULL AND receiver_account_id IS NOT NULL")
            .groupBy("sender_account_id", "receiver_account_id").agg(money_sum(F.col("amount_usd")).alias("usd")))
    return top_k(sums, ["sender_account_id"], [F.col("usd").desc(), F.col("receiver_account_id")], 10)


@query("x01_union_distinct", oracle("txn", """
SELECT sender_account_id AS account_id FROM txn WHERE sender_account_id IS NOT NULL UNION SELECT receiver_account_id FROM txn WHERE receiver_account_id IS NOT NULL"""))
def _(b):
    return b.txn.select(F.col("sender_account_id").alias("account_id")).filter("account_id IS NOT NULL").union(
        b.txn.select("receiver_account_id").filter("receiver_account_id IS NOT NULL")).distinct()


@query("x03_set_difference", oracle("legs", """
SELECT entity_id, device_id, 'new' AS kind FROM (SELECT DISTINCT entity_id, device_id FROM legs WHERE period = 'win' AND device_id IS NOT NULL
  EXCEPT SELECT DISTINCT entity_id, device_id FROM legs WHERE period = 'base' AND device_id IS NOT NULL) a
UNION ALL SELECT entity_id, device_id, 'both' FROM (SELECT DISTINCT entity_id, device_id FROM legs WHERE period = 'win' AND device_id IS NOT NULL
  INTERSECT SELECT DISTINCT entity_id, device_id FROM legs WHERE period = 'base' AND device_id IS NOT NULL) c"""))
def _(b):
    pairs = legs(b).filter("device_id IS NOT NULL").select("period", "entity_id", "device_id")
    win, base = (pairs.filter(F.col("period") == p).drop("period").distinct() for p in ("win", "base"))
    return (win.exceptAll(base).withColumn("kind", F.lit("new"))
            .union(win.intersect(base).withColumn("kind", F.lit("both"))))


# ---------------------------------------------------------------------------------------------------------- sources
@query("io01_csv_scan", oracle("txn", """
SELECT status, transaction_type, count(*) AS n, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS usd, epoch_us(max(ts)) // 1000000 AS last_sec FROM txn GROUP BY 1, 2"""))
def _(b):
    """The transactions written as gzip text files by the tasks that hold them, and read back with the explicit schema."""
    import uuid

    from riskloom.session import shared_dir
    folder = f"{shared_dir(b.spark)}/csv-{uuid.uuid4().hex}"
    rows = b.txn.withColumnRenamed("ts", "timestamp")
    cols = [c.split(" ")[0] for c in dataset.DATASET["transactions"].split(", ")]
    (rows.select(*[F.col(c).cast("string") if c.endswith("_id") else F.col(c) for c in cols])
     .withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
     .write.option("header", True).option("compression", "gzip").csv(f"{folder}/transactions"))
    t = dataset.read_csv_table(b.spark, "transactions", f"{folder}/transactions")
    return t.groupBy("status", "transaction_type").agg(
        F.count(F.lit(1)).alias("n"), money_sum(F.col("amount_usd")).alias("usd"), F.unix_seconds(F.max("timestamp")).alias("last_sec"))


@query("io03_bulk_load", oracle("labels_", """
SELECT entity_id, scenario, array_to_string(list_filter(string_split(expected_list, ','), lambda x: x <> ''), '+') AS expected
FROM labels_"""))
def _(b):
    raw = b.labels.withColumn("expected_signals", F.to_json("expected_signals")).withColumn(
        "related_entities", F.lit("[]"))
    twice = raw.unionByName(raw)
    loaded = dataset.bulk_load({"scenario_labels": twice})["scenario_labels"]
    return loaded.select("entity_id", "scenario", F.array_join("expected_signals", "+").alias("expected"))


@query("io04_append_new", oracle("txn", """
SELECT transaction_id, amount_usd FROM txn WHERE ts >= {ws} AND event_parity = 0""".replace("event_parity", "transaction_id % 2")))
def _(b):
    late = b.txn.filter(F.col("ts") >= F.lit(b.period.window_start))
    stored = b.txn.filter((F.col("ts") < F.lit(b.period.window_start)) | (F.col("transaction_id") % 2 == 1))
    return dataset.new_rows(late.unionByName(late), stored).select("transaction_id", "amount_usd")


@query("io04_append_read_back", oracle("txn", "SELECT transaction_id, amount_usd FROM txn"))
def _(b):
    """A stored table, a batch of old and new rows appended to it twice, and the table read back."""
    import uuid

    from riskloom.session import shared_dir
    at = f"{shared_dir(b.spark)}/appended-{uuid.uuid4().hex}"
    dataset.write_tables({"transactions": b.txn.filter("transaction_id % 3 <> 0")}, at)
    for _ in range(2):
        dataset.append_new(b.txn.filter("transaction_id % 2 = 0 OR transaction_id % 3 = 0"), f"{at}/transactions")
    return b.spark.read.parquet(f"{at}/transactions").select("transaction_id", "amount_usd")

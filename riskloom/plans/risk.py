"""Queries over the risk rules: one per rule, with thresholds fitted to the generated tables."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import TRIAL_RULES, Period, RiskRules
from riskloom.functions.geo import haversine_km
from riskloom.functions.numeric import rnd
from riskloom.operators import detectors as det
from riskloom.operators.cycles import verified_cycles
from riskloom.operators.fifo import fifo_dwell, pass_through
from riskloom.operators.orient import legs_for
from riskloom.operators.windows import with_previous
from riskloom.plans.behaviour import AMOUNT_SQL, DAILY_SQL, JSD_SQL, PEER_SQL, ROLL_SQL
from riskloom.plans.registry import oracle, query
from riskloom.sources.generated import AS_OF, Bank


def frames(b: Bank, rules: RiskRules = TRIAL_RULES, period: Period | None = None, grain: str = "customer",
           legs: DataFrame | None = None) -> det.Frames:
    p = period or b.period
    return det.Frames(legs if legs is not None else legs_for(b.txn, b.accounts, p, grain), b.txn, b.customers, b.accounts,
                      b.merchants, b.identifiers, b.alerts, b.investigations, p, rules, grain)


COLUMNS = ("entity_id", "state", "observed", "threshold", "baseline", "strength")


def shown(df: DataFrame) -> DataFrame:
    return df.select("entity_id", "state", *[F.round(c, 6).alias(c) for c in COLUMNS[2:]])


def verdict(inner: str, ramp: float = 1.0, strength: str | None = None, skipped: str = "false") -> str:
    """`inner` yields entity_id, obs, thr, base, fired."""
    ramped = (f"CASE WHEN thr <= 0 THEN 1.0 ELSE floor((0.5 + 0.5 * greatest(0.0, least(1.0, (obs / thr - 1.0) / {ramp}))) * 10000 + 0.5) / 10000 END")
    return f"""
SELECT entity_id, CASE WHEN {skipped} THEN 'not_evaluated' WHEN fired THEN 'fired' ELSE 'below_threshold' END AS state,
  round(obs, 6) AS observed, round(thr, 6) AS threshold, round(CAST(base AS DOUBLE), 6) AS baseline,
  CASE WHEN {skipped} THEN NULL WHEN fired THEN round({strength or ramped}, 6) END AS strength
FROM (SELECT entity_id, CAST(obs AS DOUBLE) AS obs, CAST(thr AS DOUBLE) AS thr, base, fired FROM ({inner}) i0) i"""


def pivot_sql(source: str, cols: dict[str, str]) -> str:
    parts = [f"coalesce(max({c}) FILTER (period = '{p}'), 0) AS {p}_{stem}" for p in ("base", "win") for c, stem in cols.items()]
    return f"(SELECT entity_id, {', '.join(parts)} FROM ({source}) s GROUP BY entity_id)"


BURST = f"SELECT entity_id, win_n AS obs, greatest(2.0, base_n * 1.0) AS thr, base_n AS base, win_n >= greatest(2.0, base_n * 1.0) AS fired FROM {pivot_sql(ROLL_SQL, {'max_count': 'n'})} p WHERE win_n > 0"
VELOCITY = f"SELECT entity_id, win_max AS obs, greatest(3.0, base_mean + 1.5 * base_std) AS thr, base_mean AS base, win_max >= greatest(3.0, base_mean + 1.5 * base_std) AS fired FROM {pivot_sql(DAILY_SQL, {'daily_mean': 'mean', 'daily_std': 'std', 'daily_max': 'max'})} p WHERE win_max > 0"
LARGEST = "(SELECT entity_id, max(amount_usd) AS largest FROM legs WHERE direction = 'out' AND status = 'completed' AND period = 'win' GROUP BY 1)"
AMOUNT = f"""SELECT l.entity_id, largest AS obs, CASE WHEN coalesce(n, 0) < 5 THEN 0.0 ELSE greatest(50.0, median + 3.0 * mad_sigma, p99 * 1.0) END AS thr,
  CASE WHEN coalesce(n, 0) >= 5 THEN median END AS base, largest >= greatest(50.0, median + 3.0 * mad_sigma, p99 * 1.0) AS fired
  FROM {LARGEST} l LEFT JOIN (SELECT * FROM ({AMOUNT_SQL}) a0 WHERE period = 'base') a ON a.entity_id = l.entity_id"""
PEER = f"""SELECT l.entity_id, largest AS obs, p99_usd * 1.0 AS thr, p99_usd AS base, largest >= p99_usd AS fired
  FROM {LARGEST} l JOIN customers c ON c.customer_id = l.entity_id JOIN ({PEER_SQL}) q ON q.segment = c.segment"""
CP_IN = "SELECT entity_id, period, count(DISTINCT coalesce(CAST(other_account AS VARCHAR), external_counterparty, 'UNKNOWN')) AS n FROM legs WHERE direction = 'in' GROUP BY 1, 2"
CP_OUT = "SELECT entity_id, period, count(DISTINCT coalesce(CAST(other_account AS VARCHAR), external_counterparty)) AS n FROM legs WHERE direction = 'out' AND status = 'completed' AND transaction_type = 'transfer' GROUP BY 1, 2"


def fan_sql(source: str) -> str:
    rate = "floor(base_n * 30.0 / 20.0 * 100 + 0.5) / 100 * 10.0 / 30"
    return f"SELECT entity_id, win_n AS obs, greatest(8.0, {rate}) AS thr, {rate} AS base, win_n >= greatest(8.0, {rate}) AS fired FROM {pivot_sql(source, {'n': 'n'})} p WHERE win_n > 0"


BAND = """SELECT entity_id, period, c AS n, CAST(s AS DOUBLE) AS usd FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, period ORDER BY c DESC, s DESC, sec DESC) AS rn FROM (
    SELECT entity_id, period, sec, count(*) OVER w AS c, sum(CAST(amount_usd AS DECIMAL(18,2))) OVER w AS s FROM legs
    WHERE (direction = 'out' OR (direction = 'in' AND other_account IS NULL)) AND status = 'completed'
      AND transaction_type IN ('cash_withdrawal', 'transfer', 'deposit') AND amount_usd >= 30 AND amount_usd < 100
    WINDOW w AS (PARTITION BY entity_id, period ORDER BY sec RANGE BETWEEN CURRENT ROW AND 172800 FOLLOWING)) a) z WHERE rn = 1"""
STRUCTURING = f"SELECT entity_id, win_n AS obs, greatest(3.0, base_n * 1.0) AS thr, base_n AS base, win_n >= greatest(3.0, base_n * 1.0) AND win_usd >= 100 AS fired FROM {pivot_sql(BAND, {'n': 'n', 'usd': 'usd'})} p WHERE win_n > 0"
ACTIVE = "(SELECT entity_id, count(*) FILTER (direction = 'out' AND period = 'base') AS n_base_out, count(*) FILTER (direction <> 'internal' AND period = 'win') AS n_win FROM legs GROUP BY 1)"
COUNTRY = f"""SELECT a.entity_id, coalesce(n, 0) AS obs, 1.0 AS thr, NULL AS base, coalesce(n, 0) >= 1 AS fired, n_base_out FROM {ACTIVE} a LEFT JOIN (
  SELECT l.entity_id, count(*) AS n FROM legs l JOIN customers c ON c.customer_id = l.entity_id WHERE period = 'win' AND l.country IS NOT NULL AND l.country <> c.country
    AND NOT EXISTS (SELECT 1 FROM legs b WHERE b.entity_id = l.entity_id AND b.country = l.country AND b.period = 'base' AND b.direction <> 'internal') GROUP BY 1) x
  ON x.entity_id = a.entity_id WHERE n_win > 0 OR n_base_out > 0"""
HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({d}) - radians({c})) / 2), 2)))))"
PAIRS = f"""SELECT entity_id, transaction_id, pid, km, hours, km / hours AS kmh FROM (
  SELECT entity_id, transaction_id, pid, {HAV.format(a='plat', b='latitude', c='plon', d='longitude')} AS km, greatest((sec - psec) / 3600.0E0, 1.0E0 / 60) AS hours FROM (
    SELECT entity_id, transaction_id, latitude, longitude, sec, lag(transaction_id) OVER w AS pid, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(sec) OVER w AS psec
    FROM legs WHERE direction = 'out' AND period = 'win' AND latitude IS NOT NULL AND longitude IS NOT NULL AND channel IN ('pos', 'atm', 'branch')
    WINDOW w AS (PARTITION BY entity_id ORDER BY ts, transaction_id)) a WHERE pid IS NOT NULL) h WHERE km / hours > 900 AND km >= 500"""
DEVICE = """SELECT entity_id, CASE WHEN usd > 0 THEN coalesce(new_usd, 0) / usd ELSE 0.0 END AS share, n_new, base_devices FROM (
  SELECT entity_id, sum(n_win) AS n_win, sum(CASE WHEN n_base = 0 THEN n_win ELSE 0 END) AS n_new, CAST(sum(CASE WHEN n_base = 0 THEN usd END) AS DOUBLE) AS new_usd,
    CAST(sum(usd) AS DOUBLE) AS usd, count(*) FILTER (n_base > 0) AS base_devices FROM (
    SELECT entity_id, device_id, count(*) FILTER (period = 'base') AS n_base, count(*) FILTER (period = 'win') AS n_win,
      coalesce(sum(CAST(amount_usd AS DECIMAL(18,2))) FILTER (period = 'win' AND status = 'completed'), 0) AS usd
    FROM legs WHERE direction = 'out' AND device_id IS NOT NULL GROUP BY 1, 2) a GROUP BY 1) z WHERE n_win > 0"""
NEW_DEVICE = f"SELECT entity_id, share AS obs, 0.3 AS thr, base_devices AS base, n_new > 0 AND (share >= 0.3 OR n_new >= 3) AS fired FROM ({DEVICE}) d"
SHARING = """SELECT m.entity_id, max(u.n) AS obs, 3.0 AS thr, NULL AS base, max(u.n) >= 3 AS fired FROM (SELECT DISTINCT entity_id, device_id FROM legs WHERE direction = 'out' AND period = 'win' AND device_id IS NOT NULL) m
  JOIN (SELECT device_id, count(DISTINCT a.customer_id) AS n FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE ts >= {bs} AND ts <= {we} GROUP BY 1) u ON u.device_id = m.device_id GROUP BY 1"""
IDENT = """SELECT customer_id AS entity_id, max(n) AS obs, 3.0 AS thr, NULL AS base, bool_or(n >= 3 OR identifier_type IN ('phone', 'email')) AS fired FROM (
  SELECT a.customer_id, a.identifier_type, count(DISTINCT b.customer_id) + 1 AS n FROM identifiers a JOIN identifiers b
    ON a.identifier_type = b.identifier_type AND a.value_hash = b.value_hash AND a.customer_id <> b.customer_id GROUP BY 1, 2) x GROUP BY 1"""
MERCHANT_ROWS = "SELECT entity_id, period, count(*) AS n, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS usd FROM legs WHERE direction = 'out' AND status = 'completed' AND merchant_id IN (SELECT merchant_id FROM merchants WHERE risk_profile = 'high') GROUP BY 1, 2"
MERCHANT = f"SELECT entity_id, win_usd AS obs, greatest(10.0, base_usd * 10.0 / 20.0) AS thr, base_usd * 10.0 / 20.0 AS base, win_n >= 1 AND win_usd >= greatest(10.0, base_usd * 10.0 / 20.0) AS fired FROM {pivot_sql(MERCHANT_ROWS, {'n': 'n', 'usd': 'usd'})} p WHERE win_n > 0"
SHIFT = f"SELECT entity_id, jsd AS obs, 0.1 AS thr, NULL AS base, jsd >= 0.1 AS fired FROM ({JSD_SQL}) j WHERE n_win >= 5"
EXPOSURE = """SELECT entity_id, count(*) FILTER (f.customer_id IS NOT NULL) AS obs, 1.0 AS thr, count(*) AS base, count(*) FILTER (f.customer_id IS NOT NULL) >= 1 AS fired FROM (
  SELECT DISTINCT entity_id, other_entity FROM legs WHERE direction <> 'internal' AND status = 'completed' AND period = 'win' AND other_entity IS NOT NULL AND other_entity <> entity_id) p
  LEFT JOIN (SELECT entity_id AS customer_id FROM alerts WHERE status = 'open' UNION SELECT subject_id FROM investigations WHERE conclusion = 'confirmed_suspicious') f ON f.customer_id = p.other_entity GROUP BY 1"""
HISTORY = "SELECT entity_id, count(*) AS obs, 1.0 AS thr, NULL AS base, true AS fired FROM alerts WHERE created_at < {ws} AND entity_id IN (SELECT customer_id FROM customers) GROUP BY 1"
DORMANT_PERIOD = Period(AS_OF, lookback_days=3, baseline_days=1)
DORMANT_RULES = replace(TRIAL_RULES, dormant_days=1.5, dormant_usd=20)


def dormant_sql(days: float, usd: float) -> str:
    return f"""SELECT entity_id, CASE WHEN h.entity IS NOT NULL THEN floor(hgap * 10 + 0.5) / 10 ELSE best END AS obs, {float(days)} AS thr, NULL AS base, h.entity IS NOT NULL AS fired FROM (
  SELECT customer_id AS entity_id, max(gap) AS best FROM gaps GROUP BY 1) g LEFT JOIN (
  SELECT customer_id AS entity, gap AS hgap, row_number() OVER (PARTITION BY customer_id ORDER BY usd DESC, gap DESC, account_id DESC) AS rn FROM gaps WHERE gap >= {days} AND usd >= {usd}) h
  ON h.entity = g.entity_id AND h.rn = 1"""


def gaps_sql(base: str, window: str) -> str:
    """SQL of accounts that come back in the window after none in the baseline."""
    return f"""gaps AS (SELECT a.customer_id, a.account_id, usd, (epoch_us(first_win) - epoch_us(coalesce(last_old, a.opened_at))) / 86400e6 AS gap FROM (
  SELECT account_id, min(ts) FILTER (ts >= {window}) AS first_win, count(*) FILTER (ts >= {base} AND ts < {window}) AS n_base,
    max(ts) FILTER (ts <= {base}) AS last_old,
    coalesce(CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) FILTER (ts >= {window} AND status = 'completed') AS DOUBLE), 0) AS usd
  FROM (SELECT sender_account_id AS account_id, ts, amount_usd, status FROM txn WHERE sender_account_id IS NOT NULL
        UNION ALL SELECT receiver_account_id, ts, amount_usd, status FROM txn WHERE receiver_account_id IS NOT NULL AND receiver_account_id IS DISTINCT FROM sender_account_id) x
  WHERE ts <= {{we}} GROUP BY 1) y JOIN accounts a ON a.account_id = y.account_id WHERE first_win IS NOT NULL AND n_base = 0 AND a.opened_at <= {base})"""


# one day of baseline and three of window, so that some accounts are dormant in the generated tables
DORMANT = dormant_sql(DORMANT_RULES.dormant_days, DORMANT_RULES.dormant_usd)
GAPS = gaps_sql("TIMESTAMP '2024-01-27 00:00:00'", "TIMESTAMP '2024-01-28 00:00:00'")


def _chains(hops: int) -> str:
    """SQL of chains of up to `hops` transfers, each the earliest fitting one to its next account, and the cycles they close."""
    parts = ["""
t AS (SELECT sender_account_id AS s, receiver_account_id AS r, ts, transaction_id AS id, amount_usd AS usd FROM txn WHERE ts >= {ws} AND ts <= {we} AND status = 'completed'
  AND sender_account_id IS NOT NULL AND receiver_account_id IS NOT NULL AND sender_account_id <> receiver_account_id AND amount_usd > 0),
h1 AS (SELECT [s, r] AS path, [id] AS ids, r AS last, ts AS t0, ts AS tl, usd AS u0, usd AS ul FROM t)"""]
    for n in range(2, hops + 1):
        parts.append(f"""
h{n} AS (SELECT * FROM (SELECT list_append(h.path, c.r) AS path, list_append(h.ids, c.id) AS ids, c.r AS last, h.t0, c.ts AS tl, h.u0, c.usd AS ul, row_number() OVER (PARTITION BY h.ids, c.r ORDER BY c.ts, c.id) AS rn
  FROM h{n - 1} h JOIN t c ON c.s = h.last AND c.ts > h.tl AND c.ts <= h.tl + INTERVAL 72 HOUR AND abs(c.usd / h.ul - 1) <= 0.3
  WHERE h.last <> h.path[1] AND (c.r = h.path[1] OR NOT list_contains(h.path, c.r))) q WHERE rn = 1)""")
    ends = "\n  UNION ALL ".join(f"SELECT path[:{n}] AS path, ids, t0, u0, ul FROM h{n} WHERE last = path[1]" for n in range(2, hops + 1))
    return ",".join(parts) + f""",
closed AS ({ends}),
canon AS (SELECT list_concat(path[list_position(path, list_min(path)):], path[:list_position(path, list_min(path)) - 1]) AS cycle, path, t0, u0, ul, ids FROM closed),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY list_position(cycle, path[1]), t0, ids[1]) AS rn FROM canon) q WHERE rn = 1)"""


CYCLES = _chains(TRIAL_RULES.cycle_length)
CIRCULAR = """SELECT a.customer_id AS entity_id, floor(max(u0) * 100 + 0.5) / 100 AS obs, 20.0 AS thr, NULL AS base, max(u0) >= 20 AS fired
  FROM (SELECT u0, unnest(cycle) AS account_id FROM best) m JOIN accounts a ON a.account_id = m.account_id GROUP BY 1"""



def fifo_sql(keys: str, inbound: str, seconds: int, rows: str = "true") -> str:
    """SQL of first-in-first-out matching by walking through each key's outflows: slices (keys, in_sec, in_id, out_sec, out_id, cents, place)."""
    k = [x.strip() for x in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    of = lambda t: ", ".join(f"{t}.{x}" for x in k)
    return f"""
fs AS (SELECT {keys}, sec, coalesce(sum(cents) FILTER (side = 'in'), 0)::BIGINT AS in_c, coalesce(sum(cents) FILTER (side = 'out'), 0)::BIGINT AS out_c, CAST(min(transaction_id) FILTER (side = 'in') AS VARCHAR) AS in_id,
    CAST(min(transaction_id) FILTER (side = 'out') AS VARCHAR) AS out_id, count(*) FILTER (side = 'in') AS n_in
  FROM (SELECT *, CAST(round(CAST(amount_usd AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents, CASE WHEN direction = 'out' THEN 'out' WHEN direction = 'in' AND {inbound} THEN 'in' END AS side FROM legs
    WHERE status = 'completed' AND {rows}) z WHERE side IS NOT NULL GROUP BY ALL),
cr AS (SELECT {keys}, sec AS in_sec, in_id, sum(in_c) OVER w - in_c AS c_from, sum(in_c) OVER w AS c_to FROM fs WHERE in_c > 0 WINDOW w AS (PARTITION BY {keys} ORDER BY sec)),
ou AS (SELECT {of('o')}, o.sec AS out_sec, o.out_id, any_value(o.out_c) AS out_c, coalesce(sum(i.in_c), 0)::BIGINT AS come, coalesce(sum(i.in_c) FILTER (i.sec < o.sec - {seconds}), 0)::BIGINT AS too_old,
    row_number() OVER (PARTITION BY {of('o')} ORDER BY o.sec) AS rn FROM fs o LEFT JOIN fs i ON {same('i', 'o')} AND i.in_c > 0 AND i.sec <= o.sec WHERE o.out_c > 0 GROUP BY {of('o')}, o.sec, o.out_id),
wk AS (SELECT {keys}, out_sec, out_id, rn, too_old AS o_from, least(too_old + out_c, come) AS o_to FROM ou WHERE rn = 1
  UNION ALL SELECT {of('ou')}, ou.out_sec, ou.out_id, ou.rn, greatest(wk.o_to, ou.too_old), least(greatest(wk.o_to, ou.too_old) + ou.out_c, ou.come) FROM wk JOIN ou ON {same('wk', 'ou')} AND ou.rn = wk.rn + 1),
sl AS (SELECT {of('wk')}, in_sec, in_id, out_sec, out_id, least(o_to, c_to) - greatest(o_from, c_from) AS cents, least(o_to, c_to) AS place
  FROM wk JOIN cr ON {same('cr', 'wk')} AND c_from < o_to AND c_to > o_from WHERE o_to > o_from)"""


PASS = fifo_sql("entity_id, period", "transaction_type = 'transfer'", 3600 * TRIAL_RULES.pass_hours) + """,
pt AS (SELECT i.entity_id, i.period, CASE WHEN inbound > 0 THEN floor(coalesce(matched, 0) / 100 / (inbound / 100) * 10000 + 0.5) / 10000 ELSE 0.0 END AS ratio, floor(inbound / 100 * 100 + 0.5) / 100 AS inbound_usd,
  floor(coalesce(matched, 0) / 100 * 100 + 0.5) / 100 AS matched_usd, n_inbound FROM (SELECT entity_id, period, sum(in_c) AS inbound, CAST(sum(n_in) AS BIGINT) AS n_inbound FROM fs GROUP BY 1, 2 HAVING sum(n_in) > 0) i
  LEFT JOIN (SELECT entity_id, period, sum(cents) AS matched FROM sl GROUP BY 1, 2) m ON m.entity_id = i.entity_id AND m.period = i.period)"""
PASS_RULE = f"""SELECT entity_id, max(ratio) FILTER (period = 'win') AS obs, {float(TRIAL_RULES.pass_min_ratio)} AS thr, max(ratio) FILTER (period = 'base') AS base,
  max(inbound_usd) FILTER (period = 'win') >= {TRIAL_RULES.pass_min_usd} AND max(n_inbound) FILTER (period = 'win') >= {TRIAL_RULES.pass_min_count} AND max(ratio) FILTER (period = 'win') >= {TRIAL_RULES.pass_min_ratio} AS fired
  FROM pt GROUP BY 1 HAVING count(*) FILTER (period = 'win') > 0"""
DWELL = fifo_sql("entity_id", "other_account IS NOT NULL", 24 * 3600, "period = 'win'")

SQL = {
    "TRANSACTION_BURST": ("d01_transaction_burst", oracle("legs", verdict(BURST))),
    "VELOCITY_SPIKE": ("d02_velocity_spike", oracle("legs", verdict(VELOCITY))),
    "AMOUNT_DEVIATION": ("d03_amount_deviation", oracle("legs", verdict(AMOUNT, skipped="thr = 0.0"))),
    "PEER_AMOUNT_DEVIATION": ("d04_peer_amount_deviation", oracle("legs customers", verdict(PEER))),
    "RAPID_PASS_THROUGH": ("d05_rapid_pass_through", oracle("recursive legs", verdict(PASS_RULE, TRIAL_RULES.pass_ramp), PASS)),
    "FAN_IN": ("d06_fan_in", oracle("legs", verdict(fan_sql(CP_IN)))),
    "FAN_OUT": ("d07_fan_out", oracle("legs", verdict(fan_sql(CP_OUT)))),
    "STRUCTURING": ("d08_structuring", oracle("legs", verdict(STRUCTURING))),
    "GEO_NEW_COUNTRY": ("d09_new_country", oracle("legs customers", verdict(COUNTRY, 2.0, skipped="nbo = 0").replace(
        "base, fired FROM (", "base, fired, n_base_out AS nbo FROM (", 1))),
    "IMPOSSIBLE_TRAVEL": ("d10_impossible_travel", oracle("legs", verdict(
        f"SELECT entity_id, floor(max(kmh) + 0.5) AS obs, 900.0 AS thr, NULL AS base, true AS fired FROM ({PAIRS}) p GROUP BY 1"))),
    "NEW_DEVICE": ("d11_new_device", oracle("legs", verdict(NEW_DEVICE, strength="floor((0.5 + 0.5 * greatest(0.0, least(1.0, greatest(obs, thr) / thr - 1.0))) * 10000 + 0.5) / 10000")
                                            .replace("round(obs, 6) AS observed", "floor(obs * 10000 + 0.5) / 10000 AS observed"))),
    "DEVICE_SHARING": ("d12_device_sharing", oracle("legs", verdict(SHARING))),
    "SHARED_IDENTIFIER": ("d13_shared_identifier", oracle("identifiers", verdict(IDENT, strength="floor((0.5 + 0.5 * greatest(0.0, least(1.0, greatest(obs, thr) / thr - 1.0))) * 10000 + 0.5) / 10000"))),
    "CIRCULAR_FLOW": ("d14_circular_flow", oracle("txn accounts", verdict(CIRCULAR), CYCLES)),
    "DORMANT_REACTIVATION": ("d15_dormant_reactivation", oracle("txn accounts", verdict(DORMANT), GAPS)),
    "HIGH_RISK_MERCHANT": ("d16_high_risk_merchant", oracle("legs merchants", verdict(MERCHANT))),
    "BEHAVIOURAL_SHIFT": ("d17_behavioural_shift", oracle("legs", verdict(SHIFT).replace("round(obs, 6) AS observed", "floor(obs * 10000 + 0.5) / 10000 AS observed"))),
    "NETWORK_EXPOSURE": ("d18_network_exposure", oracle("legs alerts investigations", verdict(EXPOSURE, 2.0))),
    "HISTORICAL_ALERTS": ("d19_historical_alerts", oracle("alerts customers", verdict(HISTORY, strength="floor(least(1.0, obs / 3.0) * 10000 + 0.5) / 10000"))),
}


def _register(detector: str, name: str, sql: str | None) -> None:
    @query(name, sql)
    def run(b: Bank) -> DataFrame:
        if detector == "DORMANT_REACTIVATION":
            return shown(det.RULES[detector](frames(b, DORMANT_RULES, DORMANT_PERIOD)))
        return shown(det.RULES[detector](frames(b, TRIAL_RULES)))


for _detector, (_name, _sql) in SQL.items():
    _register(_detector, _name, _sql)


@query("j05_temporal_chains", oracle("txn", "SELECT array_to_string(cycle, '>') AS cycle, u0 AS start_usd, epoch_us(t0) AS start_us FROM best", CYCLES))
def _(b):
    c = verified_cycles(b.txn, b.period.window_start, b.period.end, TRIAL_RULES)
    return c.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), "start_usd",
                    F.unix_micros("start_ts").alias("start_us"))


@query("d14_circular_flow_five_hops", oracle("txn", "SELECT array_to_string(cycle, '>') AS cycle, CAST(len(cycle) AS INTEGER) AS hops, u0 AS start_usd, ul AS end_usd FROM best", CYCLES))
def _(b):
    c = verified_cycles(b.txn, b.period.window_start, b.period.end, TRIAL_RULES)
    return c.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), F.size("cycle").alias("hops"), "start_usd", "end_usd")


@query("j06_outflow_to_inflow", oracle("recursive legs", """
SELECT pt.*, coalesce(x.pairs, '') AS pairs FROM pt LEFT JOIN (SELECT entity_id, period, string_agg(in_id || ',' || out_id, ',' ORDER BY place) AS pairs
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period ORDER BY place) AS rn FROM sl) y WHERE rn <= 8 GROUP BY 1, 2) x ON x.entity_id = pt.entity_id AND x.period = pt.period""", PASS))
def _(b):
    f = frames(b)
    return pass_through(f.legs, det.KEYS, TRIAL_RULES.pass_hours, TRIAL_RULES.pass_types).withColumn("pairs", F.array_join("pairs", ","))


@query("d22_amount_outliers", oracle("legs", """
SELECT l.entity_id, l.transaction_id, l.amount_usd, floor(median * 100 + 0.5) / 100 AS reference,
  round(floor((l.amount_usd - median) / sigma * 10000 + 0.5) / 10000, 3) AS z FROM legs l JOIN (
  SELECT c.entity_id, any_value(m) AS median, CASE WHEN quantile_cont(abs(amount_usd - m), 0.5) * 1.4826 > 0 THEN quantile_cont(abs(amount_usd - m), 0.5) * 1.4826 ELSE greatest(any_value(m) * 0.1, 1.0) END AS sigma
  FROM legs b JOIN (SELECT entity_id, quantile_cont(amount_usd, 0.5) AS m FROM legs WHERE direction = 'out' AND status = 'completed' AND period = 'base' GROUP BY 1 HAVING count(*) >= 5) c ON c.entity_id = b.entity_id
  WHERE direction = 'out' AND status = 'completed' AND period = 'base' GROUP BY 1) s ON s.entity_id = l.entity_id
WHERE direction = 'out' AND status = 'completed' AND period = 'win' AND (l.amount_usd - median) / sigma >= 3.5"""))
def _(b):
    return det.amount_outliers(frames(b), 3.5).withColumn("z", F.round("z", 3))


HOME = HAV.format(a="c.home_latitude", b="l.latitude", c="c.home_longitude", d="l.longitude")


@query("d23_distance_outliers", oracle("legs customers", f"""
SELECT d.entity_id, d.transaction_id, floor(km * 10 + 0.5) / 10 AS distance_km,
  round(floor(CASE WHEN n >= 10 THEN greatest(300.0, q * 1.5) ELSE 300.0 END * 1000 + 0.5) / 1000, 2) AS limit_km FROM (
  SELECT l.entity_id, transaction_id, period, {HOME} AS km FROM legs l JOIN customers c ON c.customer_id = l.entity_id WHERE direction = 'out' AND l.latitude IS NOT NULL) d
LEFT JOIN (SELECT l.entity_id, count(*) AS n, quantile_cont({HOME}, 0.99) AS q FROM legs l JOIN customers c ON c.customer_id = l.entity_id
  WHERE direction = 'out' AND l.latitude IS NOT NULL AND period = 'base' GROUP BY 1) b ON b.entity_id = d.entity_id
WHERE d.period = 'win' AND floor(km * 10 + 0.5) / 10 > CASE WHEN n >= 10 THEN greatest(300.0, q * 1.5) ELSE 300.0 END"""))
def _(b):
    return det.distance_outliers(frames(b)).withColumn("limit_km", F.round("limit_km", 2))


@query("d24_near_location", oracle("txn", f"""
SELECT transaction_id, round(km, 4) AS distance_km FROM (SELECT transaction_id, {HAV.format(a='10.0', b='latitude', c='20.0', d='longitude')} AS km FROM txn WHERE latitude IS NOT NULL) x WHERE km <= 1200"""))
def _(b):
    return det.near_location(b.txn, 10.0, 20.0, 1200.0).select("transaction_id", F.round("distance_km", 4).alias("distance_km"))


@query("d25_pair_distance", oracle("legs", f"""
SELECT transaction_id, prev_id, CASE WHEN plat IS NOT NULL AND latitude IS NOT NULL THEN round({HAV.format(a='plat', b='latitude', c='plon', d='longitude')}, 4) END AS km FROM (
  SELECT transaction_id, latitude, longitude, lag(transaction_id) OVER w AS prev_id, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM legs WHERE direction = 'out'
  WINDOW w AS (PARTITION BY entity_id ORDER BY ts, transaction_id)) a WHERE prev_id IS NOT NULL"""))
def _(b):
    rows = frames(b).legs.filter("direction = 'out'").select("entity_id", "transaction_id", "ts", "sec", "latitude", "longitude")
    p = with_previous(rows, ["entity_id"], ["ts", "transaction_id"], ["transaction_id", "latitude", "longitude"], F.floor(F.col("sec") / 86400))
    km = haversine_km(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"))
    return p.filter("prev_transaction_id IS NOT NULL").select("transaction_id", F.col("prev_transaction_id").alias("prev_id"), F.round(km, 4).alias("km"))


@query("u01_fifo_dwell", oracle("recursive legs", """
SELECT k.entity_id, coalesce(matched, 0) / 100 AS matched_usd, round(median_dwell_hours, 9) AS median_dwell_hours, coalesce(moved_ids, '') AS moved_ids FROM (SELECT DISTINCT entity_id FROM fs) k
LEFT JOIN (SELECT entity_id, sum(cents) AS matched, median(out_sec - in_sec) / 3600 AS median_dwell_hours FROM sl GROUP BY 1) m ON m.entity_id = k.entity_id
LEFT JOIN (SELECT entity_id, string_agg(out_id, ',' ORDER BY out_sec) AS moved_ids FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY out_sec) AS rn FROM (SELECT DISTINCT entity_id, out_sec, out_id FROM sl) d) x
  WHERE rn <= 10 GROUP BY 1) i ON i.entity_id = k.entity_id""", DWELL))
def _(b):
    d = fifo_dwell(frames(b).legs.filter("period = 'win'"), ["entity_id"], 24)
    return d.withColumn("moved_ids", F.array_join("moved_ids", ",")).withColumn("median_dwell_hours", F.round("median_dwell_hours", 9))

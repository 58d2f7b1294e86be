"""Queries over the ingestion gate, batch accounting and the stored-data audit."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import FX_PER_USD, TYPE_SIDE, GateRules
from riskloom.functions.masking import mask_entities, mask_ip
from riskloom.operators import quality as dq
from riskloom.plans.registry import oracle, query
from riskloom.plans.scores import case
from riskloom.sources.generated import AS_OF, Bank

RULES = GateRules()
FX = "(" + ", ".join(f"'{c}'" for c in FX_PER_USD) + ")"
TS = "TRY_CAST(timestamp AS TIMESTAMP)"
AMT = "TRY_CAST(amount AS DOUBLE)"
CODED = f"""
stored AS (SELECT * FROM txn WHERE ts < {{ws}}),
c1 AS (SELECT *, CASE WHEN malformed THEN 'MALFORMED_ROW' WHEN timestamp IS NULL OR amount IS NULL OR currency IS NULL OR transaction_type IS NULL OR channel IS NULL THEN 'MISSING_FIELD'
  WHEN {TS} IS NULL THEN 'INVALID_TIMESTAMP' WHEN {TS} < {{we}} - INTERVAL 3650 DAY OR {TS} > {{we}} + INTERVAL 24 HOUR THEN 'TIMESTAMP_OUT_OF_RANGE'
  WHEN {AMT} IS NULL OR isinf({AMT}) OR isnan({AMT}) THEN 'INVALID_AMOUNT' WHEN {AMT} <= 0 THEN 'NON_POSITIVE_AMOUNT' WHEN NOT regexp_full_match(currency, '[A-Za-z]{{{{3}}}}') THEN 'INVALID_CURRENCY'
  WHEN upper(currency) NOT IN {FX} THEN 'UNSUPPORTED_CURRENCY' WHEN {case('lower(transaction_type)', TYPE_SIDE)} IS NULL THEN 'INVALID_TYPE'
  WHEN lower(channel) NOT IN ('web', 'mobile', 'pos', 'atm', 'branch', 'api') THEN 'INVALID_CHANNEL' WHEN coalesce(lower(status), 'completed') NOT IN ('completed', 'failed', 'reversed', 'pending') THEN 'INVALID_STATUS'
  WHEN sender_account_id IS NULL AND receiver_account_id IS NULL THEN 'NO_ACCOUNT'
  WHEN ({case('lower(transaction_type)', TYPE_SIDE)} = 'S' AND sender_account_id IS NULL) OR ({case('lower(transaction_type)', TYPE_SIDE)} = 'R' AND receiver_account_id IS NULL) THEN 'DIRECTION_MISMATCH'
  WHEN ip_address IN ('999.1.1.1', 'fe80::1::2') THEN 'INVALID_IP' WHEN transaction_id IS NOT NULL AND NOT regexp_full_match(transaction_id, 'TXN-[0-9]+') THEN 'INVALID_ID_FORMAT' END AS c0 FROM batch),
c2 AS (SELECT c1.*, coalesce(c0, CASE WHEN sender_account_id IS NOT NULL AND s.account_id IS NULL THEN 'UNKNOWN_ACCOUNT' WHEN s.status = 'closed' THEN 'ACCOUNT_CLOSED' WHEN receiver_account_id IS NOT NULL AND r.account_id IS NULL THEN 'UNKNOWN_ACCOUNT'
    WHEN r.status = 'closed' THEN 'ACCOUNT_CLOSED' WHEN c1.device_id IS NOT NULL AND d.device_id IS NULL THEN 'UNKNOWN_DEVICE' WHEN c1.merchant_id IS NOT NULL AND m.merchant_id IS NULL THEN 'UNKNOWN_MERCHANT' END) AS cr
  FROM c1 LEFT JOIN accounts s ON CAST(s.account_id AS VARCHAR) = sender_account_id LEFT JOIN accounts r ON CAST(r.account_id AS VARCHAR) = receiver_account_id
  LEFT JOIN devices d ON CAST(d.device_id AS VARCHAR) = c1.device_id LEFT JOIN merchants m ON CAST(m.merchant_id AS VARCHAR) = c1.merchant_id),
unlike AS (SELECT c2.*, CASE WHEN cr IS NULL AND transaction_id IS NOT NULL AND (transaction_id IN (SELECT concat('TXN-', transaction_id) FROM stored) OR row > min(row) FILTER (cr IS NULL) OVER (PARTITION BY transaction_id)) THEN 'DUPLICATE_ID' ELSE cr END AS code FROM c2),
lively AS (SELECT row, epoch_us({TS}) AS us, concat_ws('|', coalesce(sender_account_id, '-'), coalesce(receiver_account_id, '-'), round({AMT}, 2), upper(currency)) AS k FROM unlike WHERE code IS NULL),
line AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row, us) AS rn FROM (SELECT * FROM lively UNION ALL SELECT -1, epoch_us(ts), concat_ws('|', coalesce(CAST(sender_account_id AS VARCHAR), '-'),
    coalesce(CAST(receiver_account_id AS VARCHAR), '-'), round(amount, 2), currency) AS k FROM stored) z WHERE k IN (SELECT k FROM lively)),
walk AS (SELECT k, rn, row, false AS bad, [us] AS times FROM line WHERE rn = 1
  UNION ALL SELECT k, rn, row, bad, CASE WHEN bad THEN times ELSE list_append(times, us) END FROM (
    SELECT l.k, l.rn, l.row, l.us, w.times, l.row >= 0 AND len([x FOR x IN w.times IF abs(x - l.us) <= {RULES.likely_duplicate_seconds} * 1000000]) > 0 AS bad FROM walk w JOIN line l ON l.k = w.k AND l.rn = w.rn + 1) n),
coded AS (SELECT * REPLACE (CASE WHEN code IS NULL AND row IN (SELECT row FROM walk WHERE bad) THEN 'LIKELY_DUPLICATE' ELSE code END AS code) FROM unlike),
grouped AS (SELECT *, CASE WHEN code IS NULL THEN NULL {' '.join(f"WHEN code IN {c} THEN '{g}'" for g, c in dq.CODE_GROUPS.items())} ELSE 'invalid' END AS grp FROM coded)""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")
BV = "recursive batch txn accounts devices merchants"


def stored(b: Bank) -> DataFrame:
    return b.txn.filter(F.col("ts") < F.lit(b.period.window_start)).withColumn("transaction_id", F.concat(F.lit("TXN-"), F.col("transaction_id").cast("string")))


def gated(b: Bank, rules: GateRules = RULES) -> DataFrame:
    return dq.gate(b.batch, b.accounts, b.devices, b.merchants, stored(b), AS_OF, rules)


@query("dq01_ingestion_gate", oracle(BV, "SELECT row, code FROM coded", CODED))
def _(b):
    return gated(b).select("row", "code")


@query("dq01_gate_with_likely_duplicates", oracle(BV, "SELECT row, code FROM coded", CODED))
def _(b):
    return gated(b).select("row", "code")


@query("j07_likely_duplicates", oracle(BV, f"SELECT row, sender_account_id, receiver_account_id, {AMT} AS amount, upper(currency) AS currency FROM coded WHERE code = 'LIKELY_DUPLICATE'", CODED))
def _(b):
    return gated(b).filter("code = 'LIKELY_DUPLICATE'").select("row", "sender_account_id", "receiver_account_id", "amount", "currency")


FXV = case("upper(currency)", FX_PER_USD)


@query("dq02_normalised_rows", oracle(BV, f"""
SELECT row, upper(currency) AS currency, lower(transaction_type) AS transaction_type, lower(channel) AS channel, coalesce(lower(status), 'completed') AS status, transaction_id IS NULL AS id_generated,
  coalesce(TRY_CAST(amount_usd AS DOUBLE), floor({AMT} / {FXV} * 100 + 0.5) / 100) AS amount_usd FROM coded WHERE code IS NULL""", CODED))
def _(b):
    return dq.accepted(gated(b), "batch-1").select("row", "currency", "transaction_type", "channel", "status", "id_generated", "amount_usd")


@query("dq03_late_rows", oracle(BV, f"SELECT row, {TS} < TIMESTAMP '2024-01-24 00:00:00' AS late FROM coded WHERE code IS NULL", CODED))
def _(b):
    from datetime import datetime
    return dq.late(dq.accepted(gated(b), "batch-1"), datetime(2024, 1, 25), RULES).select("row", "late")


@query("dq04_missing_ids", oracle(BV, f"""
SELECT concat('TXN-', x) AS transaction_id FROM (SELECT unnest(range(0, (SELECT max(event_id) + 51 FROM events))) AS x) s
WHERE concat('TXN-', x) NOT IN (SELECT transaction_id FROM batch WHERE transaction_id IS NOT NULL) AND concat('TXN-', x) NOT IN (SELECT concat('TXN-', transaction_id) FROM stored)""", CODED))
def _(b):
    last = b.txn.agg(F.max("transaction_id").alias("m"))
    ids = last.select(F.explode(F.sequence(F.lit(0), F.col("m") + 50)).alias("id")).select(F.concat(F.lit("TXN-"), F.col("id").cast("string")).alias("transaction_id"))
    return dq.missing_ids(b.batch, stored(b), ids)


@query("dq05_batch_ledger", oracle(BV, """
SELECT count(*) AS received, count(*) FILTER (code IS NULL) AS processed, count(code) AS rejected, 0 AS failed, count(*) FILTER (grp = 'duplicate') AS duplicates, count(*) FILTER (grp = 'malformed') AS malformed,
  count(*) FILTER (grp = 'referential') AS referential, count(*) FILTER (grp = 'invalid') AS invalid FROM grouped""", CODED))
def _(b):
    return dq.ledger(gated(b))


@query("dq05_reason_counts", oracle(BV, "SELECT code, grp AS \"group\", count(*) AS n FROM grouped WHERE code IS NOT NULL GROUP BY 1, 2", CODED))
def _(b):
    return dq.reason_counts(gated(b))


DAYS = """per_day AS (SELECT CAST(TRY_CAST(timestamp AS TIMESTAMP) AS DATE) AS day, count(*) AS received, count(*) FILTER (code IS NULL) AS processed, count(code) AS rejected, count(*) FILTER (grp = 'duplicate') AS duplicates,
  count(*) FILTER (grp = 'malformed') AS malformed, count(*) FILTER (code IS NULL AND TRY_CAST(timestamp AS TIMESTAMP) < TIMESTAMP '2024-01-24 00:00:00') AS late FROM grouped GROUP BY 1)"""


@query("dq06_quality_totals", oracle(BV, """
SELECT count(*) AS batches, count(*) FILTER (d) AS batches_with_expected, sum(received + 5) FILTER (d) AS expected, sum(received) AS received, sum(processed) AS processed, sum(rejected) AS rejected, sum(duplicates) AS duplicates, sum(malformed) AS malformed, sum(late) AS late, 0 AS failed, sum(5) FILTER (d) AS missing,
  floor(least(sum(received) FILTER (d) / sum(received + 5) FILTER (d), 1.0) * 1e6 + 0.5) / 1e6 AS coverage, floor(sum(processed) FILTER (d) / sum(received + 5) FILTER (d) * 1e6 + 0.5) / 1e6 AS effective_coverage,
  floor(sum(processed) / sum(received) * 1e6 + 0.5) / 1e6 AS processing_success, floor((sum(processed) - sum(late)) * 100.0 / sum(received) * 100 + 0.5) / 100 AS quality_score
FROM (SELECT *, day IS NOT NULL AND day(day) % 2 = 0 AS d FROM per_day) x""", CODED + ",\n" + DAYS))
def _(b):
    """One ledger row per arrival day; even days declared five rows more than came."""
    g = gated(b)
    day = F.to_date("ts")
    late = F.count(F.when(F.col("code").isNull() & (F.col("ts") < F.to_timestamp(F.lit("2024-01-24 00:00:00"))), 1)).alias("late")
    per = dq.ledger(g.withColumn("day", day), ("day",)).join(g.groupBy(day.alias("d2")).agg(late), F.col("day").eqNullSafe(F.col("d2")))
    declared = F.coalesce(F.dayofmonth("day") % 2 == 0, F.lit(False))
    per = per.withColumn("expected_count", F.when(declared, F.col("received") + 5)).withColumn("missing", F.when(declared, F.lit(5).cast("long")))
    return dq.quality_totals(per)


AUDIT = f"""
flags AS (SELECT t.*, transaction_id IS NULL AS missing_transaction_id, row_number() OVER (PARTITION BY transaction_id ORDER BY row) > 1 AND transaction_id IS NOT NULL AS duplicate_transaction_id,
  amount IS NULL OR amount <= 0 AS invalid_amount, upper(currency) NOT IN {FX} AS invalid_currency, ts IS NULL AS invalid_timestamp, coalesce(ts > TIMESTAMP '2024-01-28 00:00:00', false) AS future_timestamp,
  sender_account_id IS NULL AND receiver_account_id IS NULL AS no_account, sender_account_id IS NOT NULL AND sender_account_id NOT IN (SELECT account_id FROM accounts WHERE account_id % 50 <> 7) AS orphan_sender_account,
  receiver_account_id IS NOT NULL AND receiver_account_id NOT IN (SELECT account_id FROM accounts WHERE account_id % 50 <> 7) AS orphan_receiver_account,
  merchant_id IS NOT NULL AND merchant_id NOT IN (SELECT merchant_id FROM merchants) AS orphan_merchant, device_id IS NOT NULL AND device_id NOT IN (SELECT device_id FROM devices) AS orphan_device,
  lower(status) NOT IN ('completed', 'failed', 'reversed', 'pending') OR ({case('lower(transaction_type)', TYPE_SIDE)} = 'S' AND sender_account_id IS NULL) OR ({case('lower(transaction_type)', TYPE_SIDE)} = 'R' AND receiver_account_id IS NULL) AS impossible_state,
  transaction_type IS NULL OR channel IS NULL AS incomplete_record,
  coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY coalesce(CAST(sender_account_id AS VARCHAR), ''), coalesce(CAST(receiver_account_id AS VARCHAR), ''), currency, amount ORDER BY ts, row) <= 60000000, false) AS near
  FROM held t),
audited AS (SELECT *, near AND NOT duplicate_transaction_id AS likely_duplicate FROM flags)"""
HELD = """held AS (SELECT transaction_id * 2 + c AS row, CASE WHEN transaction_id % 43 = 0 THEN NULL WHEN c = 1 AND transaction_id % 2 = 0 THEN transaction_id ELSE transaction_id + c * 100000000 END AS transaction_id, sender_account_id, receiver_account_id, merchant_id, device_id,
  CASE WHEN transaction_id % 47 = 0 THEN -amount ELSE amount END AS amount, currency, CASE WHEN transaction_id % 51 <> 0 THEN ts + INTERVAL '20' SECOND * CAST(c AS INT) END AS ts, transaction_type, CASE WHEN transaction_id % 57 = 0 THEN NULL ELSE channel END AS channel, status
  FROM {txn}, (SELECT 0 AS c UNION ALL SELECT 1) k WHERE c = 0 OR transaction_id % 31 = 3)"""


def held(b: Bank) -> DataFrame:
    """The stored rows with some faults, a part of them held twice."""
    text = HELD[len("held AS ("):-1].format(txn="{txn}")
    return b.spark.sql(text, txn=b.txn)


def audited(b: Bank) -> DataFrame:
    from datetime import datetime
    return dq.audit_rows(held(b), b.accounts.filter("account_id % 50 <> 7"), b.merchants, b.devices, datetime(2024, 1, 27))


AV = "txn accounts merchants devices"
AUDIT_SQL = HELD.format(txn="txn") + "," + AUDIT


@query("dq07_audit_flags", oracle(AV, "SELECT row, " + ", ".join(dq.CHECKS) + " FROM audited", AUDIT_SQL))
def _(b):
    return audited(b).select("row", *dq.CHECKS)


@query("dq07_audit_summary", oracle(AV, f"""
SELECT *, floor(valid * 100.0 / records_processed * 100 + 0.5) / 100 AS quality_score FROM (SELECT count(*) AS records_processed, count(*) FILTER (NOT issue) AS valid, count(*) FILTER (issue) AS with_issues,
  {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in dq.CHECKS)}, epoch_us(max(ts)) AS latest_us FROM (SELECT *, {' OR '.join(dq.CHECKS)} AS issue FROM audited) x) y""", AUDIT_SQL))
def _(b):
    return dq.audit_summary(audited(b))


@query("dq07_audit_entities", oracle("customers accounts merchants devices", """
SELECT 'customers' AS measure, count(*) AS n FROM customers UNION ALL SELECT 'customers_duplicate_ids', count(*) - count(DISTINCT customer_id) FROM customers UNION ALL SELECT 'customers_incomplete', count(*) FROM customers WHERE country IS NULL OR segment IS NULL
UNION ALL SELECT 'accounts', count(*) FROM accounts UNION ALL SELECT 'accounts_missing_status', count(*) FROM accounts WHERE status IS NULL UNION ALL SELECT 'accounts_orphan_owner', count(*) FROM accounts WHERE customer_id NOT IN (SELECT customer_id FROM customers)
UNION ALL SELECT 'merchants', count(*) FROM merchants UNION ALL SELECT 'devices', count(*) FROM devices"""))
def _(b):
    return dq.audit_entities(b.customers, b.accounts, b.merchants, b.devices)


@query("dq08_quarantine", oracle(BV, "SELECT row, code, grp AS \"group\", transaction_id FROM grouped WHERE grp = 'referential'", CODED))
def _(b):
    return dq.quarantine(gated(b)).filter("group = 'referential'").orderBy(F.col("row").desc()).select("row", "code", "group", "transaction_id")


@query("dq09_seed_ledger", oracle("txn customers accounts", """
SELECT 'transactions' AS source, 9000 AS expected, count(*) AS processed, greatest(9000 - count(*), 0) AS missing FROM txn UNION ALL SELECT 'customers', 2000, count(*), greatest(2000 - count(*), 0) FROM customers UNION ALL SELECT 'accounts', NULL, count(*), NULL FROM accounts"""))
def _(b):
    return dq.seed_ledger({"transactions": b.txn, "customers": b.customers, "accounts": b.accounts}, {"transactions": 9000, "customers": 2000, "accounts": None})


@query("p13_masking", oracle("txn devices", """
SELECT CAST(transaction_id AS VARCHAR) AS id, concat(split_part(ip_address, '.', 1), '.', split_part(ip_address, '.', 2), '.x.x') AS masked FROM txn
UNION ALL SELECT concat('device-', device_id), concat(substring(sha256(CAST(device_id AS VARCHAR)), 1, 6), '…') FROM devices"""))
def _(b):
    dev = mask_entities(b.devices.withColumn("fingerprint", F.sha2(F.col("device_id").cast("string"), 256)).withColumn("value_hash", F.lit("secret")))
    assert "value_hash" not in dev.columns
    return b.txn.select(F.col("transaction_id").cast("string").alias("id"), mask_ip(F.col("ip_address")).alias("masked")).union(
        dev.select(F.concat(F.lit("device-"), F.col("device_id").cast("string")), "fingerprint"))


@query("p14_quarantine_payload", oracle(BV, """
SELECT row, concat_ws('|', transaction_id, CASE WHEN ip_address IS NULL THEN NULL WHEN ip_address LIKE '%.%.%.%' THEN concat(split_part(ip_address, '.', 1), '.', split_part(ip_address, '.', 2), '.x.x') ELSE 'masked' END, amount) AS shown FROM coded WHERE code IS NOT NULL""", CODED))
def _(b):
    q = dq.quarantine(gated(b))
    return q.select("row", F.concat_ws("|", F.col("payload")["transaction_id"], F.col("payload")["ip_address"], F.col("payload")["amount"]).alias("shown"))

"""Queries that run the streaming jobs over the events table as a file stream, to its end."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import TRIAL_RULES, GateRules
from riskloom.operators import alerts as al
from riskloom.operators import scoring as sc
from riskloom.operators.orient import legs_for, orient
from riskloom.plans import casework, dataquality, risk
from riskloom.plans.registry import oracle, query
from riskloom.session import shared_dir, stage
from riskloom.sources.generated import AS_OF, BATCH, SPARK_WORDS, TXN, Bank, table
from riskloom.streaming import jobs


def stream(b: Bank, text: str = TXN) -> DataFrame:
    """The projection over the events files as a stream; its one-row maximum comes from the table."""
    static = table(b.spark, b.folder, "events")
    live = b.spark.readStream.schema(static.schema).parquet(f"{b.folder}/event[s].parquet")
    text = text.replace("(SELECT max(user_id) AS top_user FROM {events})", "(SELECT max(user_id) AS top_user FROM {events_static})")
    return b.spark.sql(text.format(**SPARK_WORDS, events="{events}", events_static="{events_static}"), events=live, events_static=static)


def folder(b: Bank, name: str) -> str:
    return f"{shared_dir(b.spark)}/{name}-{uuid.uuid4().hex}"


def drain(df: DataFrame, b: Bank, name: str, mode: str = "append") -> DataFrame:
    """Run to the end of the input into Parquet, and read the result."""
    at = folder(b, name)
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return b.spark.read.schema(df.schema).parquet(f"{at}/rows")


def drain_batches(df: DataFrame, b: Bank, at: str, run) -> None:
    q = df.writeStream.foreachBatch(run).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


@query("st01_late_rows", oracle("txn", "SELECT transaction_id, ts < TIMESTAMP '2024-01-19 00:00:00' AS late FROM txn"))
def _(b):
    """The store already holds rows up to the twentieth; the whole table then arrives as a stream."""
    at = folder(b, "late")
    b.txn.filter(F.col("ts") <= F.to_timestamp(F.lit("2024-01-20 00:00:00"))).withColumn("ts", F.greatest("ts", F.to_timestamp(F.lit("2024-01-20 00:00:00")))).write.parquet(f"{at}/store/batch=-1")
    drain_batches(stream(b), b, at, jobs.late_rows(f"{at}/store", f"{at}/flagged", GateRules()))
    return b.spark.read.parquet(f"{at}/flagged").select("transaction_id", "late")


@query("st02_unique_ids", oracle("txn", "SELECT transaction_id, amount_usd FROM txn"))
def _(b):
    """Every row sent twice."""
    twice = stream(b).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return drain(jobs.unique_ids(twice), b, "unique").select("transaction_id", "amount_usd")


@query("st02_append_unseen", oracle("txn", "SELECT transaction_id, amount_usd FROM txn WHERE transaction_id % 3 <> 0"))
def _(b):
    at = folder(b, "unseen")
    b.txn.filter("transaction_id % 3 = 0").write.parquet(f"{at}/store/batch=-1")
    drain_batches(stream(b), b, at, jobs.append_unseen(f"{at}/store"))
    return b.spark.read.parquet(f"{at}/store").filter("batch >= 0").select("transaction_id", "amount_usd")


@query("st03_near_duplicates", oracle("recursive txn", "SELECT transaction_id, true AS duplicate FROM walk WHERE dup", """
sent AS (SELECT transaction_id, epoch_us(ts) AS us, concat_ws('|', coalesce(sender_account_id, -1), coalesce(receiver_account_id, -1), round(amount, 2), currency) AS k FROM txn),
line AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, transaction_id) AS rn FROM (SELECT * FROM sent UNION ALL SELECT transaction_id + 1000000000, us + 10000000, k FROM sent WHERE transaction_id % 20 = 0) z),
walk AS (SELECT k, rn, transaction_id, us AS held, false AS dup FROM line WHERE rn = 1
  UNION ALL SELECT l.k, l.rn, l.transaction_id, CASE WHEN l.us - w.held <= 60000000 THEN w.held ELSE l.us END, l.us - w.held <= 60000000 FROM walk w JOIN line l ON l.k = w.k AND l.rn = w.rn + 1)"""))
def _(b):
    """Every row, and every twentieth again ten seconds later with another id."""
    again = F.explode(F.when(F.col("transaction_id") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = stream(b).withColumn("copy", again).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("copy") * 10_000_000)).withColumn(
        "transaction_id", F.col("transaction_id") + F.col("copy") * 1_000_000_000)
    return drain(jobs.near_duplicates(rows), b, "near").filter("duplicate")


@query("st04_tumbling_activity", oracle("legs", """
SELECT start_sec, entity_id, direction, count(*) AS n, count(*) FILTER (status <> 'completed') AS failed, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) FILTER (status = 'completed') AS DOUBLE) AS usd FROM (SELECT *, sec // 86400 * 86400 AS start_sec FROM legs) x
WHERE start_sec + 86400 <= (SELECT max(epoch_us(ts)) // 1000000 FROM txn) - 86400 GROUP BY 1, 2, 3"""))
def _(b):
    """Days that the watermark has closed."""
    return drain(jobs.activity(orient(stream(b), b.accounts), "1 day"), b, "tumbling")


@query("st04_sliding_activity", oracle("legs", """
SELECT start_sec, entity_id, direction, count(*) AS n, count(*) FILTER (status <> 'completed') AS failed, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) FILTER (status = 'completed') AS DOUBLE) AS usd FROM (SELECT *, sec // 21600 * 21600 - 21600 * unnest([0, 1, 2, 3]) AS start_sec FROM legs) x
WHERE start_sec + 86400 <= (SELECT max(epoch_us(ts)) // 1000000 FROM txn) - 86400 GROUP BY 1, 2, 3"""))
def _(b):
    return drain(jobs.activity(orient(stream(b), b.accounts), "24 hours", "6 hours"), b, "sliding")


@query("st05_bursts", oracle("txn", """
SELECT sender_account_id AS entity_id, sec, in_window FROM (SELECT sender_account_id, sec, max(c) AS in_window FROM (SELECT sender_account_id, sec, count(*) OVER (PARTITION BY sender_account_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS c
  FROM (SELECT *, epoch_us(ts) // 1000000 AS sec FROM txn WHERE sender_account_id IS NOT NULL) a) x GROUP BY 1, 2) y WHERE in_window >= 2"""))
def _(b):
    return drain(jobs.bursts(stream(b).withColumn("entity_id", F.col("sender_account_id")), 60, 2), b, "bursts").drop("usd")


@query("st05_structuring", oracle("legs", """
SELECT entity_id, sec, max(c) AS in_window, CAST(max(s) AS DOUBLE) AS usd FROM (
  SELECT entity_id, sec, count(*) OVER w AS c, sum(CAST(amount_usd AS DECIMAL(18,2))) OVER w AS s FROM legs
  WHERE (direction = 'out' OR (direction = 'in' AND other_account IS NULL)) AND status = 'completed' AND transaction_type IN ('cash_withdrawal', 'transfer', 'deposit') AND amount_usd >= 30 AND amount_usd < 100
  WINDOW w AS (PARTITION BY entity_id ORDER BY sec RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW)) x WHERE c >= 3 AND s >= 100 GROUP BY 1, 2"""))
def _(b):
    legs = orient(stream(b), b.accounts)
    return drain(jobs.structuring(legs, 30, 100, 48, 3, 100, ("cash_withdrawal", "transfer", "deposit")), b, "structuring")


@query("st06_pass_through", oracle("recursive legs", f"""
SELECT entity_id, inbound / 100 AS inbound_usd, matched / 100 AS matched_usd, n_inbound, inbound / 100 >= {TRIAL_RULES.pass_min_usd} AND n_inbound >= {TRIAL_RULES.pass_min_count} AND matched / 100 >= {TRIAL_RULES.pass_min_ratio} * (inbound / 100) AS flagged
FROM (SELECT n.entity_id, coalesce(sum(in_c), 0) AS inbound, CAST(coalesce(sum(n_in), 0) AS BIGINT) AS n_inbound, coalesce(sum(m.cents), 0) AS matched FROM newest n
  LEFT JOIN fs ON fs.entity_id = n.entity_id AND fs.sec >= n.sec - 864000 AND n_in > 0 LEFT JOIN (SELECT entity_id, in_sec, sum(cents) AS cents FROM sl GROUP BY 1, 2) m ON m.entity_id = fs.entity_id AND m.in_sec = fs.sec GROUP BY 1) x""",
    risk.fifo_sql("entity_id", "transaction_type = 'transfer'", 86400) + ", newest AS (SELECT entity_id, max(sec) AS sec FROM fs GROUP BY 1)"))
def _(b):
    at = folder(b, "flow")
    legs = orient(stream(b), b.accounts)
    out = jobs.pass_through(legs, 24, TRIAL_RULES.pass_types, 240, TRIAL_RULES.pass_min_ratio, TRIAL_RULES.pass_min_usd, TRIAL_RULES.pass_min_count)
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/rows/batch={i}")).option(
        "checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = b.spark.read.parquet(f"{at}/rows")
    last = rows.groupBy("entity_id").agg(F.max_by(F.struct("inbound_usd", "matched_usd", "n_inbound", "flagged"), "batch").alias("x"))
    return last.select("entity_id", "x.*")


@query("st07_gate_batches", oracle(dataquality.BV, """
SELECT count(*) AS received, count(*) FILTER (code IS NULL) AS processed, count(code) AS rejected, 0 AS failed, count(*) FILTER (grp = 'duplicate') AS duplicates, count(*) FILTER (grp = 'malformed') AS malformed,
  count(*) FILTER (grp = 'referential') AS referential, count(*) FILTER (grp = 'invalid') AS invalid FROM grouped""", dataquality.CODED))
def _(b):
    at = folder(b, "gate")
    run = jobs.gate_batches(b.accounts, b.devices, b.merchants, lambda: dataquality.stored(b), at, AS_OF, dataquality.RULES)
    drain_batches(stream(b, BATCH), b, at, run)
    counts = ("received", "processed", "rejected", "failed", "duplicates", "malformed", "referential", "invalid")
    return b.spark.read.parquet(f"{at}/ledger").agg(*[F.sum(c).alias(c) for c in counts])


@query("st08_alert_batches", oracle(casework.AVIEWS, """SELECT customer_id, detector_id, action, points FROM acts WHERE customer_id IN (
  SELECT customer_id FROM accounts WHERE account_id IN (SELECT sender_account_id FROM txn UNION SELECT receiver_account_id FROM txn))""", casework.ACTIONS))
def _(b):
    """The whole table arrives as one batch, so all customers with rows are assessed, by all rules."""
    at = folder(b, "alerts")

    def assess(affected: DataFrame) -> dict[str, DataFrame]:
        legs = stage(legs_for(b.txn, b.accounts, b.period), "legs")
        f = risk.frames(b, legs=legs)
        a = sc.assess(f)
        mine = lambda df: df.join(affected.withColumnRenamed("customer_id", "entity_id"), "entity_id", "left_semi")
        evidence = stage(mine(sc.evidence(f, a.results)), "evidence")
        cited = evidence.filter("kind = 'transaction'").select(F.col("entity_id").alias("customer_id"), F.col("detector").alias("detector_id"), F.col("id").alias("transaction_id"))
        return {"contributions": mine(a.contributions), "scores": mine(a.scores), "cited": cited, "facts": al.evidence_facts(evidence, legs),
                "amounts": b.txn.select(F.col("transaction_id").cast("string").alias("transaction_id"), "amount_usd")}

    jobs.start_alerts(at, b.monitoring, casework.cites_of_alerts(b, legs_for(b.txn, b.accounts, b.period)))
    drain_batches(stream(b), b, at, jobs.alert_batches(b.accounts, assess, at, lambda _: AS_OF, casework.POLICY, casework.TRIAGE))
    return b.spark.read.parquet(f"{at}/actions").select("customer_id", "detector_id", "action", "points")

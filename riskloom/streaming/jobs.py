"""Structured Streaming forms of the late, duplicate, window, flow and gate rules."""
from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from riskloom.config import AlertPolicy, GateRules, TriageRules
from riskloom.functions.numeric import seconds
from riskloom.operators import alerts as al
from riskloom.operators import quality as dq
from riskloom.sources.dataset import new_rows

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Arbitrary state needs the RocksDB provider; it also keeps state off the heap and checkpoints changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


# ---------------------------------------------------------------------------------------------------- built-in operators
def unique_ids(txn: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """First arrival of every id within the watermark."""
    return txn.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["transaction_id"])


def activity(legs: DataFrame, length: str, slide: str | None = None, lateness: str = "24 hours") -> DataFrame:
    """Tumbling or sliding counts, failures and completed value per entity and direction."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    done = F.col("status") == "completed"
    return legs.withWatermark("ts", lateness).groupBy(w.alias("w"), "entity_id", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~done, 1)).alias("failed"), F.sum(F.when(done, F.col("amount_usd").cast("decimal(18,2)"))).cast("double").alias("usd")
    ).select(F.unix_seconds("w.start").alias("start_sec"), "entity_id", "direction", "n", "failed", "usd")


def late_rows(store: str, sink: str, rules: GateRules) -> Callable[[DataFrame, int], None]:
    """foreachBatch: rows are kept, and flagged late against the newest row stored before their batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            # only earlier batches: a repeated batch meets the same limit as the first time
            newest = spark.read.parquet(store).filter(F.col("batch") < batch_id).agg(F.max("ts").alias("m"))
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            newest = spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS m")
        limit = F.col("m") - F.expr(f"INTERVAL {rules.late_after_hours} HOURS")
        flagged = batch.crossJoin(F.broadcast(newest)).withColumn("late", F.coalesce(F.col("ts") < limit, F.lit(False))).drop("m")  # one row
        # a batch writes its own folder, so a repeated batch replaces itself
        flagged.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return run


# ------------------------------------------------------------------------------------------------------ keyed state
class Forgetting(StatefulProcessor):
    """State that goes when a key has been silent for `keep` seconds of event time."""

    keep = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def remember(self, sec: int) -> None:
        """One timer a key: `keep` after its newest row, `sec`."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer((sec + self.keep) * 1000)

    def forget(self) -> None:
        """Clear all state of the key."""

    def nothing(self) -> pd.DataFrame:
        """No rows, of the output's columns."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        yield self.nothing()

    def close(self) -> None:
        pass


class NearDuplicates(Forgetting):
    """Per (sender, receiver, amount, currency): instants of accepted rows; a row near one of them is a duplicate.

    Instants lie more than a window apart, so only the two neighbours of a row can be near it. Of a key's instants the last `KEPT`
    windows are held, and none once it has been silent for as long.
    """

    KEPT = 1440

    def __init__(self, window_seconds: int):
        self.width = window_seconds * 1_000_000
        self.keep = self.KEPT * window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getListState("seen", StructType([StructField("us", LongType())]))

    def walk(self, times: list[int], arrived: list[int]) -> tuple[list[bool], list[int]]:
        """Whether each instant, in order, is near an accepted one of its key, and the accepted ones to hold."""
        flags = []
        for us in arrived:
            at = bisect.bisect_left(times, us)
            near = any(abs(us - t) <= self.width for t in times[max(0, at - 1):at + 1])
            flags.append(near)
            if not near:
                times.insert(at, us)
        return flags, times[bisect.bisect_left(times, times[-1] - self.KEPT * self.width):]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(r[0] for r in self.seen.get()) if self.seen.exists() else []
        frame = pd.concat(list(rows)).sort_values(["us", "transaction_id"])
        flags, times = self.walk(times, frame.us.tolist())
        self.seen.put([(t,) for t in times])
        self.remember(times[-1] // 1_000_000)
        yield pd.DataFrame({"transaction_id": frame.transaction_id, "duplicate": flags})

    def forget(self) -> None:
        self.seen.clear()

    def nothing(self) -> pd.DataFrame:
        return pd.DataFrame({"transaction_id": pd.Series(dtype="int64"), "duplicate": pd.Series(dtype="bool")})


class NearDuplicateGroups(NearDuplicates):
    """The same for all keys of a bucket at once: nearly every row has a key of its own, and a state call a key costs more than the rule.

    Rows come as (k, us, transaction_id). Whenever a bucket is touched, keys that have been silent for `keep` go; the timer clears a silent bucket.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        Forgetting.init(self, handle)
        self.seen = handle.getValueState("seen", StructType([StructField("k", ArrayType(StringType())), StructField("us", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        if self.seen.exists():
            for k, us in zip(*self.seen.get(), strict=True):
                held.setdefault(k, []).append(us)
        frame = pd.concat(list(rows)).sort_values(["k", "us", "transaction_id"])
        flags = []
        for k, group in itertools.groupby(zip(frame.k.tolist(), frame.us.tolist(), strict=True), key=lambda r: r[0]):
            near, held[k] = self.walk(held.get(k, []), [us for _, us in group])
            flags += near
        newest = max(times[-1] for times in held.values())
        silent = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep * 1_000_000
        # the newest stays in any case, so that the state is never empty
        kept = [(k, us) for k, times in held.items() if times[-1] >= min(silent, newest) for us in times]
        self.seen.update(([k for k, _ in kept], [us for _, us in kept]))
        self.remember(newest // 1_000_000)
        yield pd.DataFrame({"transaction_id": frame.transaction_id, "duplicate": flags})


class Burst(Forgetting):
    """Per entity: seconds with their counts and cents; emits a row whenever the window that ends at an arrival reaches the thresholds.

    Seconds stay while a row at most `lateness` late could still count them; a late row never counts rows of its future.
    """

    def __init__(self, minutes: int, threshold: float, lateness_hours: int = 24, min_usd: float = 0.0):
        self.width, self.threshold, self.late, self.least = minutes * 60, threshold, lateness_hours * 3600, round(min_usd * 100)
        self.keep = self.width + self.late

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", StructType([StructField(c, LongType()) for c in ("sec", "n", "cents")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: [r[1], r[2]] for r in self.recent.get()} if self.recent.exists() else {}
        arrived = pd.concat(list(rows)).groupby("sec")["cents"].agg(["size", "sum"])
        for sec, n, cents in zip(arrived.index.tolist(), arrived["size"].tolist(), arrived["sum"].tolist(), strict=True):
            of = held.setdefault(sec, [0, 0])
            of[0], of[1] = of[0] + n, of[1] + cents
        times = sorted(held)
        n_upto, cents_upto = ([0, *itertools.accumulate(held[t][i] for t in times)] for i in (0, 1))
        out = []
        for sec in arrived.index.tolist():
            hi, lo = bisect.bisect_right(times, sec), bisect.bisect_left(times, sec - self.width)
            n, cents = n_upto[hi] - n_upto[lo], cents_upto[hi] - cents_upto[lo]
            if n >= self.threshold and cents >= self.least:
                out.append((key[0], sec, n, cents / 100))
        self.recent.put([(t, *held[t]) for t in times if t >= times[-1] - self.width - self.late])
        self.remember(times[-1])
        yield pd.concat([self.nothing(), pd.DataFrame(out, columns=["entity_id", "sec", "in_window", "usd"]).astype(self.KINDS)])

    KINDS = {"entity_id": "int64", "sec": "int64", "in_window": "int64", "usd": "float64"}

    def forget(self) -> None:
        self.recent.clear()

    def nothing(self) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in self.KINDS.items()})


class PassThrough(Forgetting):
    """Per entity: the credits of the last `window`, with what is left of each. Outflows draw on those of the horizon, oldest first; late credits
    take their place by time. Totals are those of the credits held, so a credit leaves them with the window.
    """

    KINDS = {"entity_id": "int64", "inbound_usd": "float64", "matched_usd": "float64", "n_inbound": "int64", "flagged": "bool"}

    def __init__(self, hours: int, window_hours: int = 240, min_ratio: float = 0.7, min_usd: float = 500.0, min_count: int = 3):
        self.horizon, self.keep = hours * 3600, window_hours * 3600
        self.min_ratio, self.min_usd, self.min_count = min_ratio, min_usd, min_count

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.credits = handle.getListState("credits", StructType([StructField(c, LongType()) for c in ("sec", "cents", "left", "newest")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = [list(r) for r in self.credits.get()] if self.credits.exists() else []
        newest = max((c[3] for c in stored), default=0)
        held = [c for c in stored if c[2] >= 0]
        frame = pd.concat(list(rows)).sort_values(["sec", "side"], kind="stable")  # 'in' before 'out' within a second
        for sec, side, cents in zip(frame.sec.tolist(), frame.side.tolist(), frame.cents.tolist(), strict=True):
            if side == "in":
                bisect.insort(held, [sec, cents, cents, 0], key=lambda c: c[0])
                continue
            at = bisect.bisect_left(held, sec - self.horizon, key=lambda c: c[0])
            while cents > 0 and at < len(held) and held[at][0] <= sec:
                take = min(cents, held[at][2])
                held[at][2] -= take
                cents -= take
                at += 1
        newest = max(newest, int(frame.sec.max()))
        held = held[bisect.bisect_left(held, newest - self.keep, key=lambda c: c[0]):]
        # a state list must not be empty: without credits one row, with nothing less than 0 left, keeps the newest second
        self.credits.put([(c[0], c[1], c[2], newest) for c in held] or [(newest, 0, -1, newest)])
        self.remember(newest)
        inbound, matched = sum(c[1] for c in held) / 100, sum(c[1] - c[2] for c in held) / 100
        flagged = inbound >= self.min_usd and len(held) >= self.min_count and matched >= self.min_ratio * inbound
        yield pd.DataFrame({"entity_id": [int(key[0])], "inbound_usd": [inbound], "matched_usd": [matched], "n_inbound": [len(held)], "flagged": [flagged]})

    def forget(self) -> None:
        self.credits.clear()

    def nothing(self) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in self.KINDS.items()})


#: Rows later than this behind the newest row of the stream are no longer taken by the stateful jobs.
LATENESS = "30 days"
#: Keys of near duplicates share state in so many buckets; fixed as long as a checkpoint lives.
BUCKETS = 4096


def cents() -> Column:
    return F.round(F.col("amount_usd").cast("decimal(18,2)") * 100).cast("long").alias("cents")


def near_duplicates(txn: DataFrame, window_seconds: int = 60, lateness: str = LATENESS) -> DataFrame:
    use_rocksdb(txn.sparkSession)
    # null and absent parties are told from others; the currency comes last, so that no other text can make the same key
    amount = F.round("amount", 2) + F.lit(0.0)
    k = F.concat_ws("|", F.coalesce("sender_account_id", F.lit(-1)), F.coalesce("receiver_account_id", F.lit(-1)), F.coalesce(amount.cast("string"), F.lit("")),
                    F.coalesce(F.concat(F.lit("="), "currency"), F.lit("")))
    rows = txn.withWatermark("ts", lateness).select("ts", "transaction_id", k.alias("k"), F.unix_micros("ts").alias("us")).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(
        NearDuplicateGroups(window_seconds), "transaction_id long, duplicate boolean", "append", "EventTime")


def bursts(rows: DataFrame, minutes: int, threshold: float, min_usd: float = 0.0, lateness: str = LATENESS) -> DataFrame:
    """(entity_id, sec, in_window, usd) whenever rows (entity_id, ts, amount_usd) of the last `minutes` reach both thresholds."""
    use_rocksdb(rows.sparkSession)
    rows = rows.withWatermark("ts", lateness).filter("entity_id IS NOT NULL").select("ts", "entity_id", seconds(F.col("ts")).alias("sec"), F.coalesce(cents(), F.lit(0)).alias("cents"))
    return rows.groupBy("entity_id").transformWithStateInPandas(Burst(minutes, threshold, min_usd=min_usd), "entity_id long, sec long, in_window long, usd double", "append", "EventTime")


def structuring(legs: DataFrame, low: float, high: float, hours: int, threshold: float, min_usd: float, types: tuple[str, ...]) -> DataFrame:
    """Several completed amounts just below a limit within `hours`: cash and transfers out, and cash in."""
    side = (F.col("direction") == "out") | ((F.col("direction") == "in") & F.col("other_account").isNull())
    return bursts(legs.filter(side & (F.col("status") == "completed") & F.col("transaction_type").isin(*types) & (F.col("amount_usd") >= low) & (F.col("amount_usd") < high)),
                  hours * 60, threshold, min_usd)


def pass_through(legs: DataFrame, hours: int, types: tuple[str, ...], window_hours: int = 240, min_ratio: float = 0.7, min_usd: float = 500.0,
                 min_count: int = 3, lateness: str = LATENESS) -> DataFrame:
    use_rocksdb(legs.sparkSession)
    side = F.when(F.col("direction") == "out", "out").when((F.col("direction") == "in") & F.col("transaction_type").isin(*types), "in")
    rows = legs.withWatermark("ts", lateness).filter("status = 'completed'").select("ts", "entity_id", "sec", cents(), side.alias("side")).filter("side IS NOT NULL")
    return rows.groupBy("entity_id").transformWithStateInPandas(
        PassThrough(hours, window_hours, min_ratio, min_usd, min_count), "entity_id long, inbound_usd double, matched_usd double, n_inbound long, flagged boolean", "update", "EventTime")


# ---------------------------------------------------------------------------------------------------------- micro-batches
def gate_batches(accounts: DataFrame, devices: DataFrame, merchants: DataFrame, store: Callable[[], DataFrame], folder: str, now: datetime,
                 rules: GateRules) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the gate once per batch, then accepted rows, quarantine and one ledger row, each in its own folder."""
    from riskloom.session import stage

    def run(batch: DataFrame, batch_id: int) -> None:
        gated = stage(dq.gate(batch, accounts, devices, merchants, store(), now, rules), f"gated{batch_id}")
        out = lambda name: f"{folder}/{name}/batch={batch_id}"
        dq.accepted(gated, f"batch-{batch_id}").write.mode("overwrite").parquet(out("accepted"))
        dq.quarantine(gated).write.mode("overwrite").parquet(out("quarantine"))
        dq.ledger(gated).write.mode("overwrite").parquet(out("ledger"))

    return run


def start_alerts(folder: str, alerts: DataFrame, cites: DataFrame) -> None:
    """Version -1 of the alert state: what is known before the first batch."""
    al.shaped(alerts, al.STATE).write.mode("overwrite").parquet(f"{folder}/alerts/version=-1")
    al.shaped(cites, al.CITES).write.mode("overwrite").parquet(f"{folder}/cites/version=-1")


def alert_state(spark, folder: str, version: int) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(", ".join(f"{c} {t}" for c, t in al.STATE.items())).parquet(f"{folder}/alerts/version={version}"),
            spark.read.schema(", ".join(f"{c} {t}" for c, t in al.CITES.items())).parquet(f"{folder}/cites/version={version}"))


def alert_batches(accounts: DataFrame, assess: Callable[[DataFrame], dict[str, DataFrame]], folder: str, clock: Callable[[int], datetime],
                  policy: AlertPolicy, rules: TriageRules) -> Callable[[DataFrame, int], None]:
    """foreachBatch: customers the batch touches are assessed, and their candidates upserted into the alert state.

    `assess` takes the affected customers and returns their `contributions`, `scores`, `cited` rows, evidence `facts` and transaction `amounts`. The
    state is a table per batch: a batch reads the version of the batch before and writes its own, so a repeated batch starts from the same alerts
    and replaces what it wrote. `clock` gives the time of a batch id, so that a repeated batch also names new alerts alike.
    """
    from riskloom.session import stage

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, as_of = batch.sparkSession, clock(batch_id)
        touched = batch.select(F.explode(F.array("sender_account_id", "receiver_account_id")).alias("account_id")).filter("account_id IS NOT NULL").distinct()
        affected = touched.join(accounts.select("account_id", "customer_id"), "account_id").select("customer_id").distinct()
        found = assess(affected)
        current, cites = alert_state(spark, folder, batch_id - 1)
        cands = al.candidates(found["contributions"], found["scores"], policy)
        cited = stage(found["cited"], "cited")
        actions = stage(al.upsert(cands, cited, current, cites, as_of, policy), "actions")
        alerts, held, events = al.applied(actions, current, cites, cited, found["facts"], al.triage_context(found["contributions"]), found["amounts"], as_of, rules)
        for name, rows in (("actions", actions), ("events", events)):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        held.write.mode("overwrite").parquet(f"{folder}/cites/version={batch_id}")
        alerts.write.mode("overwrite").parquet(f"{folder}/alerts/version={batch_id}")

    return run


def append_unseen(store: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: only rows whose id no earlier batch stored, however long ago."""
    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            held = batch.sparkSession.read.parquet(store).filter(F.col("batch") < batch_id).drop("batch")
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            held = batch.limit(0)
        new_rows(batch, held).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return run

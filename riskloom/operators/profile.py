"""Behavioural statistics of every entity in the baseline and in the window, computed the same way."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.config import Period
from riskloom.functions.numeric import money_sum, rnd
from riskloom.operators.quantiles import deviations, exact_quantiles, value_counts
from riskloom.operators.windows import rolling_max

KEYS = ["entity_id", "period"]


def is_out() -> Column:
    return F.col("direction") == "out"


def is_in() -> Column:
    return F.col("direction") == "in"


def done() -> Column:
    return F.col("status") == "completed"


def amount_stats(rows: DataFrame, keys: list[str], value: str = "amount_usd") -> DataFrame:
    """n, median, MAD x 1.4826, p95, p99, max, mean and total, each rounded to cents."""
    counts = value_counts(rows, keys, value)
    q = exact_quantiles(counts, keys, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    mad = exact_quantiles(deviations(counts, keys, q), keys, {"mad": 0.5}).select(*keys, "mad")
    sums = counts.groupBy(*keys).agg(
        F.max("v").alias("max"), F.sum(F.col("v").cast("decimal(18,2)") * F.col("n")).cast("double").alias("sum"))
    return (q.join(mad, keys).join(sums, keys).select(
        *keys, F.col("total").alias("n"), rnd(F.col("median")).alias("median"),
        rnd(F.col("mad") * 1.4826).alias("mad_sigma"), rnd(F.col("p95")).alias("p95"), rnd(F.col("p99")).alias("p99"),
        rnd(F.col("max")).alias("max"), rnd(F.col("sum") / F.col("total")).alias("mean"), rnd(F.col("sum")).alias("total_usd")))


def calendar_days(start: datetime, end: datetime) -> int:
    """Days of the inclusive calendar between two instants."""
    return (end.date() - start.date()).days + 1


def daily_stats(rows: DataFrame, period: Period) -> DataFrame:
    """Mean, population deviation and maximum of daily counts, days without rows counted as zero.

    The number of days is known, so zero days need no rows: sums of n and n^2 are enough.
    """
    per_day = rows.groupBy(*KEYS, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    days = F.when(F.col("period") == "base", F.lit(calendar_days(period.baseline_start, period.window_start))).otherwise(
        F.lit(calendar_days(period.window_start, period.end)))
    s = per_day.groupBy(*KEYS).agg(F.sum("c").alias("s1"), F.sum(F.col("c") * F.col("c")).alias("s2"),
                                   F.max("c").alias("daily_max")).withColumn("d", days)
    variance = (F.col("d") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("d") * F.col("d"))
    return s.select(*KEYS, rnd(F.col("s1") / F.col("d"), 3).alias("daily_mean"),
                    rnd(F.sqrt(variance), 3).alias("daily_std"), "daily_max")


def inbound_counterparty() -> Column:
    return F.coalesce(F.col("other_account").cast("string"), F.col("external_counterparty"), F.lit("UNKNOWN"))


def outbound_counterparty() -> Column:
    return F.coalesce(F.col("other_account").cast("string"), F.col("external_counterparty"))


def counterparties(legs: DataFrame, direction: str, types: tuple[str, ...] = ("transfer",)) -> DataFrame:
    """Distinct (entity, period, counterparty): senders of inbound rows, or beneficiaries of completed transfers."""
    if direction == "in":
        return legs.filter(is_in()).select(*KEYS, inbound_counterparty().alias("counterparty")).distinct()
    rows = legs.filter(is_out() & done() & F.col("transaction_type").isin(*types))
    return rows.select(*KEYS, outbound_counterparty().alias("counterparty")).filter("counterparty IS NOT NULL").distinct()


def distinct_counterparties(legs: DataFrame, direction: str, types: tuple[str, ...] = ("transfer",)) -> DataFrame:
    return counterparties(legs, direction, types).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def mix_counts(legs: DataFrame, columns: list[str]) -> DataFrame:
    """Outbound rows per (entity, period, combination of the categorical columns)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key")
    return legs.filter(is_out()).groupBy(*KEYS, key).agg(F.count(F.lit(1)).alias("n"))


def mix(legs: DataFrame, columns: list[str]) -> DataFrame:
    """Share of every value; the columns are small fixed vocabularies, so a group has a handful of rows."""
    w = W.partitionBy(*KEYS)
    return mix_counts(legs, columns).withColumn("share", F.col("n") / F.sum("n").over(w))


def mix_divergence(counts: DataFrame, left: str = "base", right: str = "win") -> DataFrame:
    """Jensen-Shannon divergence (base 2) of the two periods' mixes, clamped to [0, 1]."""
    both = counts.groupBy("entity_id", "key").agg(
        F.sum(F.when(F.col("period") == left, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("period") == right, F.col("n")).otherwise(0)).alias("b"))
    w = W.partitionBy("entity_id")
    tiny = F.lit(1e-12)
    both = (both.withColumn("na", F.sum("a").over(w)).withColumn("nb", F.sum("b").over(w))
            .withColumn("k", F.count(F.lit(1)).over(w)))
    p = (F.col("a") / F.col("na") + tiny) / (F.lit(1.0) + F.col("k") * tiny)
    q = (F.col("b") / F.col("nb") + tiny) / (F.lit(1.0) + F.col("k") * tiny)
    both = both.filter("na > 0 AND nb > 0").withColumn("p", p).withColumn("q", q)
    m = (F.col("p") + F.col("q")) / 2
    part = F.col("p") * F.log2(F.col("p") / m) / 2 + F.col("q") * F.log2(F.col("q") / m) / 2
    return both.groupBy("entity_id").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(part))).alias("jsd"), F.max("na").alias("n_base"),
        F.max("nb").alias("n_win"))


def peer_amounts(txn: DataFrame, accounts: DataFrame, customers: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """p50, p95, p99 of completed amounts sent by each segment's customers in [start, end).

    Rows are counted per (account, amount) before the owner and segment are joined on.
    """
    rows = txn.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)) & done()
                      & F.col("sender_account_id").isNotNull() & F.col("amount_usd").isNotNull())
    per_account = rows.groupBy(F.col("sender_account_id").alias("account_id"), F.col("amount_usd").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    segments = accounts.select("account_id", "customer_id").join(customers.select("customer_id", "segment"), "customer_id")
    counts = per_account.join(segments, "account_id").groupBy("segment", "v").agg(F.sum("n").alias("n"))
    return exact_quantiles(counts, ["segment"], {"p50_usd": 0.5, "p95_usd": 0.95, "p99_usd": 0.99}).withColumnRenamed("total", "n")


def period_days(period: Period) -> Column:
    return F.when(F.col("period") == "base", F.lit(float(max(period.baseline_days, 1)))).otherwise(
        F.lit(float(max(period.lookback_days, 1))))


def period_stats(legs: DataFrame, period: Period) -> DataFrame:
    """All measures of one (entity, period); parts are aggregated separately and meet on the same key."""
    base = legs.groupBy(*KEYS).agg(
        F.count(F.when(is_out(), 1)).alias("n_outbound"), F.count(F.when(is_in(), 1)).alias("n_inbound"),
        F.count(F.when(F.col("direction") == "internal", 1)).alias("n_internal"),
        F.count(F.when(is_out() & (F.col("status") != "completed"), 1)).alias("n_failed_outbound"))
    out_rows = legs.filter(is_out())
    out_amt = amount_stats(out_rows.filter(done()), KEYS)
    in_amt = amount_stats(legs.filter(is_in() & done()), KEYS)
    names = ["n", "median", "mad_sigma", "p95", "p99", "max", "mean", "total_usd"]
    out_amt = out_amt.select(*KEYS, *[F.col(c).alias(f"out_{c}") for c in names])
    in_amt = in_amt.select(*KEYS, *[F.col(c).alias(f"in_{c}") for c in names])
    daily = daily_stats(out_rows, period)
    burst = rolling_max(out_rows, KEYS, 3600).select(*KEYS, F.col("max_count").alias("max_outbound_60min"),
                                                     F.col("start_sec").alias("max_outbound_60min_at"))
    # countries are a vocabulary of a few hundred values, so the set is bounded; devices are counted only
    countries = (legs.filter((is_out() | is_in()) & F.col("country").isNotNull()).select(*KEYS, "country").distinct()
                 .groupBy(*KEYS).agg(F.array_sort(F.collect_list("country")).alias("countries")))
    devices = (out_rows.filter("device_id IS NOT NULL").select(*KEYS, "device_id").distinct()
               .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_devices")))
    senders = distinct_counterparties(legs, "in").withColumnRenamed("n", "distinct_inbound_counterparties")
    payees = distinct_counterparties(legs, "out").withColumnRenamed("n", "distinct_outbound_counterparties")
    channels = mix(legs, ["channel"]).groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "share")))).alias("channels"))
    types = mix(legs, ["transaction_type", "channel"]).groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "share")))).alias("type_channel_mix"))
    out = base
    for part in (out_amt, in_amt, daily, burst, countries, devices, senders, payees, channels, types):
        out = out.join(part, KEYS, "left")
    days = period_days(period)
    zero = {c: 0 for c in ("out_n", "in_n", "daily_max", "daily_mean", "daily_std", "max_outbound_60min", "n_devices",
                           "distinct_inbound_counterparties", "distinct_outbound_counterparties")}
    out = out.fillna(zero)
    return (out.withColumn("days", days)
            .withColumn("distinct_inbound_per_30d", rnd(F.col("distinct_inbound_counterparties") * 30.0 / days))
            .withColumn("distinct_outbound_per_30d", rnd(F.col("distinct_outbound_counterparties") * 30.0 / days)))


ACTIVITY_WINDOWS = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}


def activity_windows(legs: DataFrame, end: datetime, baseline_days: int,
                     windows: dict[str, int] | None = None) -> DataFrame:
    """Count, failed, volume and distinct parties in (start, end] for several lengths, with the expected outbound
    count and volume scaled from the baseline that ends where the longest window starts."""
    windows = windows or ACTIVITY_WINDOWS
    longest = end - timedelta(hours=max(windows.values()))
    base_start = longest - timedelta(days=baseline_days)
    names = F.array(*[F.when((F.col("ts") > F.lit(end - timedelta(hours=h))) & (F.col("ts") <= F.lit(end)), F.lit(w))
                      for w, h in windows.items()])
    placed = legs.filter((F.col("ts") > F.lit(base_start)) & (F.col("ts") <= F.lit(end))).withColumn(
        "window", F.explode(F.filter(F.concat(names, F.array(F.when(F.col("ts") <= F.lit(longest), "base"))),
                                     lambda x: x.isNotNull())))
    keys = ["entity_id", "window"]
    agg = placed.groupBy(*keys).agg(
        F.count(F.when(is_out(), 1)).alias("out_count"), F.count(F.when(is_out() & ~done(), 1)).alias("out_failed"),
        F.coalesce(money_sum(F.when(is_out() & done(), F.col("amount_usd"))), F.lit(0.0)).alias("out_usd"),
        F.count(F.when(is_in(), 1)).alias("in_count"), F.count(F.when(is_in() & ~done(), 1)).alias("in_failed"),
        F.coalesce(money_sum(F.when(is_in() & done(), F.col("amount_usd"))), F.lit(0.0)).alias("in_usd"))
    marked = placed.filter(F.col("window") != "base").withColumn("period", F.col("window"))
    payees = (counterparties(marked, "out").groupBy("entity_id", F.col("period").alias("window"))
              .agg(F.count(F.lit(1)).alias("distinct_beneficiaries")))
    senders = (counterparties(marked, "in").groupBy("entity_id", F.col("period").alias("window"))
               .agg(F.count(F.lit(1)).alias("distinct_senders")))
    base = agg.filter("window = 'base'").select("entity_id", F.col("out_count").alias("b_count"), F.col("out_usd").alias("b_usd"))
    scale = None
    for w, h in windows.items():
        v = F.lit(h / 24.0 / max(float(baseline_days), 1.0))
        scale = F.when(F.col("window") == w, v) if scale is None else scale.when(F.col("window") == w, v)
    out = (agg.filter("window <> 'base'").join(payees, keys, "left").join(senders, keys, "left")
           .join(base, "entity_id", "left")
           .fillna(0, ["distinct_beneficiaries", "distinct_senders", "b_count", "b_usd"])
           .withColumn("expected_count", rnd(F.col("b_count") * scale)).withColumn("expected_usd", rnd(F.col("b_usd") * scale)))
    return out.withColumn("vs_baseline", F.when(F.col("expected_count") > 0, rnd(F.col("out_count") / F.col("expected_count")))
                          ).drop("b_count", "b_usd")


def value_or_zero(df: DataFrame, *columns: str) -> DataFrame:
    return df.fillna(0, list(columns))

"""Rolling and previous-row operators whose groups stay bounded however many rows one key has."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.numeric import MONEY


def rolling(events: DataFrame, keys: Sequence[str], width: int, amount: str | None = None) -> DataFrame:
    """Count (and sum of `amount`) of events in [s, s + width] for every second s that has an event.

    Rows are first summed per (key, second); then each key's time line is cut into chunks of four widths, the head of a
    chunk being copied to the one before it. One window group thus holds at most five widths of distinct seconds, and
    a key with a third of all rows is spread over many tasks.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    if amount is not None:
        aggs.append(F.sum(F.col(amount).cast(MONEY)).alias("amount"))
    per_second = events.groupBy(*keys, "sec").agg(*aggs)
    size = 4 * width
    chunk = F.floor(F.col("sec") / size)
    copies = F.when(F.col("sec") - chunk * size < width,
                    F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own")),
                            F.struct((chunk - 1).alias("chunk"), F.lit(False).alias("own")))
                    ).otherwise(F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))))
    cut = per_second.withColumn("copy", F.explode(copies)).select("*", "copy.chunk", "copy.own").drop("copy")
    frame = W.partitionBy(*keys, "chunk").orderBy("sec").rangeBetween(0, width)
    out = cut.withColumn("in_width", F.sum("n").over(frame))
    if amount is not None:
        out = out.withColumn("amount_in_width", F.sum("amount").over(frame))
    return out.filter("own").drop("chunk", "own", "n", *(["amount"] if amount is not None else []))


def rolling_max(events: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Largest count in any window of `width` seconds and its earliest start."""
    best = F.max(F.struct("in_width", (-F.col("sec")).alias("neg")))
    return (rolling(events, keys, width).groupBy(*keys).agg(best.alias("b"))
            .select(*keys, F.col("b.in_width").alias("max_count"), (-F.col("b.neg")).alias("start_sec")))


def rolling_band(events: DataFrame, keys: Sequence[str], width: int, amount: str) -> DataFrame:
    """Window with most events, then most value, then the latest start."""
    best = F.max(F.struct("in_width", "amount_in_width", "sec"))
    return (rolling(events, keys, width, amount).groupBy(*keys).agg(best.alias("b"))
            .select(*keys, F.col("b.in_width").alias("max_count"),
                    F.col("b.amount_in_width").cast("double").alias("total_usd"), F.col("b.sec").alias("start_sec")))


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str],
                  bucket: Column, prefix: str = "prev_") -> DataFrame:
    """`lag(1)` of the `carry` columns per key, in chunks of the monotone integer `bucket` of the first order column.

    The last row of every chunk is handed to the next non-empty chunk of the key, so the result equals a lag over the
    whole key while one window group holds one chunk only.
    """
    chunked = rows.withColumn("__chunk", bucket)
    fields = list(dict.fromkeys([*order, *carry]))
    last = chunked.groupBy(*keys, "__chunk").agg(F.max(F.struct(*fields)).alias("__last"))
    by_chunk = W.partitionBy(*keys).orderBy("__chunk")
    handed = (last.withColumn("__next", F.lead("__chunk").over(by_chunk)).filter("__next IS NOT NULL")
              .select(*keys, F.col("__next").alias("__chunk"), *[F.col(f"__last.{c}").alias(c) for c in fields])
              .withColumn("__halo", F.lit(True)))
    both = chunked.withColumn("__halo", F.lit(False)).unionByName(handed, allowMissingColumns=True)
    w = W.partitionBy(*keys, "__chunk").orderBy(*order)
    for c in carry:
        both = both.withColumn(prefix + c, F.lag(c).over(w))
    return both.filter(~F.col("__halo")).drop("__halo", "__chunk")


def running_max(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, bucket: Column, name: str) -> DataFrame:
    """Largest `value` so far per key, in chunks: each chunk starts from the maximum of all earlier ones."""
    chunked = rows.withColumn("__chunk", bucket).withColumn("__v", value)
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (chunked.groupBy(*keys, "__chunk").agg(F.max("__v").alias("__m")).withColumn("__carry", F.max("__m").over(before))
               .select(*keys, "__chunk", "__carry"))
    inside = W.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (chunked.join(carried, [*keys, "__chunk"]).withColumn(name, F.greatest(F.max("__v").over(inside), "__carry"))
            .drop("__chunk", "__v", "__carry"))

"""Exact interpolated percentiles for groups of any size."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, v, n): one row per distinct value, combined on the map side; a hot key is spread over its values."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v"))
            .agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(counts: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles of `value_counts`-shaped input, one column per entry of `probs`, plus `total`.

    Values fall into logarithmic bins, of which a key has a few thousand at most. Running totals over the bins tell
    which bin holds each wanted rank; only those bins are sorted. No task sees all values of a hot key.
    """
    size = F.floor(F.log2(F.abs(F.col("v")) + 1) * 32)
    binned = counts.withColumn("bin", F.when(F.col("v") < 0, -size).otherwise(size))
    per_bin = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("bin_n"))
    order = W.partitionBy(*keys).orderBy("bin")
    per_bin = (per_bin.withColumn("upto", F.sum("bin_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
               .withColumn("total", F.sum("bin_n").over(W.partitionBy(*keys))))
    position = {name: F.lit(p) * (F.col("total") - 1) for name, p in probs.items()}
    ranks = F.array(*[f(position[name]).cast("long") for name in probs for f in (F.floor, F.ceil)])
    before = F.col("upto") - F.col("bin_n")
    wanted = per_bin.filter(F.exists(ranks, lambda r: (r >= before) & (r < F.col("upto")))).select(
        *keys, "bin", "total", before.alias("before"))
    inside = W.partitionBy(*keys, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    rows = (binned.join(wanted, [*keys, "bin"])
            .withColumn("hi_rank", F.col("before") + F.sum("n").over(inside))
            .withColumn("lo_rank", F.col("hi_rank") - F.col("n")))
    aggs = []
    for name in probs:
        for side, f in (("lo", F.floor), ("hi", F.ceil)):
            r = f(position[name]).cast("long")
            aggs.append(F.max(F.when((F.col("lo_rank") <= r) & (r < F.col("hi_rank")), F.col("v"))).alias(f"{name}__{side}"))
    picked = rows.groupBy(*keys).agg(F.max("total").alias("total"), *aggs)
    out = []
    for name in probs:
        share = position[name] - F.floor(position[name])
        out.append(F.col(f"{name}__lo") * (F.lit(1.0) - share) + F.col(f"{name}__hi") * share)
    return picked.select(*keys, "total", *[c.alias(name) for c, name in zip(out, probs)])


def deviations(counts: DataFrame, keys: Sequence[str], centre: DataFrame, column: str = "median") -> DataFrame:
    """`value_counts` of |v - centre| per key."""
    return (counts.join(centre.select(*keys, F.col(column).alias("__c")), list(keys))
            .groupBy(*keys, F.abs(F.col("v") - F.col("__c")).alias("v")).agg(F.sum("n").alias("n")))

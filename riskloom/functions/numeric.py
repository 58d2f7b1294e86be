"""Column helpers: rounding, threshold strength, bands, guarded joins and bounded top-k."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MONEY = "decimal(18,2)"


def rnd(c: Column, digits: int = 2) -> Column:
    """Round to `digits` by plain double arithmetic, so that other engines reproduce it bit for bit."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def money_sum(c: Column) -> Column:
    """Order-independent sum of a money column, returned as double."""
    return F.sum(c.cast(MONEY)).cast("double")


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts)


def strength(observed: Column, threshold: Column, ramp: float) -> Column:
    """0.5 at the threshold, 1.0 at threshold x (1 + ramp); 1.0 when the threshold is not positive."""
    excess = (observed / threshold - F.lit(1.0)) / F.lit(float(ramp))
    ramped = F.lit(0.5) + F.lit(0.5) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), excess))
    return F.when(threshold <= 0, F.lit(1.0)).otherwise(rnd(ramped, 4))


def severity(s: Column) -> Column:
    return F.when(s >= 0.85, "high").when(s >= 0.65, "medium").otherwise("low")


def ladder(value: Column, steps: Sequence[tuple[str, float]], below: str) -> Column:
    """First label whose lower bound `value` reaches."""
    out = None
    for label, bound in steps:
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return out.otherwise(below)


def lookup(c: Column, table: dict[str, float | str | None], default=None) -> Column:
    """Fixed small dictionary as a CASE expression."""
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows of every group.

    The filter sits directly on row_number(), so Spark limits each map task to k rows per group before the shuffle;
    a hot group therefore never reaches one task whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def join_optional(left: DataFrame, right: DataFrame, left_key: str, right_key: str, row_id: str) -> DataFrame:
    """Left join on a nullable key. Rows without a key are spread by their id instead of meeting in one partition."""
    spread = F.when(F.col(left_key).isNull(), F.pmod(F.xxhash64(F.col(row_id)), F.lit(4096))).otherwise(F.lit(0))
    r = right.withColumn("__spread", F.lit(0).cast("long"))
    out = left.withColumn("__null_spread", spread.cast("long")).join(
        r, (F.col(left_key) == F.col(right_key)) & (F.col("__null_spread") == F.col("__spread")), "left")
    return out.drop("__null_spread", "__spread", right_key)

"""Time-ordered circular flows found by joining transfers hop by hop."""
from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import RiskRules
from riskloom.functions.numeric import top_k
from riskloom.session import stage


def rotate_to_smallest(path: Column) -> Column:
    """Canonical rotation of a cycle: the smallest account first."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.when(at == 1, path).otherwise(F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at - 1)))


def verified_cycles(txn: DataFrame, start: datetime, end: datetime, rules: RiskRules) -> DataFrame:
    """Cycles of 2..n accounts whose transfers follow each other within the gap and the amount tolerance.

    A chain is extended to each next account by its earliest fitting transfer, so for a known cycle this is the first
    match per hop. Of one cycle the lowest rotation, then the earliest start, is kept. The hop join meets on account,
    time slice and amount bin, never on the account alone, so that a busy account is spread and few misfits are formed.
    Every hop is staged, so no hop is computed twice.
    """
    gap = rules.cycle_gap_hours * 3600
    tol = rules.cycle_tolerance
    ratio = math.log((1 + tol) / (1 - tol))
    t = (txn.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)) & (F.col("status") == "completed")
                    & F.col("sender_account_id").isNotNull() & F.col("receiver_account_id").isNotNull()
                    & (F.col("sender_account_id") != F.col("receiver_account_id")) & (F.col("amount_usd") > 0))
         .select(F.col("sender_account_id").alias("s"), F.col("receiver_account_id").alias("r"), "ts", "transaction_id",
                 "amount_usd"))
    # an account can be on a cycle only if it both sends and receives; dropping the others twice removes most dead ends
    for _ in range(2):
        senders, receivers = t.select(F.col("s").alias("a")).distinct(), t.select(F.col("r").alias("a")).distinct()
        both = senders.join(receivers, "a", "left_semi")
        t = t.join(both, t.s == both.a, "left_semi").join(both, t.r == both.a, "left_semi")
    t = stage(t, "transfers")

    def time_slice(c: Column) -> Column:
        return F.floor(F.unix_micros(c) / (gap * 1_000_000))

    def amount_bin(c: Column) -> Column:
        return F.floor(F.log(c) / ratio)

    nxt = t.select(F.col("s").alias("n_s"), F.col("r").alias("n_r"), F.col("ts").alias("n_ts"),
                   F.col("transaction_id").alias("n_id"), F.col("amount_usd").alias("n_usd"),
                   time_slice(F.col("ts")).alias("slice"), amount_bin(F.col("amount_usd")).alias("bin"))
    chains = t.select(F.array("s", "r").alias("path"), F.array("transaction_id").alias("ids"), F.col("r").alias("last"),
                      F.col("ts").alias("start_ts"), "ts", F.col("amount_usd").alias("start_usd"),
                      F.col("amount_usd").alias("usd"))
    found = None
    for length in range(2, rules.cycle_length + 1):
        lo = amount_bin(F.col("usd") * (1 - tol - 1e-9))
        hi = amount_bin(F.col("usd") * (1 + tol + 1e-9))
        probe = (chains.withColumn("slice", F.explode(F.array(time_slice(F.col("ts")), time_slice(F.col("ts")) + 1)))
                 .withColumn("bin", F.explode(F.sequence(lo, hi))))
        hop = probe.join(nxt, (F.col("last") == F.col("n_s")) & (probe.slice == nxt.slice) & (probe.bin == nxt.bin)
                         & (F.col("n_ts") > F.col("ts")) & (F.col("n_ts") <= F.col("ts") + F.expr(f"INTERVAL {gap} SECONDS"))
                         & (F.abs(F.col("n_usd") / F.col("usd") - 1) <= tol)
                         & ((F.col("n_r") == F.col("path")[0]) | ~F.array_contains("path", F.col("n_r"))))
        hop = top_k(hop.drop(probe.slice, probe.bin, nxt.slice, nxt.bin), ["path", "ids", "n_r"],
                    [F.col("n_ts"), F.col("n_id")], 1).drop("rank", "n_s")
        hop = stage(hop, f"hop{length}")
        closed = hop.filter(F.col("n_r") == F.col("path")[0]).select(
            "path", F.array_append("ids", F.col("n_id")).alias("ids"), "start_ts", "start_usd",
            F.col("n_usd").alias("end_usd"), F.col("n_ts").alias("end_ts"))
        found = closed if found is None else found.unionByName(closed)
        if length < rules.cycle_length:
            chains = hop.filter(F.col("n_r") != F.col("path")[0]).select(
                F.array_append("path", F.col("n_r")).alias("path"), F.array_append("ids", F.col("n_id")).alias("ids"),
                F.col("n_r").alias("last"), "start_ts", F.col("n_ts").alias("ts"), "start_usd", F.col("n_usd").alias("usd"))
    found = found.withColumn("cycle", rotate_to_smallest(F.col("path")))
    rotation = F.array_position("cycle", F.col("path")[0])
    return top_k(found.withColumn("rotation", rotation), ["cycle"],
                 [F.col("rotation"), F.col("start_ts"), F.col("ids")[0]], 1).drop("rank", "rotation", "path")

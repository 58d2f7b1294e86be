"""Isolation forest over rule metrics (Liu, Ting and Zhou 2008): trees grown per sample, scored everywhere."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.numeric import money_sum, rnd
from riskloom.operators.detectors import Frames
from riskloom.operators.profile import done, is_out

# ---- fixed values: the model's features
RATIOS = ("TRANSACTION_BURST", "VELOCITY_SPIKE", "AMOUNT_DEVIATION", "PEER_AMOUNT_DEVIATION", "RAPID_PASS_THROUGH", "FAN_IN", "GEO_NEW_COUNTRY", "IMPOSSIBLE_TRAVEL",
          "NEW_DEVICE", "DEVICE_SHARING", "SHARED_IDENTIFIER", "CIRCULAR_FLOW", "DORMANT_REACTIVATION", "HIGH_RISK_MERCHANT", "BEHAVIOURAL_SHIFT", "NETWORK_EXPOSURE")
VOLUMES = ("log_window_outbound_n", "log_window_outbound_usd", "outbound_usd_per_day_vs_baseline")
FEATURES = tuple(f"{r.lower()}_ratio" for r in RATIOS) + VOLUMES


def features(f: Frames, results: DataFrame) -> DataFrame:
    """(entity_id, one double column per feature) of every entity with a result or a leg."""
    ratio = F.when(F.col("threshold") > 0, F.log1p(F.least(F.lit(50.0), F.greatest(F.lit(0.0), F.coalesce("observed", F.lit(0.0)) / F.col("threshold"))))).otherwise(0.0)
    r = results.withColumn("x", ratio).groupBy("entity_id").agg(
        *[F.coalesce(F.max(F.when(F.col("detector") == d, F.col("x"))), F.lit(0.0)).alias(f"{d.lower()}_ratio") for d in RATIOS])
    win = F.col("period") == "win"
    v = f.legs.groupBy("entity_id").agg(
        F.count(F.when(is_out() & win, 1)).alias("n"), F.coalesce(money_sum(F.when(is_out() & done() & win, F.col("amount_usd"))), F.lit(0.0)).alias("w"),
        F.coalesce(money_sum(F.when(is_out() & done() & ~win, F.col("amount_usd"))), F.lit(0.0)).alias("b"))
    wd, bd = float(max(f.period.lookback_days, 1)), float(max(f.period.baseline_days, 1))
    v = v.select("entity_id", F.log1p(F.col("n").cast("double")).alias(VOLUMES[0]), F.log1p("w").alias(VOLUMES[1]), F.log1p((F.col("w") / wd) / F.greatest(F.col("b") / bd, F.lit(1.0))).alias(VOLUMES[2]))
    return r.join(v, "entity_id", "full").fillna(0.0)


def path_length(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2.0 * (np.log(safe - 1) + np.euler_gamma) - 2.0 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, size); feature -1 is a leaf."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent] = nodes[parent][:side] + (here,) + nodes[parent][side + 1:]
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= height or len(rows) < 2 or not len(usable):
            nodes.append((-1, 0.0, -1, -1, len(rows)))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(lo[feature], hi[feature]))
        left = x[rows, feature] <= cut
        nodes.append((feature, cut, -1, -1, len(rows)))
        todo.append((rows[~left], depth + 1, here, 3))
        todo.append((rows[left], depth + 1, here, 2))
    return nodes


def train(rows: DataFrame, trees: int = 200, sample: int = 256, seed: int = 7) -> tuple[list, int]:
    """Grow each tree on about `sample` rows chosen by a hash of (tree, entity). The forest is bounded by the parameters
    (trees x 2 x sample nodes), whatever the population."""
    population = rows.count()
    keep = int(min(1.0, sample / max(population, 1)) * (1 << 31))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("entity_id")), F.lit(1 << 31)) < keep)
    picked = rows.withColumn("tree", F.explode(chosen))
    columns = list(FEATURES)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group.tree.iloc[0])
        x = group.sort_values("entity_id")[columns].to_numpy(dtype=float)
        nodes = grow(x, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(sample, 2)))))
        return pd.DataFrame(nodes, columns=["feature", "cut", "l", "r", "size"]).assign(tree=tree, node=range(len(nodes)))

    grown = picked.groupBy("tree").applyInPandas(one, "feature int, cut double, l int, r int, size int, tree int, node int").toPandas()
    return [g.sort_values("node")[["feature", "cut", "l", "r", "size"]].to_numpy() for _, g in grown.groupby("tree")], min(sample, population)


def score(rows: DataFrame, forest: list, sample: int) -> DataFrame:
    """(entity_id, anomaly): 2^(-mean depth / expected depth), rounded to four digits."""
    held = rows.sparkSession.sparkContext.broadcast(forest)
    norm = float(path_length(sample)) or 1.0

    @F.pandas_udf("double")
    def anomaly(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), dtype=float)
        depth = np.zeros(len(m))
        for t in held.value:
            at = np.zeros(len(m), dtype=int)
            steps = np.zeros(len(m))
            while True:
                inner = t[at, 0] >= 0
                if not inner.any():
                    break
                i = np.flatnonzero(inner)
                node = t[at[i]]
                left = m[i, node[:, 0].astype(int)] <= node[:, 1]
                at[i] = np.where(left, node[:, 2], node[:, 3]).astype(int)
                steps[i] += 1
            depth += steps + path_length(t[at, 4])
        return pd.Series(np.round(2.0 ** (-(depth / max(len(held.value), 1)) / norm), 4))

    return rows.select("entity_id", anomaly(F.array(*FEATURES)).alias("anomaly"))


def percentiles(scored: DataFrame) -> DataFrame:
    """Share of the population with a score at most as high; rounded scores have at most 10,001 values."""
    steps = scored.groupBy("anomaly").agg(F.count(F.lit(1)).alias("n"))
    upto, all_ = W.orderBy("anomaly").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    table = steps.select("anomaly", rnd(F.sum("n").over(upto) / F.sum("n").over(all_), 4).alias("percentile"))
    return scored.join(table, "anomaly")


def anomaly_results(ranked: DataFrame, threshold: float) -> DataFrame:
    """Rule rows of the model, shaped like all other results."""
    pct = F.col("percentile")
    s = rnd(F.least(F.lit(1.0), (pct - threshold) / max(1 - threshold, 1e-6)) * 0.5 + 0.5, 4)
    fired = pct >= threshold
    return ranked.select("entity_id", F.lit("ML_ANOMALY").alias("detector"), F.when(fired, "fired").otherwise("below_threshold").alias("state"), pct.alias("observed"),
                         F.lit(threshold).alias("threshold"), F.lit(None).cast("double").alias("baseline"), F.when(fired, s).alias("strength"), F.lit(None).cast("double").alias("mark"))


def top_features(rows: DataFrame, k: int = 3) -> DataFrame:
    """The features of each entity that are most standard deviations from the population mean."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES])
    j = rows.crossJoin(F.broadcast(stats))  # one row
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-9, F.col(f"s_{c}")).otherwise(1.0)
    ranked = F.sort_array(F.array(*[F.struct(rnd(F.abs(z(c)), 4).alias("a"), F.lit(-i).alias("i"), F.lit(c).alias("name"), rnd(z(c), 2).alias("z")) for i, c in enumerate(FEATURES)]), asc=False)
    return j.select("entity_id", F.posexplode(F.slice(ranked, 1, k)).alias("pos", "f")).select("entity_id", (F.col("pos") + 1).alias("rank"), "f.name", "f.z")

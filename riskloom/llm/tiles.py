"""Tiles of query blocks and shards of vectors: how both searches are spread over tasks, and how their lists are merged."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a shard and queries in a block at most (on average: both are dealt out by a hash of the id).
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: Lists that are merged into one at each level of the tree.
FAN_IN = 16


def usable(vectors: DataFrame, allow_zero: bool) -> DataFrame:
    """One vector for each id: without null ids, null vectors, null or non-finite components, empty vectors and, unless allowed, zero ones.

    If an id is repeated, the smallest of its vectors counts.
    """
    big = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    kept = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    if not allow_zero:
        kept = kept.filter(F.exists("embedding", lambda x: x != 0))
    return kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))


def matrices(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, positions, ids, matrix) for each length of vector in the table, ids ascending."""
    ids = rows.column("vec_id").to_numpy()
    lists = rows.column("embedding").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    starts = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(starts)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        at = at[np.argsort(ids[at], kind="stable")]
        yield int(d), at, ids[at], flat[starts[at][:, None] + np.arange(d)]


def first_k(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions, among the given (row, column, score) entries, of the k best of each row; ties go to the smaller id."""
    order = np.lexsort((ids[cols], -scores, rows))
    r = rows[order]
    start = np.r_[True, r[1:] != r[:-1]]
    rank = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0))
    return order[rank < k]


def deal(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Vectors with (block, shard) for each block of queries, queries with (block, shard) for each shard, and the number of shards."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, n_queries = vectors.count(), queries.count()
    shards = max(1, -(-n // SHARD_ROWS), min(2 * cores, n // 1024))
    blocks = max(1, -(-n_queries // BLOCK_ROWS))
    left = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    right = (vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    return left, right, shards


def search(vectors: DataFrame, queries: DataFrame, tile: Callable[[pa.Table, pa.Table], pa.Table], score_type: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `tile`'s lists over all shards, largest score first, ties to the smaller id."""
    left, right, shards = deal(vectors, queries)
    schema = f"query_id long, vec_id long, score {score_type}, shard int"

    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # attributes of its own: both sides come from one table
    lists = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(tile, schema)
    best = [F.col("score").desc(), F.col("vec_id").asc()]
    while shards > FAN_IN:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        node = Window.partitionBy("query_id", "shard").orderBy(*best)
        lists = lists.withColumn("rank", F.row_number().over(node)).filter(F.col("rank") <= k).drop("rank")
        shards = -(-shards // FAN_IN)
    whole = Window.partitionBy("query_id").orderBy(*best)
    return (lists.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

"""Exact search by tiled matrix products of query blocks and shards, selection inside each tile, and a tree of list merges.

Components become the integers floor(1024 * x); scores are their inner products, exact in 64 bits. A tile's product is taken in double
precision where no sum can pass 2**53, else in Python integers; sums beyond the range of a long are cut to it.

Defined results: ids or vectors that are null, and vectors with null or non-finite components, take no part; nor do empty vectors.
Vectors are compared with those of their own length. A repeated id counts once, with the smallest of its vectors. Ties go to the smaller
id. Fewer candidates than asked for are all returned; an empty table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from riskloom.llm import tiles
from riskloom.session import stage

SCALE = 1024
#: Rows of a product held at a time.
SLAB = 256


def integers(m: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * m)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-numbered rows, as doubles (below 2**53) or longs."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return a @ b.T
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def tile(k: int):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and shard.num_rows:
            theirs = {d: (ids, integers(m)) for d, _, ids, m in tiles.matrices(shard)}
            for d, _, q_ids, q in tiles.matrices(queries):
                if d not in theirs:
                    continue
                ids, x = theirs[d]
                q = integers(q)
                for i in range(0, len(q), SLAB):
                    scores, own = products(q[i:i + SLAB], x), q_ids[i:i + SLAB]
                    # the k best and the query itself: what ties with the last of them stays until ids decide
                    last = np.partition(scores, max(0, len(ids) - k - 1), axis=1)[:, max(0, len(ids) - k - 1)]
                    r, c = np.nonzero(scores >= last[:, None])
                    other = ids[c] != own[r]
                    r, c = r[other], c[other]
                    s = scores[r, c]
                    best = tiles.first_k(r, c, s.astype(np.int64), ids, k)
                    found.append((own[r[best]], ids[c[best]], s[best].astype(np.int64)))
        at = int(shard.column("shard")[0].as_py()) if shard.num_rows else 0
        cols = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 3)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2], "shard": np.full(len(cols[0]), at, np.int32)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k largest integer inner products of each row that `is_query` picks."""
    usable = stage(tiles.usable(vectors, allow_zero=True), "exact-vectors")
    return tiles.search(usable, usable.filter(is_query), tile(k), "long", k)

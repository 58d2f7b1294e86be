"""Approximate search by multi-index hashing over learned, rotated binary codes.

Vectors are first brought onto a sphere (a further component fills each up to the largest length, so that the largest inner product is the
nearest direction). On a sample of `SAMPLE` rows, principal components and then several rotations are learned that keep the loss of taking
signs small (iterative quantisation); the signs under all rotations are a vector's code. Codes are cut into substrings of 8 bits, and each
value of a query's substring is compared with that substring of all rows of a shard (no posting lists are kept). A search within Hamming radius R = r * m + a over m substrings probes,
by the pigeonhole principle, radius r in the first a + 1 substrings and r - 1 in the others, and so misses no code within R; codes found are
checked against R and reranked by inner products in double precision. R is the radius that holds `COVER` of the sample's true neighbours.
Queries that find fewer than k within R are searched again with the radius of all bits.

Queries meet shards in tiles (`tiles.py`); each tile computes the codes of its shard.

Defined results: ids or vectors that are null, zero vectors, empty vectors and vectors with null or non-finite components take no part.
Vectors are compared with those of their own length; lengths that the sample lacks are searched exhaustively. A repeated id counts once,
with the smallest of its vectors. Ties go to the smaller id. An empty table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import tiles
from riskloom.session import stage

SAMPLE = 20_000
ROTATIONS = 4
STEPS = 30
COVER = 0.985
SLAB = 128
POPCOUNT8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: DISTANCE[a, b]: differing bits of two substrings.
DISTANCE = POPCOUNT8[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass(frozen=True)
class Coder:
    """Codes of vectors of one length: centre, and the joined rotations (length + 1 by bits)."""

    largest: float
    centre: np.ndarray
    turn: np.ndarray
    radius: int

    def lifted(self, m: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(m, axis=1)
        if query:
            return np.c_[m / np.maximum(norm, 1e-300)[:, None], np.zeros(len(m))]
        return np.c_[m, np.sqrt(np.maximum(self.largest ** 2 - norm ** 2, 0))] / self.largest

    def codes(self, m: np.ndarray, query: bool) -> np.ndarray:
        return np.packbits((self.lifted(m, query) - self.centre) @ self.turn > 0, axis=1)


def rotations(x: np.ndarray, seed: int) -> np.ndarray:
    """Principal components of centred rows, then `ROTATIONS` learned rotations of them, side by side; a multiple of 8 columns."""
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[:64].T
    low, rng, out = x @ axes, np.random.default_rng(seed), []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(STEPS):
            u, _, v = np.linalg.svd(np.where(low @ r > 0, 1.0, -1.0).T @ low)
            r = (u @ v).T
        out.append(axes @ r)
    joined = np.hstack(out)
    return joined[:, :joined.shape[1] // 8 * 8]


def learn(ids: np.ndarray, sample: np.ndarray, largest: float, k: int, total: int, seed: int = 7) -> Coder:
    start = Coder(largest, np.zeros(sample.shape[1] + 1), np.zeros(0), 0)
    x = start.lifted(sample, False)
    coder = Coder(largest, x.mean(0), rotations(x - x.mean(0), seed), 0)
    asked = sample[:256]
    scores = asked @ sample.T
    np.fill_diagonal(scores, -np.inf)
    near = max(1, min(len(sample) - 1, round(k * len(sample) / max(total, 1))))  # as many as lie as near in all rows
    best = np.argsort(-scores, axis=1)[:, :near]
    own, theirs = coder.codes(asked, True), coder.codes(sample, False)
    off = POPCOUNT8[own[:, None, :] ^ theirs[best]].sum(2, dtype=np.int64)
    return Coder(largest, coder.centre, coder.turn, int(np.quantile(off, COVER, method="higher")))


def probed(own: np.ndarray, codes: np.ndarray, radius: int) -> np.ndarray:
    """Packed bitmap (queries by rows) of the rows that some substring probe reaches."""
    m = codes.shape[1]
    r, a = divmod(radius, m)
    hit = np.zeros((len(own), -(-len(codes) // 8)), np.uint8)
    for j in range(m):
        reach = r if j <= a else r - 1
        if reach >= 0:
            # posting bitmap of every value of the query's substring: rows whose substring lies within reach
            values, which = np.unique(own[:, j], return_inverse=True)
            hit |= np.packbits(DISTANCE[values][:, codes[:, j]] <= reach, axis=1)[which]
    return hit


def tile(coders: dict[int, Coder], k: int, everything: bool):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and shard.num_rows:
            theirs = {d: (ids, m) for d, _, ids, m in tiles.matrices(shard)}
            for d, _, q_ids, q in tiles.matrices(queries):
                if d not in theirs:
                    continue
                ids, x = theirs[d]
                coder = coders.get(d)
                own, codes = (coder.codes(q, True), coder.codes(x, False)) if coder else (None, None)
                for i in range(0, len(q), SLAB):
                    part = q[i:i + SLAB]
                    if coder is None or everything:
                        r, c = (a.ravel() for a in np.indices((len(part), len(ids))))
                    else:
                        hit = np.unpackbits(probed(own[i:i + SLAB], codes, coder.radius), axis=1, count=len(ids))
                        r, c = np.nonzero(hit)
                        off = np.zeros(len(r), np.int64)
                        words, asked = _words(codes), _words(own[i:i + SLAB])
                        for w in range(words.shape[1]):
                            off += np.bitwise_count(asked[r, w] ^ words[c, w])
                        near = off <= coder.radius
                        r, c = r[near], c[near]
                    other = ids[c] != q_ids[i + r]
                    r, c = r[other], c[other]
                    s = np.einsum("ij,ij->i", part[r], x[c])
                    best = tiles.first_k(r, c, s, ids, k)
                    found.append((q_ids[i + r[best]], ids[c[best]], s[best]))
        at = int(shard.column("shard")[0].as_py()) if shard.num_rows else 0
        kinds = (np.int64, np.int64, np.float64)
        cols = [np.concatenate([f[n] for f in found]) if found else np.zeros(0, t) for n, t in enumerate(kinds)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2], "shard": np.full(len(cols[0]), at, np.int32)})

    return run


def _words(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words, padded with zeros."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def coders(vectors: DataFrame, k: int) -> dict[int, Coder]:
    """A coder for each length of vector that the sample holds often enough to learn from."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    facts = {r["d"]: r for r in vectors.groupBy(F.size("embedding").alias("d")).agg(F.max(norm).alias("largest"), F.count("*").alias("n"))
             .orderBy(F.col("n").desc()).limit(16).collect()}
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(7))).limit(SAMPLE).toArrow()
    out = {}
    if sample.num_rows:
        for d, _, ids, m in tiles.matrices(sample):
            if len(ids) >= 64 and d in facts and np.isfinite(facts[d]["largest"]):
                shuffled = np.random.default_rng(3).permutation(len(ids))
                out[d] = learn(ids[shuffled], m[shuffled], facts[d]["largest"], k, facts[d]["n"])
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(vec_id, embedding, ...) -> query_id, rank, vec_id, score: k rows of large inner product for each row that `is_query` picks."""
    usable = stage(tiles.usable(vectors, allow_zero=False), "ann-vectors")
    queries = usable.filter(is_query)
    learned = coders(usable, k)
    found = stage(tiles.search(usable, queries, tile(learned, k, False), "double", k), "ann-found")
    lengths = usable.groupBy(F.size("embedding").alias("d")).agg((F.count("*") - 1).alias("others"))
    lacking = (queries.select("vec_id", "embedding", F.size("embedding").alias("d")).join(lengths, "d")
               .join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got")), "vec_id", "left")
               .filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), "others")).select("vec_id", "embedding"))
    lacking = stage(lacking, "ann-lacking")
    if lacking.isEmpty():
        return found
    again = tiles.search(usable, lacking, tile(learned, k, True), "double", k)
    return found.join(lacking.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)

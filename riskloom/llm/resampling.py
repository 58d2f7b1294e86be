"""Quality by importance resampling: documents that look like the target are sampled from all.

Texts become counts of hashed words and word pairs (runs of letters and digits, runs of marks; case counts). Two generative models are bags of
these buckets: one of the target's documents, one of all. A document's log-weight is the sum, over its n-grams, of the log ratio of both.
Adding Gumbel noise to the log-weights and keeping the k largest samples k documents without replacement in proportion to their weights.
The noise comes from a hash of the id, so that reruns agree. k is a share of all rows; the k-th largest key is found by counting keys in bins
and looking into one bin only.

Defined results: a null or empty text has no n-grams and log-weight 0. Rows without an id draw as the empty id; equal keys are all kept or
told apart by id, so that exactly k rows are kept unless rows repeat fully. Without target rows all weights are 0. An empty table gives an
empty table; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import hashing
from riskloom.session import stage

BUCKETS = 10_000
#: Added to each bucket's count.
SMOOTH = 1.0
BINS = 4096
#: Target ids up to this many (8 bytes each) go to every executor; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Byte kinds: white space 0, letters, digits and all of UTF-8's longer characters 1, marks 2.
KINDS = np.array([0 if b in b" \t\n\v\f\r\0" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of pairs, each with the counts at the texts' offsets."""
    h, at = hashing.tokens(data, offsets, KINDS)
    pairs, pair_at = hashing.windows(h, at, 2)
    return (h % np.uint64(BUCKETS)).astype(np.int64), at, (pairs % np.uint64(BUCKETS)).astype(np.int64), pair_at


def models(docs: DataFrame) -> np.ndarray:
    """(text, is_target) -> log ratio of target and raw probability of each bucket. All documents count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in hashing.slices(batch.column("text")):
                one, one_at, two, two_at = buckets(data, offsets)
                for values, at in ((one, one_at), (two, two_at)):
                    raw += np.bincount(values, minlength=BUCKETS)
                    target += np.bincount(values[np.repeat(chosen[first:end], np.diff(at))], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    got = (docs.select("text", "is_target").mapInArrow(run, "bucket long, raw long, target long")
           .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))).toPandas()
    counts = np.full((2, BUCKETS), SMOOTH)
    counts[0, got["bucket"]] += got["raw"]
    counts[1, got["bucket"]] += got["target"]
    if counts[1].sum() == SMOOTH * BUCKETS:
        return np.zeros(BUCKETS)
    p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, text) -> doc_id, n_grams, log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in hashing.slices(batch.column("text")):
                total, size = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
                one, one_at, two, two_at = buckets(data, offsets)
                for values, at in ((one, one_at), (two, two_at)):
                    upto = np.r_[0.0, np.cumsum(shared.value[values])]
                    total += upto[at[1:]] - upto[at[:-1]]
                    size += np.diff(at)
                sums.append(total)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(np.round(np.concatenate(sums), 6))],
                                             ["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def top_share(rows: DataFrame, key: str, k: int, tie: Column) -> DataFrame:
    """`rows` with `kept`: whether the row is among the k largest by `key`, then smallest by `tie`."""
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    above = 0
    facts = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).first()
    if k >= facts["n"]:
        return rows.withColumn("kept", F.lit(True))
    low, high = facts["low"], facts["high"]
    for _ in range(2):  # two rounds of bins: the last bin holds about one row in BINS**2 of an even spread
        width = (high - low) / BINS or 1.0
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1))
        bins = rows.filter(F.col(key).between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r["at"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    inside = F.col(key).between(low, high)
    place = F.row_number().over(Window.orderBy(F.col(key).desc(), tie))
    edge = rows.filter(inside).withColumn("kept", place <= k - above)
    return rows.filter(~inside).withColumn("kept", F.col(key) > high).unionByName(edge)


def resample(docs: DataFrame, target_ids: DataFrame, share: float, seed: int = 11) -> DataFrame:
    """(doc_id, text, ...) and (doc_id) of the target -> doc_id, n_grams, log_weight, gumbel_key, kept: `share` of all rows is kept."""
    marks = target_ids.select(F.col("doc_id").alias("target_id")).filter(F.col("target_id").isNotNull()).distinct()
    if marks.count() <= BROADCAST_IDS:
        marks = F.broadcast(marks)
    flagged = (docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("target_id"), "left")
               .withColumn("is_target", F.col("target_id").isNotNull()))
    ratio = models(flagged)
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = stage(weigh(docs, ratio).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "resample-scored")
    return top_share(scored, "gumbel_key", round(share * scored.count()), F.col("doc_id"))

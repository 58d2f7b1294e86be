"""Ranked lexical search by norm buckets (LEMP): exact top documents of each item under integer scores.

A document is the vector of the impacts of its terms, an item that of its weighted terms; each side carries the square root of a term's
weight, so that the score is their inner product. Vectors are ordered by length and cut into buckets of neighbours, the longest searched
first. For each item the score of its k-th best document so far prunes

* whole buckets: length of the item's vector times the longest length of the bucket (Cauchy-Schwarz);
* documents of a bucket: the inner product over the item's heaviest coordinates, read from the bucket's postings, plus Cauchy-Schwarz over the
  remaining ones.

What survives is scored anew from its whole vector in 64-bit integers. Buckets of a round are searched by independent tasks, which start from
the k-th scores of the rounds before and raise them as they go; each task sends at most k documents an item.

Only terms that an item names are kept of a document, as numbers; they are told by 64-bit hashes. Items are taken in blocks of bounded size, with
one pass over the documents each: a block's terms and weights are what goes to every executor.

Defined results: null texts have no terms; a null document id comes last among equal scores, a null item id is an item of its own; repeated
rows, on either side, are rows of their own; an item without a term of any document has no result; empty tables give an empty table; further
columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.hashing import SLICE, slices, tokens
from riskloom.llm.memory import tidy
from riskloom.session import stage

#: Kinds of bytes: digits, ASCII letters and every byte of a longer character make up terms; A-Z stand for a-z.
KINDS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)], np.uint8)
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Fixed parameters of the score.
SCALE, TF_FACTOR, LENGTH_FACTOR, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75
#: Text of the items in a block.
ITEM_BYTES = 16_000_000
#: Shares of the longest vectors that a round reaches down to.
ROUNDS = (1 / 64, 1 / 8, 1.0)
#: Documents in a bucket.
BUCKET_ROWS = 4096
#: Coordinates are read from postings until Cauchy-Schwarz over the others stays below this share of the k-th score.
REST_SHARE = 0.25
LAST = np.iinfo(np.int64).max
VECTOR = "doc_id long, n long, terms array<int>, tf array<int>"
IMPACT = "doc_id long, norm double, terms array<int>, x array<int>"
FOUND = "item int, item_id long, doc_id long, score long"


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[Row]]:
    """Rows (item_id, text) in blocks of about `block_bytes` of text; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        block.append(row)
        size += len(row.text) + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about `SLICE` bytes that cut no term."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and KINDS[data[end]] and KINDS[data[end - 1]]:
            end += 1
        yield data[at:end]
        at = end


def term_counts(texts: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of `texts`: first row, end row, terms of each row, then (row, place in the sorted `vocabulary`, count), sorted, of the terms found."""
    size = max(1, len(vocabulary))
    for at, end, data, offsets in slices(texts):
        parts = [(data, offsets)] if end - at > 1 or len(data) <= SLICE else [(p, np.array([0, len(p)])) for p in _pieces(data)]
        n, keys, times = np.zeros(end - at, np.int64), [], []
        for part, cuts in parts:
            h, starts = tokens(part, cuts, KINDS, FOLD)
            n += np.diff(starts)
            if len(vocabulary):
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[place] == h
                rows = np.repeat(np.arange(end - at), np.diff(starts))
                found, count = np.unique(rows[hit] * size + place[hit], return_counts=True)
                keys.append(found)
                times.append(count)
        if len(parts) > 1 and keys:
            found, back = np.unique(np.concatenate(keys), return_inverse=True)
            keys, times = [found], [np.bincount(back, np.concatenate(times)).astype(np.int64)]
        found, count = (keys[0], times[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield at, end, n, found // size, found % size, count


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """Documents (doc_id, text) with at least one term: their number of terms, and counts of those of the broadcast vocabulary."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids = batch.column(0)
            for at, end, n, rows, places, counts in term_counts(batch.column(1), known):
                keep = np.flatnonzero(n > 0)
                cuts = pa.array(np.r_[np.searchsorted(rows, keep), len(rows)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at).take(pa.array(keep)), pa.array(n[keep]),
                                                  pa.ListArray.from_arrays(cuts, pa.array(places.astype(np.int32))),
                                                  pa.ListArray.from_arrays(cuts, pa.array(counts.astype(np.int32)))], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTOR)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def impacts(counted: DataFrame, weights, documents: int, terms: int) -> DataFrame:
    """Impact of each term of a document, and the length of its vector under the broadcast weights."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.astype(np.float64)
        for batch in batches:
            places, offsets = _flat(batch.column(2))
            tf = _flat(batch.column(3))[0].astype(np.int64)
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * batch.column(1).to_numpy() * documents) // terms
            x = (SCALE * tf) // (TF_FACTOR * tf + LENGTH_FACTOR * np.repeat(m, np.diff(offsets)))
            sums = np.r_[0.0, np.cumsum(w[places] * x.astype(np.float64) ** 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(np.maximum(sums[offsets[1:]] - sums[offsets[:-1]], 0.0))), batch.column(2),
                                              pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x.astype(np.int32)))],
                                             ["doc_id", "norm", "terms", "x"])

    return counted.filter(F.size("terms") > 0).mapInArrow(run, IMPACT)


class Bucket:
    """Documents of neighbouring lengths, with postings by term."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column(0).combine_chunks().fill_null(LAST).to_numpy()
        self.norm = table.column(1).to_numpy()
        self.terms, self.offsets = _flat(table.column(2).combine_chunks())
        self.x = _flat(table.column(3).combine_chunks())[0].astype(np.int64)
        order = np.argsort(self.terms, kind="stable")
        self.by_term = self.terms[order]
        self.docs = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))[order]
        self.by_x = self.x[order].astype(np.float64)

    def survivors(self, terms: np.ndarray, counts: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
        """Rows that may score at least `least` for an item of `terms`, heaviest first, named `counts` times."""
        squares = counts.astype(np.float64) ** 2 * w[terms]
        rest = np.sqrt(np.r_[np.cumsum(squares[::-1])[::-1], 0.0])  # length of the item's vector from each coordinate on
        if rest[0] * self.norm.max() * (1 + 1e-9) < least:
            return np.zeros(0, np.int64)
        read = int(np.argmax(rest * self.norm.max() <= REST_SHARE * least)) if least > 0 else len(terms)
        lo = np.searchsorted(self.by_term, terms[:read])
        size = np.searchsorted(self.by_term, terms[:read], side="right") - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if read else np.zeros(0, np.int64)
        of_term = np.repeat(w[terms[:read]].astype(np.float64), size)
        product = np.bincount(self.docs[at], of_term * np.repeat(counts[:read], size) * self.by_x[at], len(self.ids))
        seen = np.bincount(self.docs[at], of_term * self.by_x[at] ** 2, len(self.ids))
        # rounding of the squares is relative to the whole length, not to what is left of it
        left = np.sqrt(np.maximum(self.norm ** 2 * (1 + 1e-9) - seen, 0.0))
        return np.flatnonzero((product + rest[read] * left) * (1 + 1e-9) >= max(least, 1))

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Integer scores of rows under an item's weights of all terms."""
        size = self.offsets[rows + 1] - self.offsets[rows]
        at = np.repeat(self.offsets[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        sums = np.r_[0, np.cumsum(dense[self.terms[at]] * self.x[at])]
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]


def search(ordered: DataFrame, items, weights, floors, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's k best documents of each item, none that `floors` rules out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, least = weights.value, floors.value.copy()
        wanted = [(i, np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in range(len(least))]
        dense = np.zeros(len(w), np.int64)
        held: list[pa.RecordBatch] = []

        def settle() -> None:
            bucket = Bucket(pa.Table.from_batches(held))
            for i, (_, terms, counts) in enumerate(items.value):
                rows = bucket.survivors(terms, counts, w, int(least[i])) if len(terms) else terms
                if not len(rows):
                    continue
                dense[terms] = counts * w[terms]
                score = bucket.scores(rows, dense)
                dense[terms] = 0
                good = score >= max(1, least[i])
                ids, score = np.r_[wanted[i][1], bucket.ids[rows[good]]], np.r_[wanted[i][2], score[good]]
                best = np.lexsort((ids, -score))[:k]
                wanted[i] = (i, ids[best], score[best])
                if len(best) == k:
                    least[i] = max(least[i], score[best[-1]])

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= BUCKET_ROWS:
                settle()
                held.clear()
        if any(len(b) for b in held):
            settle()
        for i, ids, score in wanted:
            if len(ids):
                item = items.value[i][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array([item] * len(ids), pa.int64()),
                                                  pa.array(ids, mask=ids == LAST), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return ordered.mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _parsed(block: list[Row]) -> tuple[np.ndarray, list[tuple[int | None, np.ndarray, np.ndarray]]]:
    """(sorted vocabulary, each item's id, terms as places in it, and counts)."""
    h, _ = tokens(*_whole([r.text for r in block]), KINDS, FOLD)
    vocabulary = np.unique(h)
    items = []
    for row in block:
        of_item, _ = tokens(*_whole([row.text]), KINDS, FOLD)
        terms, counts = np.unique(np.searchsorted(vocabulary, of_item), return_counts=True)
        items.append((row.item_id, terms, counts))
    return vocabulary, items


def _whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)


def _search_block(docs: DataFrame, block: list[Row], k: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    context = spark.sparkContext
    vocabulary, parsed = _parsed(block)
    sent = [context.broadcast(vocabulary)]
    counted = stage(vectors(docs, sent[0]), "lexical-terms")
    facts = counted.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    w = np.zeros(max(1, len(vocabulary)), np.int64)
    # one row for each term of the block at most
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        w[term] = math.floor(1000 * math.log((2 * facts.documents + 2) / (2 * df + 1)))
    items = []
    for item_id, terms, counts in parsed:
        heavy = np.argsort(-(counts.astype(np.float64) ** 2 * w[terms]), kind="stable")
        heavy = heavy[w[terms[heavy]] > 0]
        items.append((item_id, terms[heavy], counts[heavy]))
    sent += [context.broadcast(w), context.broadcast(items)]
    order = [F.col("norm").desc(), F.xxhash64("doc_id", "terms")]
    plain = stage(impacts(counted, sent[1], facts.documents, facts.terms), "lexical-impacts")
    ordered = stage(plain.repartitionByRange(*order).sortWithinPartitions(*order), "lexical-ordered")
    edges = ordered.agg(F.percentile_approx("norm", [1 - s for s in ROUNDS[:-1]], 10_000)).first()[0] or [0.0] * (len(ROUNDS) - 1)
    found, floors, above = [], np.zeros(len(items), np.int64), None
    for edge in [*edges, None]:
        within = ordered if edge is None else ordered.filter(F.col("norm") >= edge)
        within = within if above is None else within.filter(F.col("norm") < above)
        sent.append(context.broadcast(floors))
        found.append(stage(best(search(within, sent[2], sent[1], sent[-1], k), k).drop("rank"), "lexical-found"))
        above = edge
        if edge is not None:  # one row for each item of the block at most
            so_far = reduce(DataFrame.unionByName, found)
            floors = floors.copy()
            for item, score in best(so_far, k).filter(F.col("rank") == k).select("item", "score").collect():
                floors[item] = score
    out = stage(best(reduce(DataFrame.unionByName, found), k).select("item_id", "rank", "doc_id", "score"), "lexical-best")
    for b in sent:
        b.destroy()
    return out


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best of `docs` (doc_id, text) for each row of `items` (item_id, text), scores above 0."""
    found = [_search_block(docs, block, k) for block in item_blocks(items, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def top_documents_sql(k: int = 10) -> str:
    """The same in DuckDB SQL, by scoring every document that shares a term."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
i AS (SELECT row_number() OVER () AS j, item_id, text FROM benchmark),
tf AS (SELECT r, doc_id, w, count(*) AS tf FROM (SELECT r, doc_id, unnest({words}) AS w FROM d) GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
tot AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM len),
df AS (SELECT w, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, tot GROUP BY w, nd),
m AS (SELECT r, 100 - {LENGTH_SHARE} + (({LENGTH_SHARE} * n * nd) // l) AS m FROM len, tot),
q AS (SELECT j, item_id, w, count(*)::BIGINT AS q FROM (SELECT j, item_id, unnest({words}) AS w FROM i) GROUP BY ALL),
s AS (SELECT j, item_id, tf.r, tf.doc_id, sum(q * weight * (({SCALE} * tf) // ({TF_FACTOR} * tf + {LENGTH_FACTOR} * m)))::BIGINT AS score
  FROM q JOIN tf USING (w) JOIN df USING (w) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER o::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= {k}"""

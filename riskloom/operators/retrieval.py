"""Keyword, vector and fused retrieval over whole corpora, for many queries at once."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from riskloom.functions.numeric import rnd, top_k
from riskloom.functions.text import STOP_WORDS, stem, tokens, words
from riskloom.session import stage

K1, B, RRF_K = 1.4, 0.75, 60


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, len, term, tf): the keyword index. Words are stemmed after they are exploded, in generated code."""
    w = docs.select("doc_id", words(F.col("text")).alias("ws")).withColumn("len", F.size("ws"))
    return w.select("doc_id", "len", F.explode("ws").alias("w")).groupBy("doc_id", "len", stem(F.col("w")).alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): repeated terms count as often as they occur."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def postings_of(docs: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """(doc_id, len, term, tf) of the given terms only: words are stemmed and filtered where they are read, and what is left is counted.

    Rows without a term count the documents themselves, so that the corpus totals need no second reading of the texts.
    """
    w = docs.select("doc_id", words(F.col("text")).alias("ws")).withColumn("len", F.size("ws"))
    rows = w.select("doc_id", "len", F.explode("ws").alias("w")).select("doc_id", "len", stem(F.col("w")).alias("term"))
    if few:
        marked = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("ws", F.array().cast("array<string>")))
        rows = w.select("doc_id", "len", F.explode(marked).alias("w")).select("doc_id", "len", stem(F.col("w")).alias("term"))
        asked = rows.join(F.broadcast(terms.withColumn("asked", F.lit(True))), "term", "left").filter("asked OR term IS NULL")
        return asked.groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    # a join that sends rows by term would bring the rows without one to one task
    whole = w.groupBy("doc_id", "len").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "len", F.lit(None).cast("string").alias("term"), "tf")
    return rows.join(terms, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")).unionByName(whole)


#: Distinct terms of all queries up to this many are sent to every executor (about 60 bytes each).
SENT_TERMS = 500_000


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Top-k documents per query. `allowed` (doc_id) restricts results, not the corpus statistics.

    Only words that a query names leave the scan, with one row a document for the corpus totals. Scores are summed per (query, document) on the map side first.
    """
    q = stage(query_terms(queries), "query-terms")
    terms = q.select("term").distinct()
    few = terms.count() <= SENT_TERMS
    read = stage(postings_of(docs, terms, few), "postings")
    size = read.filter("term IS NULL").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    hits = read.filter("term IS NOT NULL")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if allowed is not None:
        hits = hits.join(allowed, "doc_id", "left_semi")
    s = hits.join(df, "term").crossJoin(F.broadcast(size)).join(q, "term")  # corpus totals: one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = s.groupBy("query_id", "doc_id").agg(rnd(F.sum(part), 6).alias("score")).filter("score > 0")
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def query_blocks(queries: DataFrame, block_mb: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, unit vectors) of queries of one length, in blocks of about `block_mb`; the driver holds one block at a time."""
    held: dict[int, list] = {}
    for row in queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).toLocalIterator():
        if row.q is None or any(x is None for x in row.q):
            continue
        rows = held.setdefault(len(row.q), [])
        rows.append(row)
        if len(rows) * len(row.q) * 8 >= block_mb << 20:
            yield [r.query_id for r in rows], _unit(np.array([r.q for r in rows]))
            held[len(row.q)] = []
    for rows in held.values():
        if rows:
            yield [r.query_id for r in rows], _unit(np.array([r.q for r in rows], dtype=np.float64).reshape(len(rows), -1))


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_mb: int = 16) -> DataFrame:
    """Nearest vectors per query by cosine, rounded to 5 digits. `vectors` is (id, embedding, payload...), already filtered on its payload.

    Exact: each block of queries is multiplied, as a matrix, with each batch of vectors; a batch passes on its k best of a query, ties to the smaller
    id, and these lists are merged. Vectors of another length than a query's, or with null components, are no candidates; zero vectors score 0.
    """
    kind, id_kind = queries.schema["query_id"].dataType, vectors.schema["id"].dataType
    schema = StructType([StructField("query_id", kind), StructField("id", id_kind), StructField("score", DoubleType())])
    rows = vectors.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())).select("id", F.col("embedding").cast("array<double>").alias("v"))
    context, found = vectors.sparkSession.sparkContext, None
    for ids, matrix in query_blocks(queries, block_mb):
        sent = context.broadcast((ids, matrix))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for batch in batches:
                lists = batch.column(1)
                offsets = lists.offsets.to_numpy()
                at = np.flatnonzero(np.diff(offsets) == q.shape[1])
                if not len(at) or not q.shape[1]:
                    continue
                flat = lists.values.to_numpy(zero_copy_only=False)
                own = batch.column(0).take(pa.array(at))
                score = np.floor(q @ _unit(flat[offsets[at][:, None] + np.arange(q.shape[1])]).T * 1e5 + 0.5) / 1e5
                by_id = np.array(pa.compute.sort_indices(own))
                order = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :k]]
                yield pa.RecordBatch.from_arrays([pa.array([n for n in names for _ in range(order.shape[1])], to_arrow_type(kind)), own.take(pa.array(order.ravel())),
                                                  pa.array(np.take_along_axis(score, order, 1).ravel())], ["query_id", "id", "score"])

        part = stage(top_k(rows.mapInArrow(best, schema), ["query_id"], [F.col("score").desc(), F.col("id")], k), "nearest")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    return found


def fuse(semantic: DataFrame, keyword: DataFrame, k: int | None = 5) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_id, id, rank, score), both ranks kept; on equal scores the
    better semantic rank comes first. Without `k` all merged rows are ranked."""
    a = semantic.select("query_id", "id", F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"), F.lit(None).cast("int").alias("keyword_rank"), F.lit(None).cast("double").alias("keyword_score"))
    b = keyword.select("query_id", "id", F.lit(None).cast("int").alias("semantic_rank"), F.lit(None).cast("double").alias("semantic_score"), F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    m = a.unionByName(b).groupBy("query_id", "id").agg(*[F.max(c).alias(c) for c in ("semantic_rank", "semantic_score", "keyword_rank", "keyword_score")])
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    m = m.withColumn("fused", rnd(part("semantic_rank") + part("keyword_rank"), 9))
    order = [F.col("fused").desc(), F.col("semantic_rank").asc_nulls_last(), F.col("keyword_rank")]
    if k is None:
        return m.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return top_k(m, ["query_id"], order, k)


def passages_for_signals(fused: DataFrame, query_signals: DataFrame, k: int = 12) -> DataFrame:
    """Passages found for the queries of a case, each once with the rules it serves."""
    j = fused.join(query_signals, "query_id")
    m = j.groupBy("case_id", "id").agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.max("fused").alias("best"))
    return top_k(m, ["case_id"], [F.col("best").desc(), F.col("id")], k)


def _rows(parts: list[np.ndarray], ends: np.ndarray) -> list[pa.ListArray]:
    """Flat arrays as lists of one length each, row by row; `ends` are the starts of the rows and the last end."""
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p)) for p in parts]


def counted_terms(docs: DataFrame, features: int) -> DataFrame:
    """(doc_id, idx, tf) of every row: words and word pairs hashed to `features` slots, and how often each slot occurs. Counted where the text is read."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z][a-z0-9\-]+)\b"), F.lit(1))
    kept = docs.select("doc_id", F.filter(found, lambda t: ~t.isin(*STOP_WORDS)).alias("t"))
    pairs = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    slots = F.transform(F.concat("t", pairs), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, found = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            for at, to in _cuts(ends, RUN // 8):
                n = to - at
                keys, tf = np.unique(np.repeat(np.arange(n), np.diff(ends[at:to + 1])) * features + found[ends[at]:ends[to]], return_counts=True)
                of, idx = np.divmod(keys, features)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *_rows([idx.astype(np.int32), tf.astype(np.int32)], np.searchsorted(of, np.arange(n + 1)))], ["doc_id", "idx", "tf"])

    schema = StructType([docs.schema["doc_id"], StructField("idx", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))])
    return kept.select("doc_id", F.coalesce(slots, F.array().cast("array<int>")).alias("slots")).mapInArrow(count, schema)


def term_counts(docs: DataFrame, features: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, idx, tf), staged: a row for every row of `docs`, and a row for every doc_id.

    Rows with the same doc_id are one document: each has the counts of all of them. Rows without a doc_id are one document too, but carry no counts.
    Only these are brought together by doc_id; all other rows are written where they are read, in order of slots, at two or three bytes a term.
    """
    repeated = stage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        rows = stage(counted_terms(docs, features), "term-counts")
        return rows, rows
    among = lambda how: docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), how)
    single = stage(counted_terms(among("left_anti"), features), "term-counts")
    slots = counted_terms(among("left_semi"), features).select("doc_id", F.explode(F.arrays_zip("idx", "tf")).alias("x")).groupBy("doc_id", F.col("x.idx").alias("slot")).agg(F.sum("x.tf").cast("int").alias("tf"))
    packed = slots.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("slot", "tf"))).alias("x"))  # the slots of one document
    merged = stage(packed.select("doc_id", F.col("x.slot").alias("idx"), F.col("x.tf").alias("tf")), "term-counts")
    again = stage(among("left_semi").select("doc_id").join(merged, "doc_id", "left").select(
        "doc_id", F.coalesce("idx", F.array().cast("array<int>")).alias("idx"), F.coalesce("tf", F.array().cast("array<int>")).alias("tf")), "term-counts")
    return single.unionByName(again), single.unionByName(merged)


def slot_frequencies(counts: DataFrame, features: int) -> np.ndarray:
    """Documents of every slot. What comes back is one number a slot, whatever the corpus."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(features, dtype=np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=features)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["slot", "n"])

    found = counts.select("idx").mapInArrow(part, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(features, dtype=np.int64)
    n[found["slot"].to_numpy()] = found["n"].to_numpy()
    return n


def _unit_weights(slots: np.ndarray, tf: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF-IDF of documents, each of unit length."""
    w, sizes = (np.log(tf) + 1) * idf[slots], np.diff(ends)
    if len(w):
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, ends[:-1][sizes > 0])), sizes[sizes > 0])
    return w


def term_weights(docs: DataFrame, features: int) -> DataFrame:
    """(doc_id, idx, w): unit-length sublinear TF-IDF over words and word pairs, terms hashed to `features` slots, of documents with terms."""
    counts, documents = term_counts(docs, features)
    idf = np.log((counts.count() + 1) / (slot_frequencies(documents, features) + 1)) + 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, tf = batch.column(1), batch.column(2)
            ends = idx.offsets.to_numpy() - idx.offsets[0].as_py()
            lists = _rows([idx.flatten(), _unit_weights(idx.flatten().to_numpy(), tf.flatten().to_numpy(), ends, idf)], ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "idx", "w"])

    schema = StructType([docs.schema["doc_id"], StructField("idx", ArrayType(IntegerType())), StructField("w", ArrayType(DoubleType()))])
    return documents.filter("doc_id IS NOT NULL AND size(idx) > 0").mapInArrow(weigh, schema)


#: Numbers a task multiplies at a time, 8 bytes each; documents are taken in runs of so many terms times dimensions.
RUN = 1 << 22
#: Slots of a product that are sent and added as one block, columns that are worked out in one reading of the counts (a task holds the basis and its own sum
#: of so many), and terms a slot that a task should have before it sends a product of its own.
BLOCK, COLUMNS, TERMS_A_SLOT = 128, 68, 512


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and next row of runs of rows with at most `most` elements, or of one row."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def _runs(batches: Iterator[pa.RecordBatch], basis: np.ndarray, idf: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents of every (idx, w, ...) batch, or (idx, tf, ...) with `idf`: the batch, first and next row, where each document's terms begin, their
    slots and weights, and w basis by document."""
    width = basis.shape[1]
    for batch in batches:
        lists, weighed = batch.column(0), batch.column(1)
        ends, slots, w = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(), weighed.flatten().to_numpy()
        for at, to in _cuts(ends, RUN // width):
            own, i, v, z = ends[at:to + 1] - ends[at], slots[ends[at]:ends[to]], w[ends[at]:ends[to]], np.zeros((to - at, width))
            if idf is not None:
                v = _unit_weights(i, v, own, idf)
            for d in np.flatnonzero(np.diff(own)):
                np.dot(v[own[d]:own[d + 1]], basis.take(i[own[d]:own[d + 1]], axis=0), out=z[d])
            yield batch, at, to, own, i, v, z


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _accumulate(weights: DataFrame, basis: np.ndarray, idf: np.ndarray | None = None) -> np.ndarray:
    """X^T X basis, some columns at a time. Each task sums its documents into one features x columns array and emits it in blocks of slots; these are
    summed by block. What comes back is features x columns, whatever the corpus, and what was sent for it is deleted at once."""
    features, width = basis.shape
    out = np.zeros((features, width))
    rows = weights.select("idx", "w" if idf is None else "tf")

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in group["v"])
        return pa.table({"at": group["at"][:1], "v": [total.tobytes()]})

    for first in range(0, width, COLUMNS):
        here = slice(first, min(first + COLUMNS, width))
        held = weights.sparkSession.sparkContext.broadcast(np.ascontiguousarray(basis[:, here]))

        def part(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            acc, sums, terms = np.zeros(held.value.shape), np.zeros((0, 0)), np.zeros((0, 0))
            for _, _, _, own, i, v, z in _runs(batches, held.value, idf):
                longest = int(np.diff(own).max())
                if longest > len(sums):
                    sums, terms = np.empty((longest, acc.shape[1])), np.empty((longest, acc.shape[1]))
                for d in np.flatnonzero(np.diff(own)):  # a document has a slot once
                    slots, n = i[own[d]:own[d + 1]], own[d + 1] - own[d]
                    np.take(acc, slots, axis=0, out=sums[:n], mode="clip")
                    sums[:n] += np.multiply(v[own[d]:own[d + 1], None], z[d], out=terms[:n])
                    acc[slots] = sums[:n]
            for at in range(0, features, BLOCK):
                if acc[at:at + BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([acc[at:at + BLOCK].tobytes()])], ["at", "v"])

        summed = rows.mapInArrow(part, "at int, v binary").groupBy("at").applyInArrow(add, "at int, v binary")
        found = summed.toArrow()
        for at, v in zip(found["at"].to_pylist(), found["v"]):
            out[at:at + BLOCK, here] = np.frombuffer(v.as_buffer()).reshape(-1, here.stop - first)
        summed._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)  # a task sends features x columns numbers
        held.destroy()
    return out


def _orthonormal(m: np.ndarray, rows: int = 1 << 12) -> np.ndarray:
    """An orthonormal basis of the columns of `m`, which is overwritten: blocks of rows are factored in place, then their triangles, so no copy is made."""
    triangles, kept = [], []
    for at in range(0, len(m), rows):
        q, r = np.linalg.qr(m[at:at + rows])
        m[at:at + rows, :q.shape[1]] = q
        triangles.append(r)
        kept.append(r.shape[0])
    turn, first = np.linalg.qr(np.concatenate(triangles))[0], 0
    for at, k in zip(range(0, len(m), rows), kept):
        m[at:at + rows, :turn.shape[1]] = m[at:at + rows, :k] @ turn[first:first + k]
        first += k
    return np.ascontiguousarray(m[:, :turn.shape[1]])


def lsa(docs: DataFrame, dim: int = 128, features: int = 1 << 16, rounds: int = 3, seed: int = 13) -> DataFrame:
    """Latent semantic vectors (doc_id, embedding): TF-IDF, truncated SVD by randomised subspace iteration (Halko,
    Martinsson and Tropp 2011), unit length. A document without terms gets a zero vector.

    Terms are hashed, so neither a vocabulary nor anything else that grows with the corpus reaches the driver. The
    texts are read once; their counts are read once per round and once more for the projection, and weighed there.
    """
    counts, documents = term_counts(docs, features)
    of_slot = slot_frequencies(documents, features)
    idf = np.log((counts.count() + 1) / (of_slot + 1)) + 1
    few = counts.coalesce(max(1, int(of_slot.sum()) // (TERMS_A_SLOT * features)))
    product = np.random.default_rng(seed).standard_normal((features, dim + 8))
    for _ in range(rounds):
        basis = _orthonormal(product)
        del product  # overwritten; the driver holds the basis and what comes back
        product = _accumulate(few, basis, idf)
    small = basis.T @ product  # (X basis)^T (X basis): rotates the last basis to singular directions
    turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :dim]
    right = docs.sparkSession.sparkContext.broadcast(basis @ turn)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, to, _, _, _, z in _runs(batches, right.value, idf):
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, to - at), _lists(_unit(z))], ["doc_id", "embedding"])

    schema = StructType([counts.schema["doc_id"], StructField("embedding", ArrayType(DoubleType()))])
    return counts.select("idx", "tf", "doc_id").mapInArrow(project, schema)

"""Exact Jaccard join of word-shingle sets in the metric space of Jaccard distance.

Sets that are equal form a class, and the join runs over classes. Two linked sets lie within r = 1 - threshold.

1. Pivots. The first pivots are the sets {s} of a single shingle. A set's nearest pivots are those of its own shingles, all at one distance;
   an order of all shingles, rare ones first, breaks the tie, and so each set has a home among Voronoi regions. How far a linked set's home can
   be down the order is bounded: two sets within r share one of the first n - ceil(threshold * n) + 1 shingles of each. Documents are
   replicated to the regions in that window, and each linked pair meets in one of them.
   The order knows how many classes hold a shingle of small hash, which is where windows lie, and which others repeat inside the tasks' parts
   of the corpus; it only moves passages that many documents share to the end, and any order gives the same links. In the region of the first
   shingle that a linked pair shares, both sets end after at most as many shingles as they share, and so a place in a region bounds the size of
   a partner. Members without a possible partner leave the region.
2. Recursion. Inside a region, some of its members become pivots. All members are compared with them exactly. Whoever lies within r is linked;
   of two others, x and y, a link needs |d(x, p) - d(y, p)| <= r, so the next round's pivots only meet the members of a window of that width
   around the region's first pivot. Members already in one component are not compared any more, regions with one component left are done,
   and pivots, being compared with all, leave. Small regions end by comparing what is left.

A pair is compared only if its sketches allow a link: a sketch has the parity of a set's members in each of `SKETCH` bins, so two sets differ in
at least as many members as their sketches in bits. Links are exact: shingles and sets are 64-bit hashes, and intersections are counted on the
full sets, which are cut from the texts again for the classes that need them. Output is one row a document.

Defined results: null or empty texts and texts without words have an empty set, link with nothing and are their own component; a text with
fewer words than a shingle is one shingle. A null id can't name a component: the smallest id of the others does, or null. Repeated rows are one
class; an empty table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import hashing
from riskloom.llm.components import components
from riskloom.llm.memory import tidy
from riskloom.session import stage

#: Separators are the white-space bytes of ASCII; A-Z stand for a-z.
KINDS = np.array([0 if b in b" \t\n\v\f\r" else 1 for b in range(256)], np.uint8)
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Shingles counted together in a task, and the least count in such a part that is reported.
PART, LEAST = 1_500_000, 2
#: A shingle is common from this count on; the count is raised while more than `COMMON_ROWS` (8 bytes each) would be broadcast.
COMMON, COMMON_ROWS = 2, 2_000_000
#: Shingles with hashes below this are counted over the whole corpus, by 2 ** `BUCKET_BITS` ranges and their next 32 bits; reported from a count on.
COUNTED = 1 << 63
BUCKET_BITS, LEAST_COUNTED = 12, 4
LOW_BITS = np.uint64(64 - BUCKET_BITS - 32)
#: From this level (log2 of the count) on, a region is known to be large and is not counted.
HUGE_LEVEL = 15
#: Bins of a sketch; it is kept in columns of 64.
SKETCH = 512
WORDS = [f"w{i}" for i in range(SKETCH // 64)]
#: Regions of at most this many members compare all that is left.
SMALL_REGION = 24


@dataclass(frozen=True)
class Rule:
    """Link if den * |x and y| >= num * |x or y|."""

    words: int = 5
    num: int = 80
    den: int = 100

    def window(self, n: np.ndarray | int):
        """How many of a set's first shingles can be the first that a linked set shares."""
        return n - -(-n * self.num // self.den) + 1

    def reach(self, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The largest set that a set can link with, if the first shingle they share has this place in it.

        They share at most n - place, and (den + num) * shared >= num * (|x| + |y|).
        """
        return (self.den + self.num) * (n - place) // self.num - n

    def sketches_fit(self, a: Column, b: Column, bits: Column) -> Column:
        """At the threshold, (den + num) * |difference| = (den - num) * (|x| + |y|)."""
        return bits * (self.den + self.num) <= (a + b) * (self.den - self.num)

    @property
    def radius(self) -> float:
        return 1 - self.num / self.den


def sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in hashing.slices(texts):
        h, at = hashing.tokens(data, offsets, KINDS, FOLD)
        shingles, shingle_at = hashing.windows(h, at, words)
        n_words, bounds = np.diff(at).tolist(), shingle_at.tolist()
        for i, n in enumerate(n_words):
            if n >= words:
                s = np.sort(shingles[bounds[i]:bounds[i + 1]])
                yield s[np.r_[True, s[1:] != s[:-1]]]
            elif n:
                own = h[at[i]:at[i + 1]]
                yield hashing.mix(hashing.mix(own ^ hashing.OF_PLACE[:n]).sum(keepdims=True, dtype=np.uint64) ^ hashing.OF_PLACE[40 + n])
            else:
                yield own_none


own_none = np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    return int(hashing.mix(hashing.mix(s ^ hashing.OF_PLACE[32]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0].astype(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _column(values: list | np.ndarray, kind: pa.DataType, n: int) -> pa.Array:
    return pa.nulls(n, kind) if values is None else pa.array(values, kind)


SCAN = ("doc_id long, text_key long, class long, n int, shingle long, seen long, " + ", ".join(f"{w} long" for w in WORDS)
        + ", bucket int, counted binary")


def scan(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass: a row for each document (doc_id, text_key, class, n, sketch), rows (shingle, seen) for shingles that repeat in a part.

    Rows (bucket, counted) hold a part's shingles below `COUNTED`, shortened, each as often as classes of the part have it.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int64()] * len(WORDS), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in SCAN.split(", ")]

    def batch_of(*cols) -> pa.RecordBatch:
        n = next(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([_column(c, k, n) for c, k in zip(cols, kinds, strict=True)], names)

    def repeated(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shingles = np.sort(np.concatenate([own_none, *part]))
        low = int(np.searchsorted(shingles, np.uint64(COUNTED)))
        values, counts = np.unique(shingles[low:], return_counts=True)
        common = counts >= LEAST
        yield batch_of(None, None, None, None, values[common].astype(np.int64), counts[common], *[None] * (len(WORDS) + 2))
        bucket = (shingles[:low] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        short = (shingles[:low] >> LOW_BITS).astype(np.uint32)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if low else np.zeros(1, np.int64)
        data = [short[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield batch_of(*[None] * (6 + len(WORDS)), bucket[edge[:-1]], data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, met = [], 0, set()
        for batch in batches:
            classes, ns, sketches = [], [], []
            for s in sets(batch.column("text"), rule.words):
                c = class_of(s) if len(s) else None
                classes.append(c)
                ns.append(len(s))
                sketches.append(sketch(s))
                if len(s) and c not in met:
                    met.add(c)
                    part.append(s)
                    size += len(s)
            words = np.array(sketches, np.int64).reshape(len(sketches), len(WORDS))
            yield batch_of(batch.column("doc_id"), batch.column("text_key"), classes, ns, None, None, *words.T, None, None)
            if size >= PART:
                yield from repeated(part)
                part, size, met = [], 0, set()
        yield from repeated(part)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(tidy(run), SCAN)


def common_shingles(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and levels (log2 of the count) of common shingles, at most `COMMON_ROWS`; those below `COUNTED` are `shortened`."""
    in_parts = scanned.filter("seen IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= COMMON)
    counts = stage(in_parts.unionByName(counted_shingles(scanned))
                   .withColumn("level", F.floor(F.log2("seen")).cast("int")), "jaccard-common")
    at_level = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()}
    least = min(at_level, default=0)
    while sum(n for level, n in at_level.items() if level >= least) > COMMON_ROWS:
        least += 1
    got = counts.filter(F.col("level") >= least).select("shingle", F.col("level").cast("byte").alias("level")).toArrow()
    h = got.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got.column("level").to_numpy().astype(np.int8)[order]


def counted_shingles(scanned: DataFrame) -> DataFrame:
    """(shingle, seen) of shortened shingles below `COUNTED` that are seen `LEAST_COUNTED` times or more."""

    def counts_of(bucket: int, part: list[bytes]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([np.frombuffer(d, np.uint32) for d in part]), return_counts=True)
        common = counts >= LEAST_COUNTED
        shingle = (np.uint64(bucket) << np.uint64(64 - BUCKET_BITS)) | (values[common].astype(np.uint64) << LOW_BITS)
        return pa.RecordBatch.from_arrays([pa.array(shingle.astype(np.int64)), pa.array(counts[common].astype(np.int64))], ["shingle", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bucket = [], None
        for batch in batches:
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("counted").to_pylist(), strict=True):
                if b != bucket and part:
                    yield counts_of(bucket, part)
                    part = []
                bucket = b
                part.append(data)
        if part:
            yield counts_of(bucket, part)

    by_bucket = scanned.filter("bucket IS NOT NULL").select("bucket", "counted").repartition("bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(tidy(run), "shingle long, seen long")


def levels_of(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Levels of sorted shingles, 0 for those not common."""
    h, levels = common
    if not len(h):
        return np.zeros(len(s), np.int8)
    key = np.where(s < np.uint64(COUNTED), (s >> LOW_BITS) << LOW_BITS, s)
    at = np.minimum(np.searchsorted(h, key), len(h) - 1)
    return np.where(h[at] == key, levels[at], np.int8(0))


def replicate(docs: DataFrame, rule: Rule, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Each class in the regions of its window: (region, class, n, level, reach); `reach` bounds the size of a partner met there first."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            if len(met) > 200_000:
                met.clear()
            regions, classes, ns, out_levels, reaches = [], [], [], [], []
            for s in sets(batch.column("text"), rule.words):
                if not len(s):
                    continue
                c = class_of(s)
                if c in met:
                    continue
                met.add(c)
                width = rule.window(len(s))
                level = levels_of(s, shared.value)
                first = np.argsort(level, kind="stable")[:width] if level.any() else np.arange(width)
                regions.append(s[first])
                out_levels.append(level[first])
                reaches.append(rule.reach(len(s), np.arange(width)))
                classes.append(c)
                ns.append(len(s))
            sizes = [len(r) for r in regions]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own_none, *regions]).astype(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), sizes)),
                 pa.array(np.repeat(np.array(ns, np.int32), sizes)), pa.array(np.concatenate([np.zeros(0, np.int8), *out_levels]).astype(np.int32)),
                 pa.array(np.concatenate([np.zeros(0, np.int64), *reaches]).astype(np.int32))],
                ["region", "class", "n", "level", "reach"])

    return docs.select("text").mapInArrow(tidy(run), "region long, class long, n int, level int, reach int")


def shared_regions(rows: DataFrame) -> DataFrame:
    """(region, class, n, reach) of classes that may have a partner in a region; of regions with equal members the first of the order stays."""
    region = Window.partitionBy("region")
    by_size = region.orderBy("n", "class")
    smaller = by_size.rowsBetween(Window.unboundedPreceding, -1)
    # the next larger one within reach, or a smaller one within reach that reaches as far
    partner = ((F.lead("n").over(by_size) <= F.col("reach"))
               | ((F.first("n").over(smaller) <= F.col("reach")) & (F.max("reach").over(smaller) >= F.col("n"))))
    counted = (rows.filter(F.col("level") < HUGE_LEVEL).repartition("region").dropDuplicates(["region", "class"])
               .withColumn("partner", partner).filter("partner").withColumn("m", F.count("*").over(region)).filter("m > 1")
               .withColumn("members", F.bit_xor(F.xxhash64("class")).over(region)))
    counted = stage(counted.select("region", "class", "n", "reach", "m", "members"), "jaccard-regions")
    # every member's reach is the larger, the earlier the region comes in the order
    facts = counted.groupBy("region").agg(F.first("members").alias("members"), F.first("m").alias("m"), F.sum("reach").alias("reaches"))
    one = facts.groupBy("members", "m").agg(F.max(F.struct("reaches", "region")).alias("one")).select("one.region")
    huge = rows.filter(F.col("level") >= HUGE_LEVEL).select("region", "class", "n", "reach").distinct()
    return counted.join(one, "region", "left_semi").select("region", "class", "n", "reach").unionByName(huge)


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(class, shingles) of the wanted classes, each from one document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            got = []
            for s in sets(batch.column("text"), rule.words):
                c = class_of(s) if len(s) else None
                if c is not None and c not in met:
                    met.add(c)
                    got.append((c, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["class", "shingles"])

    keys = stage(classes.join(wanted, "class", "left_semi").select("rep.*"), "jaccard-keys")
    if keys.count() <= COMMON_ROWS:
        keys = F.broadcast(keys)
    texts = (docs.select(_id().alias("id"), F.xxhash64("text").alias("text_key"), "text").join(keys, ["id", "text_key"], "left_semi").select("text"))
    return texts.mapInArrow(tidy(run), "class long, shingles binary")


def _id() -> Column:
    """The id of a document, the largest number for one without."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1))


def compare(pairs: DataFrame, sets_: DataFrame) -> DataFrame:
    """(a, b) -> a, b, both, either: sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                i = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                both.append(i)
                either.append(len(s) + len(t) - i)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())],
                                             ["a", "b", "both", "either"])

    joined = (pairs.join(sets_.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
              .join(sets_.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y"))
    return joined.mapInArrow(tidy(run), "a long, b long, both long, either long").distinct()  # rows of one id and text may give a set twice


def allowed(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sketches allow a link."""
    side = {c: classes.select(F.col("class").alias(c), F.col("n").alias(f"{c}_n"), *[F.col(w).alias(f"{c}_{w}") for w in WORDS]) for c in "ab"}
    bits = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WORDS), F.lit(0))
    return pairs.join(side["a"], "a").join(side["b"], "b").filter(rule.sketches_fit(F.col("a_n"), F.col("b_n"), bits)).select("a", "b")


def join_regions(docs: DataFrame, classes: DataFrame, regions: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, both, either) that connect whatever the regions' pairs connect, and the component (node, root) of each linked class."""
    members = stage(regions.select("region", "class", "n", "reach", F.lit(None).cast("double").alias("ring")), "jaccard-members")
    known = labels = held = None
    pivots_each, turn = 1, 0
    while True:
        if labels is None:
            now = members.withColumn("root", F.col("class"))
        else:
            now = (members.join(labels, F.col("class") == F.col("node"), "left")
                   .select("region", "class", "n", "reach", "ring", F.coalesce("root", "class").alias("root")))
        # regions with one component left are done
        open_ = now.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
        now = stage(now.join(open_.select("region", "m"), "region"), "jaccard-open")
        if now.isEmpty():
            break
        order = Window.partitionBy("region").orderBy(F.xxhash64("class", F.lit(turn)), "class")
        small = F.col("m") <= SMALL_REGION if turn else F.lit(False)
        ranked = now.filter(~small).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= pivots_each)
        pivots = stage(ranked.unionByName(now.filter(small).withColumn("place", F.lit(0))), "jaccard-pivots")
        p = pivots.select("region", F.col("class").alias("p"), F.col("n").alias("p_n"), F.col("reach").alias("p_reach"), F.col("ring").alias("p_ring"), F.col("root").alias("p_root"), "place")
        near = F.col("ring").isNull() | F.col("p_ring").isNull() | (F.abs(F.col("ring") - F.col("p_ring")) <= rule.radius + 1e-9)
        linkable = (F.col("root") != F.col("p_root")) & (F.col("n") <= F.col("p_reach")) & (F.col("p_n") <= F.col("reach")) & near
        met = now.join(p, "region").filter(linkable)
        pairs = met.select(F.least("class", "p").alias("a"), F.greatest("class", "p").alias("b")).distinct()
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stage(allowed(pairs, classes, rule), "jaccard-pairs")
        if not pairs.isEmpty():
            lacking = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
            if held is not None:
                lacking = lacking.join(held.select("class"), "class", "left_anti")
            new = stage(class_sets(docs, classes, lacking, rule), "jaccard-sets")
            held = new if held is None else held.unionByName(new)
            fresh = stage(compare(pairs, held), "jaccard-compared")
            known = fresh if known is None else known.unionByName(fresh)
            labels = stage(components(known.filter(F.col("both") * rule.den >= F.col("either") * rule.num)), "jaccard-components")
        # next round: without pivots; in regions that go on, rings around the first pivot
        first = p.filter("place = 1").select("region", "p")
        rest = now.filter(~small).join(pivots.select("region", "class"), ["region", "class"], "left_anti")
        ringed = rest.join(first, "region", "left").withColumn("a", F.least("class", "p")).withColumn("b", F.greatest("class", "p"))
        if known is None:
            ringed = ringed.withColumn("d", F.lit(None).cast("double"))
        else:
            ringed = ringed.join(known.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d")), ["a", "b"], "left")
        members = stage(ringed.select("region", "class", "n", "reach", F.col("d").alias("ring")), "jaccard-members")
        turn, pivots_each = turn + 1, pivots_each * 4
    return known, labels


def near_duplicates(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, text_key, class, component, n_shingles, component_id: one row a document.

    `component` names a component by a class, null for empty sets; `component_id` by its smallest document id.
    """
    rule = rule or Rule()
    scanned = stage(scan(docs, rule), "jaccard-scan")
    documents = scanned.filter("n IS NOT NULL").select("doc_id", "text_key", "class", "n")
    classes = stage(scanned.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(_id().alias("id"), "text_key")).alias("rep"), F.first("n").alias("n"),
        *[F.first(w).alias(w) for w in WORDS]), "jaccard-classes")
    regions = stage(shared_regions(replicate(docs, rule, common_shingles(scanned))), "jaccard-shared")
    _, labels = join_regions(docs, classes, regions, rule)

    classes = classes.select("class", "least", F.col("class").alias("component"))
    if labels is not None:
        rooted = stage(classes.join(labels, F.col("class") == F.col("node"), "left").select("class", "least", "root"), "jaccard-rooted")
        of_root = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("of_root"))
        classes = rooted.join(of_root, "root", "left").select("class", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("least"),
                                                              F.coalesce("root", "class").alias("component"))
    return (documents.join(classes, "class", "left")
            .select("doc_id", "text_key", "class", "component", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")))

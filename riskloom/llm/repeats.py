"""Removal of repeated substrings: every byte covered by a string of `LENGTH` bytes that also starts anywhere else.

The suffixes that can matter are found first, then they are refined by their next symbols. No transform of a shard is built, and none are
merged; only the refinement of intervals is taken from merging such transforms.

1. Anchors. Each window of LENGTH bytes has an anchor, the leftmost of its grams with the smallest hash; equal windows have equal anchors at
   equal places. The windows of an anchor fall into two bundles by the anchor's place in them. All windows of a bundle contain its core, equal
   windows have equal cores; the bundle's hull spans all of them. Equal hulls: all their windows repeat. A core seen once: none does.
   So only bundles whose core occurs with different hulls have to be refined, one text for each different hull.
2. Merge. A task gets bundles by core, so that whatever can match meets, and holds their hulls as one array. A symbol is the hash of the next
   `STRIDE` bytes. Starting from one interval of all suffixes, each round groups hashes: suffixes with equal symbol and equal interval after it
   share the next interval, whose common prefix is STRIDE longer. Intervals of one suffix are dropped. After
   LENGTH / STRIDE rounds intervals of two suffixes or more are the repeats. No suffixes are sorted by their text.
3. A core with more than `MERGED_HULLS` hulls (a passage in a great many contexts) is not merged in one task: its bundles are cut into narrower
   ones, whose cores are longer, and go through step 1 again; bundles of one window are settled there.

The symbol is wide because a merge by single bytes takes LENGTH rounds over all suffixes of the corpus. Equality is that of 64-bit hashes.

Defined results: a null or empty text has 0 bytes, and the digest of nothing; texts shorter than LENGTH keep all; equal rows of LENGTH bytes or
more lose all bytes, as their strings start in each other. An empty table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.hashing import OF_BYTE, mix, powers
from riskloom.llm.memory import tidy
from riskloom.session import stage

LENGTH = 400
GRAM = 16
#: Window places of a bundle, by level: halves of an anchor's windows first; narrower for crowded cores, down to one window.
WIDTHS = (193, 25, 5, 1)
STRIDE = 50
MERGED_HULLS = 2000
#: Bytes of hulls merged at a time; a core's hulls stay together.
MERGE_BYTES = 1_500_000
#: Texts are scanned in blocks of this size that overlap by a window.
BLOCK = 4_000_000
#: Rows of at most about 100 bytes that may be broadcast, and keys of 8 bytes.
SMALL_ROWS, SMALL_KEYS = 200_000, 4_000_000


class Hashes:
    """Hashes of all substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(OF_BYTE[data] * self.up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` successive entries, from running minima of blocks read both ways."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def bundles(h: Hashes, size: int, first: int, last: int, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int):
    """Bundles of windows: (anchor, first window, last window, core hash, hull hash); anchor i has the windows lo[i] to hi[i].

    Only windows from `first` to `last` count.
    """
    out = []
    for place in range(0, LENGTH - GRAM + 1, width):
        a = np.maximum(lo, anchors - place - width + 1)
        b = np.minimum(hi, anchors - place)
        a, b = np.maximum(a, first), np.minimum(b, last)
        some = a <= b
        if some.any():
            a, b, q = a[some], b[some], anchors[some]
            from_, to = q - place, q - place - width + 1 + LENGTH
            seed = np.uint64(place * 4 + 1)
            core = mix(h.of(from_, to) ^ seed)
            hull = mix(h.of(a, b + LENGTH) + mix((q - a).astype(np.uint64) * np.uint64(1 << 20) + (q - b).astype(np.uint64) + seed))
            out.append((q, a, b, core, hull))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def scan_text(data: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Bundles of a whole text, block by block; positions count from the text's start."""
    at = 0
    while len(data) - at >= LENGTH:
        block = data[at:at + BLOCK + LENGTH - 1]
        h = Hashes(block)
        n = len(block) - LENGTH + 1
        q = np.arange(len(block) - GRAM + 1)
        key = (h.of(q, q + GRAM) & ~np.uint64((1 << 24) - 1)) | q.astype(np.uint64)
        anchor = (sliding_min(key, LENGTH - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        found = bundles(h, len(block), 0, n - 1, anchor[new], new, np.r_[new[1:] - 1, n - 1], WIDTHS[0])
        yield [x + at for x in found[:3]] + found[3:]
        at += BLOCK


BUNDLES = "text_key long, start long, stop long, anchor long, core long, hull long, copies long"


def scan(docs: DataFrame) -> DataFrame:
    """(text_key, text) -> a row for each bundle of each text; equal texts in one batch are one with `copies`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("text_key").to_numpy()
            _, firsts, counts = np.unique(keys, return_index=True, return_counts=True)
            texts = batch.column("text")
            for i, copies in zip(firsts.tolist(), counts.tolist(), strict=True):
                for q, a, b, core, hull in scan_text(np.frombuffer(texts[i].as_py().encode(), np.uint8)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), keys[i])), pa.array(a), pa.array(b), pa.array(q), pa.array(core.astype(np.int64)),
                         pa.array(hull.astype(np.int64)), pa.array(np.full(len(q), copies))], [f.split()[0] for f in BUNDLES.split(", ")])

    return docs.mapInArrow(tidy(run), BUNDLES)


def settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Bundles -> those whose hull occurs again (text_key, start, stop), and one row for each hull of a core that has several.

    The latter: core, hull, copies, hulls, and text_key, start, stop, anchor of one occurrence.
    """
    one = F.min(F.struct("text_key", "start", "stop", "anchor")).alias("one")
    hulls = stage(rows.groupBy("core", "hull").agg(F.sum("copies").alias("copies"), one), f"repeats-{name}-hulls")
    cores = hulls.groupBy("core").agg(F.count("*").alias("hulls")).filter("hulls > 1")
    again = hulls.filter("copies > 1").select("core", "hull")
    whole = rows.join(again, ["core", "hull"], "left_semi").select("text_key", "start", "stop")
    several = hulls.join(cores, "core").select("core", "hull", "copies", "hulls", "one.text_key", "one.start", "one.stop", "one.anchor")
    return stage(whole, f"repeats-{name}-whole"), stage(several, f"repeats-{name}-several")


def with_facts(docs: DataFrame, facts: DataFrame, n_facts: int) -> tuple[DataFrame, DataFrame]:
    """Texts that have facts, joined by text_key, and the other texts. Beyond `SMALL_ROWS` facts only texts that have some are shuffled."""
    if n_facts <= SMALL_ROWS:
        return docs.join(F.broadcast(facts), "text_key"), docs.join(F.broadcast(facts.select("text_key")), "text_key", "left_anti")
    keys = facts.select("text_key")
    if facts.count() <= SMALL_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, "text_key", "left_semi").join(facts.hint("merge"), "text_key"), docs.join(keys, "text_key", "left_anti")


def with_hulls(docs: DataFrame, several: DataFrame) -> DataFrame:
    """`several` with the bytes of its hulls, cut out of the texts."""
    spans = several.groupBy("text_key").agg(F.collect_list(F.struct("core", "hull", "copies", "hulls", "start", "stop", "anchor")).alias("spans"))
    texts, _ = with_facts(docs, stage(spans, "repeats-spans"), several.count())
    names = ["core", "hull", "copies", "hulls", "text_key", "start", "stop", "anchor", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, own in zip(batch.column("text_key").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_py().encode()
                cols = [[s[c] for s in own] for c in names[:4]] + [[key] * len(own)] + [[s[c] for s in own] for c in names[5:8]]
                data = [raw[s["start"]:s["stop"] + LENGTH] for s in own]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(data, pa.binary())], names)

    cut = texts.select("text_key", "text", "spans").mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names[:8]) + ", data binary")
    return cut.dropDuplicates(["core", "hull"])  # copies of a text cut the same


def narrower(rows: DataFrame, width: int) -> DataFrame:
    """Bundles with their hulls' bytes -> narrower bundles of the same windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c).to_pylist() for c in ("text_key", "start", "stop", "anchor", "copies", "data")}
            for key, start, stop, anchor, copies, data in zip(*at.values(), strict=True):
                h = Hashes(np.frombuffer(data, np.uint8))
                one = np.array([anchor - start])
                q, a, b, core, hull = bundles(h, len(data), 0, stop - start, one, one * 0, one * 0 + stop - start, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), key)), pa.array(a + start), pa.array(b + start), pa.array(q + start), pa.array(core.astype(np.int64)),
                     pa.array(hull.astype(np.int64)), pa.array(np.full(len(q), copies))], [f.split()[0] for f in BUNDLES.split(", ")])

    return rows.mapInArrow(tidy(run), BUNDLES)


def interleave(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (positions) that share LENGTH bytes with another, and their intervals, by refinement of the interleave of all strings.

    Strings lie in `data` from `starts` to `ends`.
    """
    h = Hashes(data)
    # suffixes with at least one symbol; a suffix's row in the tables is its position
    sizes = np.maximum(ends - starts - STRIDE + 1, 0)
    live = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    symbol = np.zeros(len(data) + STRIDE, np.uint64)
    symbol[live] = h.of(live, live + STRIDE)
    interval = np.zeros(len(data) + STRIDE, np.uint64)   # the one interval of depth 0
    inside = np.ones(len(data) + STRIDE, bool)
    bound = np.repeat(ends, ends - starts) if len(starts) else np.zeros(0, np.int64)
    string_end = np.zeros(len(data) + STRIDE, np.int64)
    string_end[np.repeat(starts - np.r_[0, np.cumsum(ends - starts)[:-1]], ends - starts) + np.arange((ends - starts).sum())] = bound
    for depth in range(STRIDE, LENGTH + 1, STRIDE):
        # a suffix goes on if what follows its symbol lies in an interval of the round before
        live = live[(live + depth <= string_end[live]) & inside[live + STRIDE]] if depth > STRIDE else live
        if not len(live):
            break
        key = mix(symbol[live] ^ mix(interval[live + STRIDE] + np.uint64(depth)))
        order = np.argsort(key, kind="stable")
        k = key[order]
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        several = np.repeat(np.diff(edge) > 1, np.diff(edge))
        live = live[order[several]]
        inside[:] = False
        inside[live] = True
        interval[live] = k[several]
    return live, interval[live]


def merge(rows: DataFrame) -> DataFrame:
    """Bundles with their hulls' bytes, by core -> runs of windows (text_key, start, stop) that repeat but whose hull occurs once."""

    def solve(part: list[tuple]) -> pa.RecordBatch:
        _, copies, keys, start, stop, data = zip(*part, strict=True)
        sizes = np.array([len(d) for d in data])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        live, intervals = interleave(np.frombuffer(b"".join(data), np.uint8), begins, ends)
        # a window's own string is the bundle that owns it; hulls overlap, and other bundles' copies of a window don't count
        owner = np.searchsorted(ends, live, side="right")
        own = live - begins[owner] <= (np.array(stop) - np.array(start))[owner]
        live, intervals, owner = live[own], intervals[own], owner[own]
        _, which, n = np.unique(intervals, return_inverse=True, return_counts=True)
        hit = (n[which] > 1) & (np.array(copies)[owner] == 1)
        p, o = live[hit], owner[hit]
        order = np.argsort(p)
        p, o = p[order], o[order]
        new = np.r_[True, (p[1:] != p[:-1] + 1) | (o[1:] != o[:-1])] if len(p) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(p) - 1] if len(p) else first
        base = (np.array(start) - begins)
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys)[o[first]]), pa.array(p[first] + base[o[first]]), pa.array(p[last] + base[o[first]])],
                                          ["text_key", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, core = [], 0, None
        for batch in batches:
            at = [batch.column(c).to_pylist() for c in ("core", "copies", "text_key", "start", "stop", "data")]
            for row in zip(*at, strict=True):
                if row[0] != core and size >= MERGE_BYTES:
                    yield solve(part)
                    part, size = [], 0
                core = row[0]
                part.append(row)
                size += len(row[5])
        if part:
            yield solve(part)

    by_core = rows.select("core", "copies", "text_key", "start", "stop", "data").repartition("core").sortWithinPartitions("core")
    return by_core.mapInArrow(tidy(run), "text_key long, start long, stop long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(text_key, text) -> runs of windows (text_key, start, stop) that start elsewhere as well."""
    rows = stage(scan(docs), "repeats-bundles")
    found = []
    for level, width in enumerate(WIDTHS):
        whole, several = settle(rows, str(level))
        found.append(whole)
        if width == 1 or several.isEmpty():
            break
        cut = stage(with_hulls(docs, several), "repeats-cut")
        found.append(stage(merge(cut.filter(F.col("hulls") <= MERGED_HULLS)), "repeats-merged"))
        crowded = cut.filter(F.col("hulls") > MERGED_HULLS)
        if crowded.isEmpty():
            break
        rows = stage(narrower(crowded, WIDTHS[level + 1]), "repeats-bundles")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256; on demand the remaining bytes as `kept`."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    long_ = keyed.filter(F.octet_length("text") >= LENGTH).select("text_key", "text")
    runs = repeated_windows(long_)
    by_text = stage(runs.groupBy("text_key").agg(F.collect_list(F.struct("start", "stop")).alias("runs")), "repeats-runs")
    n_runs = by_text.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    hit, clean = with_facts(keyed, by_text, n_runs)
    clean = clean.withColumn("runs", F.lit(None).cast(by_text.schema["runs"].dataType))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                raw = (text or "").encode()
                kept, at, spans, end = [], 0, 0, -1
                if own.is_valid:
                    starts, stops = (own.values.field(c).to_numpy() for c in ("start", "stop"))
                    order = np.argsort(starts, kind="stable")
                    for a, b in zip(starts[order].tolist(), (stops[order] + LENGTH).tolist(), strict=True):
                        if a > end:
                            spans += 1
                            kept.append(raw[at:a])
                        at = end = max(end, b)
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            if keep_text:
                arrays.append(pa.array(cols[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    return hit.select("doc_id", "text", "runs").unionByName(clean.select("doc_id", "text", "runs")).mapInArrow(tidy(run), schema)

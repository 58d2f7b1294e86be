"""Spelling variants: words grouped by searches in bidirectional FM-indexes of the vocabulary.

Two words one edit apart agree in the whole first or the whole second half of either: the edit lies in one half. So every word is searched
twice, by the two schemes of a search with one error: its first half is matched exactly from the left delimiter on and extended rightwards over
the second half with one error, and its second half is matched from the right delimiter on and extended leftwards. A partition holds an
FM-index of its delimited words for each direction, and a search is an interval of suffix ranks that each symbol narrows.

A half that is matched exactly begins (or ends) with the word's first (last) `KEY` symbols, or the whole half where that is shorter. Words are
therefore dealt out by these, so that a word is searched where its possible neighbours are indexed, and nowhere else. The indexed words of a key
beyond `KEY_WORDS` are split, and its searches sent to each part.

Forms are followed to the last by pointer doubling: counts at least double from word to form, so chains are short.

Defined results: a null text has no words, a null id counts as the empty id; repeated rows count; runs that lose a code point count as what is
left; ties go to the smaller word in code-point order; an empty table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.memory import tidy
from riskloom.session import stage

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: Of the runs, one in `NOISE` loses a code point.
NOISE = 97
#: Symbols of a half that decide where a word is indexed and searched.
KEY = 4
#: Indexed words of one key in a partition, words of a partition (on average), and searches that go on side by side.
KEY_WORDS, PART_WORDS, SIDE_BY_SIDE = 100_000, 60_000, 20_000
FOUND = "word string, n_near long, near_n long, near string"


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the vocabulary of `docs` (doc_id, text)."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % NOISE == 0, less).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).filter(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= MIN_COUNT))


def _key_length(length: Column, front: bool) -> Column:
    half = F.floor(length / 2)
    return F.least(F.lit(KEY), half if front else length - half).cast("int")


def _route(k: Column, front: bool, asks: bool) -> Column:
    part = F.substring("word", F.lit(1), k) if front else F.substring("word", F.char_length("word") - k + 1, k)
    return F.struct(F.lit(front).alias("front"), F.concat(k.cast("string"), F.lit(":"), part).alias("key"), F.lit(asks).alias("asks"))


def routes(vocabulary: DataFrame) -> DataFrame:
    """(front, key, asks, word, n): where each word is searched (asks), and where it is indexed for words of its length give or take one."""
    length, sides = F.char_length("word"), []
    for front in (True, False):
        around = F.array_distinct(F.array(*[_key_length(length + d, front) for d in (-1, 0, 1)]))
        indexed = _indexed(F.filter(around, lambda k: k <= F.char_length("word")), front)
        sides += [indexed, F.array(_route(_key_length(length, front), front, True))]
    return vocabulary.select("word", "n", F.inline(F.concat(*sides)))


def _indexed(key_lengths: Column, front: bool) -> Column:
    return F.transform(key_lengths, lambda k: _route(k, front, False))


def dealt(routed: DataFrame) -> DataFrame:
    """`routed` by partition, the indexed words of large keys split and their searches repeated for each part."""
    large = (routed.filter("NOT asks").groupBy("front", "key").agg(F.count("*").alias("words")).filter(F.col("words") > KEY_WORDS)
             .select("front", "key", F.ceil(F.col("words") / KEY_WORDS).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    part = F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), parts).cast("int")))
    split = routed.join(large, ["front", "key"], "left").select("front", "key", "asks", "word", "n", F.explode(part).alias("part"))
    spark = routed.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-routed.count() // PART_WORDS))
    return split.repartition(count, "front", "key", "part")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


class Words:
    """Words as flat symbols (from 1 on) with offsets."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.symbols = np.searchsorted(alphabet, points).astype(np.int64) + 1
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.r_[0, np.cumsum(self.length)].astype(np.int64)[:-1]

    def reversed(self) -> Words:
        """The same words, each read backwards."""
        out = object.__new__(Words)
        out.length, out.start = self.length, self.start
        out.symbols = self.symbols[_spread(self.start, self.length)[::-1]] if len(self.symbols) else self.symbols
        out.start = len(self.symbols) - self.start - self.length
        return out

    def at(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Symbol p of word q, 0 beyond its end."""
        inside = p < self.length[q]
        return np.where(inside, self.symbols[np.where(inside, self.start[q] + p, 0)], 0) if len(self.symbols) else np.zeros(len(q), np.int64)


class FmIndex:
    """Suffix ranks of delimited words; `step` narrows intervals to the suffixes that have one more symbol in front."""

    def __init__(self, words: Words, sigma: int):
        n = len(words.length)
        text = np.zeros(len(words.symbols) + n + 1, np.int64)
        begins = np.r_[0, np.cumsum(words.length + 1)]
        text[_spread(begins[:-1] + 1, words.length)] = words.symbols[_spread(words.start, words.length)]
        self.size, self.sigma, self.delimiters = len(text), sigma, n + 1
        depth, covered, rank = int(words.length.max(initial=0)) + 3, 1, text
        while True:  # ranks of prefixes of twice the length, until no pattern is longer
            both = rank * (rank.max() + 1) + np.roll(rank, -covered)
            order = np.argsort(both, kind="stable")
            sorted_ = both[order]
            new = np.r_[0, np.cumsum(sorted_[1:] != sorted_[:-1])]
            rank = np.empty_like(new)
            rank[order] = new
            covered *= 2
            if covered >= depth or new[-1] == len(text) - 1:
                break
        self.word_at = np.searchsorted(begins, order)  # right for suffixes that begin at a delimiter
        self.before = text[order - 1]
        # occurrences of each symbol in order of rank: one search gives its smaller symbols and its earlier occurrences together
        self.occurrences = np.sort(self.before * (self.size + 1) + np.arange(self.size))

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * (self.size + 1)
        return np.searchsorted(self.occurrences, base + lo), np.searchsorted(self.occurrences, base + hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, lo, hi) for every symbol but the delimiter that stands in front of a suffix of an interval."""
        width = hi - lo
        narrow, wide = np.flatnonzero(width <= self.sigma), np.flatnonzero(width > self.sigma)
        seen = np.unique(np.repeat(narrow, width[narrow]) * (self.sigma + 1) + self.before[_spread(lo[narrow], width[narrow])])
        of = np.r_[seen // (self.sigma + 1), np.repeat(wide, self.sigma)]
        symbol = np.r_[seen % (self.sigma + 1), np.tile(np.arange(1, self.sigma + 1), len(wide))]
        of, symbol = of[symbol > 0], symbol[symbol > 0]
        a, b = self.step(lo[of], hi[of], symbol)
        some = b > a
        return of[some], symbol[some], a[some], b[some]

    def one_error(self, asked: Words, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked word, indexed word) pairs that agree in the first `exact` symbols and differ by one edit after them.

        An inserted or deleted symbol of a run of equal ones counts at the run's end, so each pair comes once.
        """
        q = np.flatnonzero(asked.length > 0)
        lo, hi, p = np.zeros(len(q), np.int64), np.full(len(q), self.delimiters), np.zeros(len(q), np.int64)
        late: list[tuple[np.ndarray, ...]] = []

        def on(q: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
            lo, hi = self.step(lo, hi, asked.at(q, p))
            some = hi > lo
            return q[some], p[some] + 1, lo[some], hi[some]

        while len(q):
            open_ = p >= exact[q]
            if open_.any():
                oq, op, olo, ohi = q[open_], p[open_], lo[open_], hi[open_]
                symbol, inside = asked.at(oq, op), op < asked.length[oq]
                drop = inside & (asked.at(oq, op + 1) != symbol)
                late.append((oq[drop], op[drop] + 1, olo[drop], ohi[drop]))
                of, other, blo, bhi = self.branches(olo, ohi)
                other_ = other != symbol[of]
                of, blo, bhi = of[other_], blo[other_], bhi[other_]
                late.append((oq[of], op[of], blo, bhi))
                of, blo, bhi = of[inside[of]], blo[inside[of]], bhi[inside[of]]
                late.append((oq[of], op[of] + 1, blo, bhi))
            more = p < asked.length[q]
            q, p, lo, hi = on(q[more], p[more], lo[more], hi[more])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        q, p, lo, hi = (np.concatenate(x) for x in zip(*late, strict=True)) if late else (np.zeros(0, np.int64),) * 4
        while len(q):
            ended = p >= asked.length[q]
            end_lo, end_hi = self.step(lo[ended], hi[ended], np.zeros(int(ended.sum()), np.int64))
            whole = end_hi > end_lo
            found.append((q[ended][whole], self.word_at[end_lo[whole]]))
            q, p, lo, hi = on(q[~ended], p[~ended], lo[~ended], hi[~ended])
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _agree(a: Words, i: np.ndarray, b: Words, j: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b agree in their first symbols; b's may be shorter."""
    size = np.minimum(first, b.length[j])
    same = a.symbols[_spread(a.start[i], size)] == b.symbols[_spread(b.start[j], size)] if size.sum() else np.zeros(0, bool)
    sums = np.r_[0, np.cumsum(same)]
    ends = np.cumsum(size)
    return (sums[ends] - sums[ends - size] == first) if len(size) else np.zeros(0, bool)


def _neighbours(front: bool, rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    """Near words of the words that ask among the indexed ones of their keys, by one of the two schemes; `rows`: key, asks, word, n.

    A word may be indexed under two keys in two partitions, and a split key's words ask in several: only the own key counts.
    """
    key = pd.factorize(rows["key"])[0]
    asks = rows["asks"].to_numpy(bool)
    place, distinct = pd.factorize(rows.loc[~asks, "word"])
    names, counts = distinct.tolist(), np.zeros(len(distinct), np.int64)
    counts[place] = rows.loc[~asks, "n"]
    under = np.unique(key[~asks] * len(names) + place)
    asking = rows.assign(key=key)[asks].drop_duplicates("word")
    asked, asked_key = asking["word"].tolist(), asking["key"].to_numpy(np.int64)
    if not asked or not names:
        return
    order = np.empty(len(names), np.int64)
    order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    alphabet = np.unique(np.frombuffer("".join(names + asked).encode("utf-32-le"), np.uint32))
    known = Words(names, alphabet)
    # steps put symbols in front: going rightwards is going leftwards in words read backwards
    index = FmIndex(known.reversed() if front else known, len(alphabet))
    for at in range(0, len(asked), SIDE_BY_SIDE):
        some = asked[at:at + SIDE_BY_SIDE]
        own = Words(some, alphabet)
        half = own.length // 2
        i, j = index.one_error(own if front else own.reversed(), half if front else own.length - half)
        if not front:  # pairs that agree in the first half are found by the other scheme
            new = ~_agree(own, i, known, j, half[i])
            i, j = i[new], j[new]
        own_key = np.isin(asked_key[at + i] * len(names) + j, under)
        i, j = i[own_key], j[own_key]
        if len(i):
            by = np.lexsort((order[j], -counts[j], i))
            i, j = i[by], j[by]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array([some[x] for x in i[first]]), pa.array(np.diff(np.r_[first, len(i)])), pa.array(counts[j[first]]),
                                              pa.array([names[x] for x in j[first]])], ["word", "n_near", "near_n", "near"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words of `vocabulary` (word, n) that have near words: how many, and the most frequent one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pa.Table.from_batches(held).to_pandas()
            for front, side in rows.groupby("front"):
                yield from _neighbours(bool(front), side)

    found = dealt(stage(routes(vocabulary), "variants-routes")).select("front", "key", "asks", "word", "n").mapInArrow(run, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")))


def followed(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last form of each chain; each round doubles the steps that a row has taken."""
    current = stage(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        current = stage(current.select("word", "root").join(further, "root", "left")
                        .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        if current.filter("moved").isEmpty():
            return current.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of `docs` (doc_id, text)."""
    vocabulary = stage(words(docs), "variants-words")
    frequent = F.col("near_n") >= 2 * F.col("n")
    full = stage(vocabulary.join(near_words(vocabulary), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("near")).alias("form"),
        F.when(frequent, F.col("near_n")).alias("form_n")), "variants-forms")
    roots = followed(full.filter(F.col("form").isNotNull()))
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

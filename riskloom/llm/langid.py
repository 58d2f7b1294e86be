"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over all ways to cut it
into pieces, of the product of their probabilities; a forward pass over the word's positions adds them up. A text's score for a language is
the sum of its words' log-probabilities and the language's log-prior; the prediction is the best, its score the posterior.

Words are runs of letters in lower case, with the vocabulary's mark of a word's start. A character without a piece counts as one unknown
piece. Probabilities are learned by expectation-maximisation (forward-backward) on word counts of a sample of labelled documents: about
`SAMPLE_DOCS` for each language, drawn by a hash of the id. Every language is learned. Spark counts words and adds expected piece counts; the
driver holds the pieces that each language uses, and tables of pieces by languages exist for `BLOCK` languages at a time only, in learning and
in scoring, where the best language and the sum of the likelihoods are carried from block to block.

Defined results: `und` with score 0 for null texts, texts without a letter, and all texts if nothing was learned; a null id counts as the
empty text for the fold. Repeated rows get equal predictions; an empty table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from riskloom.llm.memory import tidy
from riskloom.llm.tries import Trie
from riskloom.session import stage

SAMPLE_DOCS = 1500
#: Languages whose table of pieces is held at once.
BLOCK = 64
ROUNDS = 4
#: Added to each piece's expected count.
SMOOTH = 0.05
UNKNOWN = "und"
START = "▁"
#: Words beyond this many characters are scored in parts of this size.
LONG = 24
CACHE = 120_000
#: Word scores (words by languages) that are kept, and strings by languages scored at once.
CELLS = 4_000_000
CHUNK = 65_536
SLICE = 500_000
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def parts_of(word: str) -> list[str]:
    """The word with its start mark, in parts short enough for plain doubles."""
    marked = START + word
    return [marked[i:i + LONG] for i in range(0, len(marked), LONG)]


@dataclass
class Lattice:
    """All pieces of a vocabulary that occur in given strings, by start and end."""

    rows: int
    sizes: np.ndarray
    arcs: list[tuple[int, int, np.ndarray, np.ndarray]]  #: (start, end, rows, pieces)


@dataclass
class Pieces:
    """The vocabulary: piece 0 stands for unknown characters."""

    names: list[str]
    trie: Trie = field(init=False)

    def __post_init__(self) -> None:
        self.trie = Trie(([ord(c) for c in p], i) for i, p in enumerate(self.names) if i)

    def lattice(self, parts: list[str]) -> Lattice:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(sizes.max(initial=0))
        symbols = (np.frombuffer("".join(p.ljust(width, "\0") for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
                   .reshape(len(parts), width).astype(np.int64))
        arcs, everyone = [], np.arange(len(parts))
        for i in range(width):
            lone = sizes > i
            for end, rows, pieces in self.trie.matches(symbols, sizes, i, everyone):
                arcs.append((i, end, rows, pieces))
                if end == i + 1:
                    lone[rows] = False
            rest = np.flatnonzero(lone)
            if len(rest):
                arcs.append((i, i + 1, rest, np.zeros(len(rest), np.int64)))
        return Lattice(len(parts), sizes, arcs)


def read_pieces(path: str) -> Pieces:
    """Pieces of a sentencepiece model, without control and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Pieces(["", *kept])


def forward(lattice: Lattice, probs: np.ndarray) -> np.ndarray:
    """Log-probability of each string under each language (probs: pieces by languages), summed over all segmentations."""
    width = int(lattice.sizes.max(initial=0))
    mass = np.zeros((lattice.rows, width + 1, probs.shape[1]))
    mass[:, 0] = 1
    for i, end, rows, pieces in lattice.arcs:
        mass[rows, end] += mass[rows, i] * probs[pieces]
    return np.log(np.maximum(mass[np.arange(lattice.rows), lattice.sizes], 1e-300))


def expected_counts(lattice: Lattice, langs: np.ndarray, weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (pieces by languages) in strings of known language, each seen `weights` times."""
    width = int(lattice.sizes.max(initial=0))
    ahead, behind = np.zeros((lattice.rows, width + 1)), np.zeros((lattice.rows, width + 1))
    ahead[:, 0] = 1
    for i, end, rows, pieces in lattice.arcs:
        ahead[rows, end] += ahead[rows, i] * probs[pieces, langs[rows]]
    whole = ahead[np.arange(lattice.rows), lattice.sizes]
    behind[np.arange(lattice.rows), lattice.sizes] = 1
    total = np.zeros(probs.size)
    share = weights / np.maximum(whole, 1e-300)
    for i, end, rows, pieces in reversed(lattice.arcs):
        through = probs[pieces, langs[rows]] * behind[rows, end]
        behind[rows, i] += through
        total += np.bincount(pieces * probs.shape[1] + langs[rows], ahead[rows, i] * through * share[rows], probs.size)
    return total.reshape(probs.shape)


@dataclass
class Block:
    """Some languages: log-priors, the probability of a piece that a language does not use, and those of used pieces (piece, language, value)."""

    langs: list[str]
    prior: np.ndarray
    floor: np.ndarray
    piece: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def probs(self, n_pieces: int) -> np.ndarray:
        out = np.tile(self.floor, (n_pieces, 1))
        out[self.piece, self.at] = self.value
        return out


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, text) -> lang, part, n: summed in each task by slice before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    counts[lang, word] += n
            rows = [(lang, part, n) for (lang, word), n in counts.items() for part in parts_of(word)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
                                             ["lang", "part", "n"])

    return (labelled.select("lang", "text").mapInArrow(tidy(run), "lang string, part string, n long")
            .groupBy("lang", "part").agg(F.sum("n").alias("n")))


def learn(labelled: DataFrame, path: str) -> list[Block]:
    """Model from rows (doc_id, lang, text), none of them null but perhaps the id."""
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return []
    share = spark.createDataFrame([(lang, i // BLOCK, min(1.0, SAMPLE_DOCS / sizes[lang])) for i, lang in enumerate(langs)], "lang string, block int, share double")
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) / 1e6
    sample = labelled.join(F.broadcast(share.select("lang", "share")), "lang").filter(draw < F.col("share"))
    # rows of a block lie together, so that its rounds skip most others
    counts = stage(word_counts(sample).join(F.broadcast(share.select("lang", "block")), "lang").sortWithinPartitions("block"), "langid-words")
    vocabulary = read_pieces(path)
    n_pieces = len(vocabulary.names)
    names = spark.sparkContext.broadcast(vocabulary.names)
    total = sum(sizes.values())

    def learn_block(number: int, own: list[str]) -> Block:
        place = {lang: i for i, lang in enumerate(own)}
        rows = counts.filter(F.col("block") == number).select("lang", "part", "n")

        def one_round(current: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
            shared = spark.sparkContext.broadcast(current)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                pieces, used = None, None
                for batch in batches:
                    if pieces is None:
                        pieces, used = Pieces(names.value), np.zeros_like(shared.value)
                    at = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
                    parts = batch.column("part").to_pylist()
                    for i in range(0, len(parts), 8192):
                        used += expected_counts(pieces.lattice(parts[i:i + 8192]), at[i:i + 8192],
                                                batch.column("n").to_numpy()[i:i + 8192].astype(float), shared.value)
                p, g = np.nonzero(used) if used is not None else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(g), pa.array(used[p, g] if len(p) else np.zeros(0))], ["piece", "at", "n"])

            got = (rows.mapInArrow(tidy(run), "piece long, at long, n double").groupBy("piece", "at").agg(F.sum("n").alias("n"))).toPandas()
            shared.destroy()
            out = np.full(current.shape, SMOOTH)
            out[got["piece"], got["at"]] += got["n"]
            return out / out.sum(axis=0), got

        probs = np.full((n_pieces, len(own)), 1 / n_pieces)
        for _ in range(ROUNDS):
            probs, got = one_round(probs)
        piece, at = got["piece"].to_numpy(np.int32), got["at"].to_numpy(np.int32)
        # a piece without an expected use has the least probability
        return Block(own, np.log([sizes[lang] / total for lang in own]), probs.min(axis=0), piece, at, probs[piece, at])

    return [learn_block(i // BLOCK, langs[i:i + BLOCK]) for i in range(0, len(langs), BLOCK)]


class BlockScorer:
    """Sums of word scores under a block's languages."""

    def __init__(self, pieces: Pieces, block: Block):
        self.pieces, self.block = pieces, block
        self.probs: np.ndarray | None = None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.block.langs)))

    def make_room(self) -> None:
        if len(self.place) > min(CACHE, CELLS // len(self.block.langs)):
            self.forget()

    def release(self) -> None:
        self.forget()
        self.probs = None

    def learn(self, words: set[str]) -> None:
        width = len(self.block.langs)
        if self.probs is None:
            self.probs = self.block.probs(len(self.pieces.names))
        new = sorted((w for w in words if w not in self.place), key=len)
        step, got = max(16, min(4096, CHUNK // width)), [self.scores]
        for i in range(0, len(new), step):
            parts, owner = [], []
            for k, word in enumerate(new[i:i + step]):
                own = parts_of(word)
                parts += own
                owner += [k] * len(own)
                self.place[word] = len(self.place)
            logs = np.vstack([forward(self.pieces.lattice(parts[j:j + step]), self.probs) for j in range(0, len(parts), step)])
            sums = np.zeros((len(new[i:i + step]), width))
            np.add.at(sums, np.array(owner), logs)
            got.append(sums)
        if new:
            self.scores = np.vstack(got)

    def sums(self, split: list[list[str]]) -> Iterator[np.ndarray]:
        """For each list of words: log-likelihoods and log-priors added up."""
        most = max(1, CELLS // len(self.block.langs))
        at_once = sum(map(len, split)) <= most
        self.make_room()
        if at_once:
            self.learn({w for words in split for w in words})
        for words in split:
            logs = np.zeros(len(self.block.langs))
            for i in range(0, len(words), most):
                if not at_once:
                    self.make_room()
                    self.learn(set(words[i:i + most]))
                logs += self.scores[[self.place[w] for w in words[i:i + most]]].sum(axis=0)
            yield logs + self.block.prior


class Scorer:
    def __init__(self, names: list[str], model: list[Block]):
        pieces = Pieces(names)
        self.blocks = [BlockScorer(pieces, block) for block in model]

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                size += len(texts[end] or "")
                end += 1
            split = [words_of(t) if t else [] for t in texts[at:end]]
            found = [(UNKNOWN, -np.inf, 0.0)] * len(split)  # language, its score, sum of all likelihoods as multiples of its own
            for scorer in self.blocks:
                for k, logs in enumerate(scorer.sums(split)):
                    if not split[k]:
                        continue
                    best = int(np.argmax(logs))
                    lang, top, total = found[k]
                    own = np.exp(logs - logs[best]).sum()
                    if logs[best] > top:
                        found[k] = scorer.block.langs[best], logs[best], own + total * np.exp(top - logs[best])
                    else:
                        found[k] = lang, top, total + own * np.exp(logs[best] - top)
                if len(self.blocks) > 1:
                    scorer.release()
            for lang, _, total in found:
                yield lang, float(1 / total) if total else 0.0
            at = end


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, path: str) -> DataFrame:
    """All columns of `docs` (doc_id, text, lang, ...) with held_out, lang_pred and score.

    Only text and label of rows outside the held-out fold are learned from; predictions see the text alone.
    """
    spark = docs.sparkSession
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    model = spark.sparkContext.broadcast(learn(labelled, path))
    names = spark.sparkContext.broadcast(read_pieces(path).names)
    fields = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    source = docs.select(*fields).withColumn("held_out", held_out(F.col("doc_id")))
    wide = StructType([*source.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(names.value, model.value)
        for batch in batches:
            out = list(scorer.predict(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])

    return source.mapInArrow(tidy(run), wide)

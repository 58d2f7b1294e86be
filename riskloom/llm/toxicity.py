"""Toxicity by classifier chains: categories are predicted one after another, each linear model also seeing the earlier probabilities.

Features are the words of a text (runs of letters, lower case), present or not, among a vocabulary of words that enough sample documents hold.
A chain trained on its own fitted probabilities would trust them too much; so the probabilities that later models train on are out of fold:
for each category, models of the other folds predict each fold. In use, each category's model of all sample rows feeds the next.
The threshold of the last category is the one of best F1 on its out-of-fold predictions.

Logistic models are fitted on a sample of labelled documents of about `SAMPLE_DOCS` rows, drawn by a hash of the id; the models of a category,
one for each fold and one for all rows, are tasks of one job. Predictions cover all rows.

Defined results: a null or empty text has no words and gets the models' intercepts; labels without id or value are left out, and a document
labelled twice has a category if one label says so. A category that the sample lacks, or that all its rows have, is predicted by that constant;
without a sample all probabilities are 0. Repeated rows get equal predictions; an empty table gives an empty table; further columns pass through.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from riskloom.session import stage

SAMPLE_DOCS = 20_000
FOLDS = 3
VOCABULARY = 1 << 16
#: Least sample documents that hold a word of the vocabulary.
LEAST_DOCS = 5
#: Weight of the squared coefficients, for each row.
PENALTY = 0.002
STEPS = 60
LETTERS = regex.compile(r"\p{L}+")


def words(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


@dataclass
class Rows:
    """Word places of documents, one after another, and dense columns beside them."""

    places: np.ndarray
    sizes: np.ndarray
    dense: np.ndarray
    width: int

    def scores(self, w: np.ndarray) -> np.ndarray:
        upto = np.r_[0.0, np.cumsum(w[self.places])]
        ends = np.cumsum(self.sizes)
        return upto[ends] - upto[ends - self.sizes] + self.dense @ w[self.width:-1] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.places, np.repeat(r, self.sizes), self.width), self.dense.T @ r, r.sum()]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: Rows, y: np.ndarray) -> np.ndarray:
    """Coefficients and, last, the intercept: penalised logistic loss, minimised by limited-memory quasi-Newton steps."""
    n = len(y)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.scores(w)
        free = np.r_[w[:-1], 0.0]
        return (np.logaddexp(0, z) - y * z).mean() + PENALTY / 2 * free @ free, x.back(sigmoid(z) - y) / n + PENALTY * free

    w = np.zeros(x.width + x.dense.shape[1] + 1)
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        q, kept = g.copy(), []
        for s, d in reversed(past):
            a = (s @ q) / (s @ d)
            q -= a * d
            kept.append(a)
        if past:
            s, d = past[-1]
            q *= (s @ d) / (d @ d)
        for (s, d), a in zip(past, reversed(kept), strict=True):
            q += s * (a - (d @ q) / (s @ d))
        step, slope = 1.0, g @ q
        while step > 1e-6:
            f_new, g_new = loss(w - step * q)
            if f_new <= f - 1e-4 * step * slope:
                break
            step /= 2
        moved, turned = -step * q, g_new - g
        if f - f_new < 1e-7 * max(1.0, abs(f)):
            break
        w, f, g = w + moved, f_new, g_new
        if moved @ turned > 1e-12:
            past = [*past[-7:], (moved, turned)]
    return w


@dataclass
class Link:
    """One category: coefficients (words, earlier probabilities, intercept), or the constant where there is nothing to learn."""

    category: str
    weights: np.ndarray | None
    constant: float = 0.0

    def probability(self, x: Rows) -> np.ndarray:
        return np.full(len(x.sizes), self.constant) if self.weights is None else sigmoid(x.scores(self.weights))


def rows_of(places: Sequence[Sequence[int]], dense: np.ndarray, width: int) -> Rows:
    sizes = np.fromiter(map(len, places), np.int64, len(places))
    flat = np.concatenate([np.zeros(0, np.int64), *[np.asarray(p, np.int64) for p in places if len(p)]])
    return Rows(flat, sizes, dense, width)


@dataclass
class Chain:
    vocabulary: list[str]
    links: list[Link] = field(default_factory=list)
    threshold: float = 0.5

    def predict(self, docs: DataFrame) -> DataFrame:
        """`docs` (text, ...) with p_<category> for each category, and `toxic` by the last one."""
        shared = docs.sparkSession.sparkContext.broadcast(self)  # bounded by VOCABULARY and the number of categories
        names = [f"p_{link.category}" for link in self.links]
        fields = [c for c in docs.columns if c not in (*names, "toxic")]
        schema = StructType([*docs.select(*fields).schema.fields])
        for name in names:
            schema = schema.add(name, DoubleType())
        schema = schema.add("toxic", BooleanType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain = shared.value
            place = {w: i for i, w in enumerate(chain.vocabulary)}
            for batch in batches:
                found = [sorted(place[w] for w in words(t) if w in place) for t in batch.column("text").to_pylist()]
                x = rows_of(found, np.zeros((len(found), 0)), len(place))
                ps: list[np.ndarray] = []
                for link in chain.links:
                    x.dense = np.stack(ps, axis=1) if ps else np.zeros((len(found), 0))
                    ps.append(link.probability(x))
                flag = ps[-1] >= chain.threshold if ps and chain.vocabulary else np.zeros(len(found), bool)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p) for p in ps], pa.array(flag)], schema.names)

        return docs.select(*fields).mapInArrow(run, schema)


def sample_rows(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(row_id, words, fold, categories...) of about SAMPLE_DOCS labelled documents."""
    known = (labels.filter(F.col("doc_id").isNotNull()).dropna(subset=list(categories))
             .groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories]))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    chosen = known.filter(draw < int(1_000_000 * min(1.0, SAMPLE_DOCS / max(known.count(), 1)))).withColumnRenamed("doc_id", "labelled_id")
    picked = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))  # bounded by SAMPLE_DOCS
              .select(F.xxhash64("doc_id", "text").alias("row_id"), "text", *categories))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(words(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
            fold = pa.array([i % FOLDS for i in batch.column("row_id").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), found, fold, *[batch.column(c) for c in categories]],
                                             ["row_id", "words", "fold", *categories])

    return picked.mapInArrow(run, "row_id long, words array<string>, fold int, " + ", ".join(f"{c} double" for c in categories))


def fit_category(rows: DataFrame, category: str, earlier: Sequence[str], width: int) -> tuple[Link, DataFrame]:
    """The category's model, and (row_id, p_<category>) out of fold; each model is one task of a job over copies of the sample."""
    share = rows.agg(F.avg(category)).first()[0] or 0.0
    name = f"p_{category}"
    if share in (0.0, 1.0):
        return Link(category, None, share), rows.select("row_id", F.lit(share).alias(name)).distinct()
    copies = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        held = group["fold"] == group["model"].iloc[0]  # none for the model of all rows
        x = rows_of(group["places"].tolist(), group[list(earlier)].to_numpy(np.float64), width)
        train = np.flatnonzero(~held)
        part = rows_of(group["places"].iloc[train].tolist(), x.dense[train], width)
        weights = fit_logistic(part, group[category].to_numpy()[train])
        if not held.any():
            return pd.DataFrame({"row_id": [0], "p": [0.0], "weights": [weights.tobytes()]})
        return pd.DataFrame({"row_id": group["row_id"][held], "p": sigmoid(x.scores(weights))[held], "weights": None})

    got = stage(copies.groupBy("model").applyInPandas(run, "row_id long, p double, weights binary"), "toxicity-models")
    weights = np.frombuffer(bytes(got.filter("weights IS NOT NULL").first()["weights"]))
    return Link(category, weights), got.filter("weights IS NULL").select("row_id", F.col("p").alias(name)).dropDuplicates(["row_id"])


def best_threshold(df: DataFrame, score: str, category: str) -> float:
    """Score of best F1, among 1,000 steps."""
    rows = df.groupBy(F.floor(F.col(score) * 1000).alias("step")).agg(F.sum(category).alias("yes"), F.count("*").alias("n")).collect()
    total, yes, n, best, at = sum(r["yes"] for r in rows), 0.0, 0, -1.0, 0.5
    for r in sorted(rows, key=lambda r: -r["step"]):
        yes, n = yes + r["yes"], n + r["n"]
        f1 = 2 * yes / max(total + n, 1)
        if f1 > best:
            best, at = f1, r["step"] / 1000
    return at


def learn(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> Chain:
    """Chain over 0/1 columns of `labels` (doc_id, ...), the last one being the wanted one."""
    sample = stage(sample_rows(docs, labels, categories), "toxicity-sample")
    vocabulary = [r["word"] for r in sample.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
                  .filter(F.col("n") >= LEAST_DOCS).orderBy(F.col("n").desc(), "word").limit(VOCABULARY).collect()]
    if not vocabulary:
        return Chain([], [Link(c, None, 0.0) for c in categories])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    columns = ["row_id", "fold", *categories]

    def place_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            found = [[place[w] for w in ws if w in place] for ws in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, pa.list_(pa.int32()))], [*columns, "places"])

    rows = stage(sample.mapInArrow(place_words, "row_id long, fold int, " + ", ".join(f"{c} double" for c in categories) + ", places array<int>"),
                 "toxicity-places")
    links, earlier = [], []
    for c in categories:
        link, out_of_fold = fit_category(rows, c, earlier, len(vocabulary))
        links.append(link)
        rows = stage(rows.join(out_of_fold, "row_id"), "toxicity-out-of-fold")
        earlier.append(f"p_{c}")
    return Chain(vocabulary, links, best_threshold(rows, earlier[-1], categories[-1]))

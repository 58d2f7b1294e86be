"""A training corpus from the documents table: five stages, each written and read again before the next one.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of `documents`; the last returns encoded documents.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, jaccard, langid, mixing, pii
from riskloom.llm.memory import release
from riskloom.llm.queries import prepared, surrogate_key, table, tokenizer
from riskloom.session import stage

#: A prediction below this posterior is no identified language.
LEAST_SCORE = 0.5
#: Dropped document keys (16 bytes each) up to this many go to every executor; more are joined by a shuffle.
SMALL_ROWS = 2_000_000


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with generated names for all columns but `used`, so that none clashes with a stage's own, and the way back to its columns."""
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
    names = {c: c if c in used else f"__column_{i}" for i, c in enumerate(docs.columns)}
    return (docs.select(*[F.col(quoted[c]).alias(names[c]) for c in docs.columns]),
            lambda out: out.select(*[F.col(names[c]).alias(c) if names[c] != c else F.col(c) for c in docs.columns]))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; null texts, texts without letters and undecided ones go.

    Repeated rows are judged alike; null ids and languages are rows like others; an empty table stays empty.
    """
    plain, back = apart(docs, "doc_id", "text", "lang")
    found = langid.identify(plain, tokenizer(prepared(spark), "piece_bpe_32k.model"))
    return back(found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id, null ids last; of repeated rows one stays.

    Texts without words, and null texts, are no group and stay; an empty table stays empty.
    """
    prepared(spark)
    plain, back = apart(docs, "doc_id", "text")
    rows = stage(jaccard.near_duplicates(plain.select("doc_id", "text")).filter("component IS NOT NULL").select("doc_id", "text_key", "component"), "pipeline-near")
    id_ = F.coalesce("doc_id", F.lit(2 ** 63 - 1))  # rows without an id come last
    kept = rows.groupBy("component").agg(F.min(F.struct(id_.alias("i"), "text_key", "doc_id")).alias("k")).select("component", "k.*")
    marked = rows.withColumn("i", id_).join(kept.select("component", F.col("i").alias("k_i"), F.col("text_key").alias("k_text")), "component")
    stays = (F.col("i") == F.col("k_i")) & (F.col("text_key") == F.col("k_text"))
    keys = stage(marked.groupBy("i", F.col("text_key").alias("t")).agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
                 .filter(~F.col("stays") | (F.col("n") > 1)), "pipeline-keys")
    small = keys.count() <= SMALL_ROWS
    keyed = plain.withColumn("of_id", id_).withColumn("of_text", F.xxhash64("text"))
    joined = keyed.join(F.broadcast(keys) if small else keys, (F.col("of_id") == F.col("i")) & (F.col("of_text") == F.col("t")), "left")
    single = joined.filter(F.col("n").isNull())
    repeated = joined.filter("stays").dropDuplicates(["of_id", "of_text"])  # rows of one id and text
    return back(single.unionByName(repeated))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the new text. Every row stays; null and empty texts stay as they are; repeated rows change alike."""
    plain, back = apart(docs, "text")
    out = back(pii.replace(plain, surrogate_key(prepared(spark))))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Texts without words, and null texts, are taken no time; a null source is a source; an empty table stays empty."""
    prepared(spark)
    plain, back = apart(docs, "doc_id", "source", "text")
    return back(mixing.mix(plain).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: doc_id, n_tokens, digests of ids and decoded text, token_ids; a null text has no tokens, further columns go."""
    return bpe.encode_documents(docs.select("doc_id", "text"), tokenizer(prepared(spark), "byte_bpe_50k.json"), keep_ids=True)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("PII surrogates", private), ("mixing to target weights", mixed),
          ("BPE encoding", encoded)]
#: Language identification has no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release()
    return docs

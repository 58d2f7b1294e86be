"""Registered queries of the subpackage, and the SQL text of those another engine can state."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import ann, bpe, exact_search, imatch, jaccard, langid, lexical, mixing, pii, repeats, resampling, toxicity, variants
from riskloom.session import tune

#: Vocabulary files of public tokenizers; another folder can be set on the session.
TOKENIZERS = "/opt/tokenizers"
#: Documents in an Arrow batch: bounds what a Python worker holds of long texts.
BATCH_ROWS = "400"
Query = Callable[[SparkSession, str], DataFrame]


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that queries and stages rely on."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def tokenizer(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.riskloom.tokenizers', TOKENIZERS)}/{name}"


def surrogate_key(spark: SparkSession) -> str:
    """The secret that surrogates derive from; without the setting, a fixed one, whose surrogates anyone can recompute."""
    return spark.conf.get("spark.riskloom.surrogate.key", "surrogates")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), tokenizer(spark, "byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The labels' categories: degraded text first, then toxic text."""
    labels = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("degraded"), F.col("toxic").alias("toxicity"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.learn(docs, labels, ["degraded", "toxicity"]).predict(docs).drop("text")


def op3_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace(table(spark, folder, "documents").select("doc_id", "text"), surrogate_key(spark))


def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text")).withColumn("has_repeats", F.col("n_removed") > 0)


def op6_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Target: documents labelled as of good quality; the sample's size is their share among the labels."""
    labels = table(spark, folder, "labels").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return resampling.resample(table(spark, folder, "documents"), labels.filter("quality = 1"), 1.0 if share is None else share)


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = f"WITH {mixing.mix_sql().strip()}\nSELECT doc_id, size, source_size, target, taken FROM mixed"

def op8_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, tokenizer(spark, "piece_bpe_32k.model")).select("doc_id", "held_out", "lang_pred", "score")


def op9_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    return exact_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op11_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, folder, "documents").select("doc_id", "text"))


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group_variants(table(spark, folder, "documents").select("doc_id", "text"))


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text")
    return lexical.top_documents(docs, items, 10)


OP9_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN min(embedding)] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""

QUERIES: dict[str, Query] = {"op1_bpe": op1_bpe, "op2_toxicity": op2_toxicity, "op3_ann": op3_ann, "op4_pii": op4_pii, "op5_repeats": op5_repeats, "op6_resampling": op6_resampling, "op7_mixing": op7_mixing, "op8_langid": op8_langid,
                             "op9_exact_search": op9_exact_search, "op10_jaccard": op10_jaccard, "op11_imatch": op11_imatch, "op12_variants": op12_variants, "op13_lexical": op13_lexical}
ORACLES: dict[str, str] = {"op7_mixing": OP7_SQL, "op9_exact_search": OP9_SQL, "op11_imatch": imatch.fingerprint_sql(),
                           "op13_lexical": lexical.top_documents_sql()}

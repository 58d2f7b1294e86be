"""Queries over documents, retrieval and claim grounding."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import money_sum, rnd
from riskloom.functions.text import STOP_WORDS, SUFFIXES, tokens
from riskloom.operators import documents as doc
from riskloom.operators import retrieval as ret
from riskloom.plans.registry import oracle, query
from riskloom.sources.dataset import replace_keyed
from riskloom.sources.generated import Bank, table


def corpus(b: Bank) -> DataFrame:
    return table(b.spark, b.folder, "documents").select("doc_id", "text", "lang", "source")


def questions(b: Bank) -> DataFrame:
    return table(b.spark, b.folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
STEM = "CASE " + " ".join(f"WHEN length(t) > {len(s) + 3} AND ends_with(t, '{s}') THEN concat(t[:length(t) - {len(s)}], '{e}')" for s, e in SUFFIXES) + " ELSE t END"
TOK = f"list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda t: length(t) > 1 AND t NOT IN {STOP}), lambda t: {STEM})"
BM25 = f"""
tok AS (SELECT doc_id, {TOK} AS ts FROM documents), size AS (SELECT count(*) AS n_docs, sum(len(ts)) / count(*) AS avg_len FROM tok),
post AS (SELECT doc_id, ln, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS ln, unnest(ts) AS term FROM tok) x GROUP BY 1, 2, 3),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark) x GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
kw AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, p.doc_id, floor(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.75 + 0.75 * p.ln / avg_len))) * 1e6 + 0.5) / 1e6 AS score
  FROM post p JOIN q ON q.term = p.term JOIN dfs d ON d.term = p.term, size WHERE {{where}} GROUP BY 1, 2) s WHERE score > 0)"""
QV = """qv AS (SELECT label AS query_id, list_transform(range(1, 65), lambda i: floor(avg_of[i] * 1e6 + 0.5) / 1e6) AS v FROM (SELECT label, list(m ORDER BY i) AS avg_of FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS i FROM embeddings) a GROUP BY 1, 2) b GROUP BY 1) c)"""
SEM = QV + """,
sem AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, vec_id AS id, floor(list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))) * 1e5 + 0.5) / 1e5 AS score FROM embeddings, qv {where}) s)"""


def label_queries(b: Bank) -> DataFrame:
    """One query vector per label: the mean of its vectors, computed by position."""
    e = table(b.spark, b.folder, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    m = e.groupBy("label", "i").agg(rnd(F.avg("x"), 6).alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding")).select(F.col("label").alias("query_id"), "embedding")


def vectors(b: Bank) -> DataFrame:
    return table(b.spark, b.folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("r01_markdown_blocks")
def _(b):
    """Every document as markdown: each first line of a paragraph group becomes a heading."""
    md = corpus(b).select("doc_id", F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n")).alias("text"))
    return doc.parse_markdown(md)


@query("r02_text_blocks", oracle("", r"""
SELECT doc_id, pos, text FROM (SELECT doc_id, unnest(range(len(p))) AS pos, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, regexp_split_to_array(replace(text, '. ', chr(10) || chr(10)), '\n\s*\n') AS p FROM documents) x) y WHERE text <> ''"""))
def _(b):
    d = corpus(b).withColumn("text", F.replace("text", F.lit(". "), F.lit("\n\n")))
    return doc.parse_text(d).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


@query("r03_chunks")
def _(b):
    return doc.chunk_documents(corpus(b))


def _terms_sql(terms) -> str:
    return " + ".join(f"(length(low) - length(replace(low, '{t}', ''))) // {len(t)} + 3 * ((length(title) - length(replace(title, '{t}', ''))) // {len(t)})" for t in terms)


@query("r04_classify", oracle("", f"""
SELECT doc_id, CASE WHEN top = 0 THEN 'unclassified' ELSE best END AS doc_type, CASE WHEN top = 0 THEN 0 ELSE floor(top / (top + second) * 1000 + 0.5) / 1000 END AS confidence FROM (
  SELECT doc_id, arg_min(name, struct_pack(a := -s, b := place)) AS best, max(s) AS top, list(s ORDER BY s DESC)[2] AS second FROM (
    SELECT doc_id, unnest([{', '.join(f"'{n}'" for n in doc.TYPE_TERMS)}]) AS name, unnest(range({len(doc.TYPE_TERMS)})) AS place, unnest([{', '.join(_terms_sql(t) for t in doc.TYPE_TERMS.values())}]) AS s
    FROM (SELECT doc_id, lower(text) AS low, lower(concat(source, ' case report ', CASE doc_id % 3 WHEN 0 THEN 'kyc' WHEN 1 THEN 'mule' ELSE '' END)) AS title FROM documents) x) y GROUP BY 1) z"""))
def _(b):
    title = F.concat(F.col("source"), F.lit(" case report "), F.when(F.col("doc_id") % 3 == 0, "kyc").when(F.col("doc_id") % 3 == 1, "mule").otherwise(""))
    return doc.classify(corpus(b).withColumn("title", title))


@query("r05_metadata", oracle("", r"""
SELECT doc_id, nullif(regexp_extract(t, '(?i)\bversion[:\s]+v?(\d+(?:\.\d+)*)', 1), '') AS version, coalesce(nullif(regexp_extract(t, '(?i)effective(?:\s+date)?[:\s]+(20\d{2}-\d{2}-\d{2})', 1), ''), nullif(regexp_extract(t, '\b(20\d{2}-\d{2}-\d{2})\b', 1), '')) AS effective_date, 'unspecified' AS jurisdiction
FROM (SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN concat(' Version: v1.', doc_id % 9, ' seen 2023-05-01, effective date: 2024-01-1', doc_id % 9) WHEN 1 THEN ' dated 2022-02-03.' ELSE '' END) AS t FROM documents) x"""))
def _(b):
    n = (F.col("doc_id") % 9).cast("string")
    extra = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" Version: v1."), n, F.lit(" seen 2023-05-01, effective date: 2024-01-1"), n)).when(F.col("doc_id") % 4 == 1, " dated 2022-02-03.").otherwise("")
    return doc.extract_metadata(corpus(b).withColumn("text", F.concat("text", extra)))


@query("r06_exact_duplicates", oracle("", "SELECT doc_id, digest, copies, first_id FROM (SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS copies, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) x WHERE copies > 1"))
def _(b):
    return doc.exact_duplicates(corpus(b))


@query("r07_tokens", oracle("", f"SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS digest FROM (SELECT doc_id, {TOK} AS ts FROM documents) x"))
def _(b):
    t = corpus(b).select("doc_id", tokens(F.col("text")).alias("ts"))
    return t.select("doc_id", F.size("ts").cast("long").alias("n"), F.md5(F.array_join("ts", " ")).alias("digest"))


@query("r08_bm25", oracle("", "SELECT query_id, id AS doc_id, score, rank FROM kw WHERE rank <= 10", BM25.replace("{where}", "true")))
def _(b):
    return ret.bm25(corpus(b), questions(b), 10)


@query("r14_keyword_in_type", oracle("", "SELECT query_id, id AS doc_id, score, rank FROM kw WHERE rank <= 10", BM25.replace("{where}", "p.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")))
def _(b):
    return ret.bm25(corpus(b), questions(b), 10, corpus(b).filter("lang = 'en'").select("doc_id"))


@query("r09_latent_vectors")
def _(b):
    return ret.lsa(corpus(b)).select("doc_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.round(F.abs(x), 4)).alias("magnitudes"))


@query("r10_cosine_top_k", oracle("", "SELECT query_id, id, score, rank FROM sem WHERE rank <= 20", SEM.replace("{where}", "")))
def _(b):
    return ret.cosine_top_k(vectors(b), label_queries(b), 20)


@query("r10_cosine_filtered", oracle("", "SELECT query_id, id, score, rank FROM sem WHERE rank <= 20", SEM.replace("{where}", "WHERE label IN (1, 3, 5)")))
def _(b):
    return ret.cosine_top_k(vectors(b).filter("label IN (1, 3, 5)"), label_queries(b), 20)


@query("r11_vector_upsert", oracle("", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings"))
def _(b):
    v = vectors(b)
    return replace_keyed(v, v.filter("id % 3 = 0").withColumn("label", F.col("label") + 100), "id").select("id", "label")


@query("io05_replace_document_chunks", oracle("", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE lang END AS part FROM documents UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 5 <> 0"))
def _(b):
    d = corpus(b)
    current = d.select("doc_id", F.col("lang").alias("part")).union(d.select("doc_id", "source"))
    return replace_keyed(current, d.filter("doc_id % 5 = 0").select("doc_id", F.upper("lang").alias("part")), "doc_id")


# every question is asked with its text and with the mean vector of one label
ASKED = """
lab AS (SELECT query_id AS label, row_number() OVER (ORDER BY query_id) - 1 AS place, count(*) OVER () AS n FROM qv),
ask AS (SELECT item_id AS query_id, label FROM benchmark JOIN lab ON item_id % n = place)"""
FUSED = ASKED + """,
ss AS (SELECT ask.query_id, id, rank, score FROM ask JOIN sem ON sem.query_id = ask.label WHERE rank <= 20),
ks AS (SELECT query_id, id, rank, score FROM kw WHERE rank <= 20),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, semantic_rank ASC NULLS LAST, keyword_rank) AS place FROM (
  SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.id, k.id) AS id, s.rank AS semantic_rank, k.rank AS keyword_rank, floor((coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + k.rank), 0)) * 1e9 + 0.5) / 1e9 AS fused
  FROM ss s FULL JOIN ks k ON k.query_id = s.query_id AND k.id = s.id) x)"""
FUSE_CTE = BM25.replace("{where}", "true") + ",\n" + SEM.replace("{where}", "") + "," + FUSED


def asked(b: Bank, queries: DataFrame) -> DataFrame:
    """(query_id, label): the label whose vector goes with each question, by its number among the labels of `queries`."""
    labels = queries.select(F.col("query_id").alias("label")).groupBy().agg(F.array_sort(F.collect_list("label")).alias("labels"))  # one row for all labels
    at = F.pmod(F.col("query_id"), F.size("labels")).cast("int")
    return questions(b).crossJoin(F.broadcast(labels)).select("query_id", F.col("labels")[at].alias("label"))


def both_lists(b: Bank) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For every question: the nearest vectors, the best keyword matches, and its label."""
    queries = label_queries(b)
    of = asked(b, queries)
    near = ret.cosine_top_k(vectors(b), queries.withColumn("query_id", F.col("query_id").cast("long")), 20).withColumnRenamed("query_id", "label")
    sem = of.join(near, "label").select("query_id", "id", "rank", "score")
    kw = ret.bm25(corpus(b), questions(b), 20).select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").alias("id"), "rank", "score")
    return sem, kw, of


def fused(b: Bank, k: int | None) -> DataFrame:
    sem, kw, _ = both_lists(b)
    return ret.fuse(sem, kw, k)


@query("r12_rank_fusion", oracle("", "SELECT query_id, id, semantic_rank, keyword_rank, fused, place AS rank FROM fused WHERE place <= 10", FUSE_CTE))
def _(b):
    return fused(b, 10).select("query_id", "id", "semantic_rank", "keyword_rank", "fused", "rank")


@query("j10_list_merge", oracle("", "SELECT query_id, id, semantic_rank, keyword_rank FROM fused", FUSE_CTE))
def _(b):
    return fused(b, None).select("query_id", "id", "semantic_rank", "keyword_rank")


@query("w03_list_rank", oracle("", "SELECT query_id, id, rank FROM sem WHERE rank <= 5", SEM.replace("{where}", "")))
def _(b):
    return ret.cosine_top_k(vectors(b), label_queries(b), 5).select("query_id", "id", "rank")


@query("r13_policy_passages", oracle("", "SELECT doc_id, lang FROM documents WHERE source = 'src3' AND lang = 'en' ORDER BY doc_id LIMIT 20"))
def _(b):
    return corpus(b).filter("source = 'src3' AND lang = 'en'").orderBy("doc_id").limit(20).select("doc_id", "lang")


@query("r15_signal_passages", oracle("", """
SELECT case_id, id, signals, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY best DESC, id) AS rank FROM (
  SELECT query_id % 3 AS case_id, id, string_agg(DISTINCT CASE query_id % 4 WHEN 0 THEN 'FAN_IN' WHEN 1 THEN 'STRUCTURING' ELSE 'NEW_DEVICE' END, ',' ORDER BY CASE query_id % 4 WHEN 0 THEN 'FAN_IN' WHEN 1 THEN 'STRUCTURING' ELSE 'NEW_DEVICE' END) AS signals, max(fused) AS best
  FROM fused WHERE place <= 5 GROUP BY 1, 2) x) y WHERE rank <= 12""", FUSE_CTE))
def _(b):
    f = fused(b, 5).drop("rank")
    signal = F.when(F.col("query_id") % 4 == 0, "FAN_IN").when(F.col("query_id") % 4 == 1, "STRUCTURING").otherwise("NEW_DEVICE")
    of = f.select("query_id").distinct().select("query_id", (F.col("query_id") % 3).alias("case_id"), signal.alias("signal"))
    return ret.passages_for_signals(f, of).select("case_id", "id", F.array_join("signals", ",").alias("signals"), "rank")


@query("r16_similar_cases", oracle("investigations", """
SELECT investigation_id, similar_id, floor(j * 1000 + 0.5) / 1000 AS overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY j DESC, similar_id) AS rank FROM (
  SELECT a.investigation_id, b.investigation_id AS similar_id, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM i a JOIN i b ON a.status <> 'closed' AND b.status = 'closed' AND len(list_intersect(a.s, b.s)) > 0) x) y WHERE rank <= 5""",
    "i AS (SELECT *, string_split(signal_list, ',') AS s FROM investigations)"))
def _(b):
    return doc.similar_cases(b.investigations.filter("status <> 'closed'"), b.investigations.filter("status = 'closed'"))


@query("r17_case_notes", oracle("investigations", "SELECT investigation_id, concat(investigation_id, ' (', subject_type, ' ', subject_id, ')') AS section, concat(summary, ' Signals: ', replace(signal_list, ',', ', '), '. Conclusion: ', coalesce(conclusion, 'n/a'), '.') AS text FROM investigations WHERE status = 'closed'"))
def _(b):
    return doc.case_notes(b.investigations)


def claims(b: Bank) -> tuple[DataFrame, DataFrame]:
    """Per sender a claim about its month and the evidence for it; every third claim states a wrong amount, every fourth
    accuses, every fifth cites a reference that does not exist."""
    s = b.txn.filter("sender_account_id IS NOT NULL").groupBy(F.col("sender_account_id").alias("case_id")).agg(F.count(F.lit(1)).alias("n"), money_sum(F.col("amount_usd")).alias("usd"))
    k = F.col("case_id")
    said = F.when(k % 3 == 0, F.col("usd") * 2 + 50).otherwise(F.col("usd"))
    text = F.concat(F.lit("Account ACC-"), k.cast("string"), F.lit(" sent USD "), F.format_string("%.2f", said), F.lit(" in "), F.col("n").cast("string"), F.lit(" transfers by 2024-01-30"),
                    F.when(k % 4 == 0, " and is a criminal").otherwise(""), F.lit("."))
    cites = F.when(k % 5 == 0, F.array(F.lit("E1"), F.lit("E9"))).when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("E1")))
    content = F.concat(F.lit("ACC-"), k.cast("string"), F.lit(" total "), F.format_string("%.2f", "usd"), F.lit(" count "), F.col("n").cast("string"), F.lit(" until 2024-01-30"))
    return (s.select("case_id", F.lit(1).alias("claim_id"), text.alias("text"), cites.alias("citations")), s.select("case_id", F.lit("E1").alias("ref"), content.alias("content")))


@query("r18_claim_grounding", oracle("txn", """
SELECT case_id, case_id % 3 <> 0 AND case_id % 4 <> 0 AND case_id % 5 <> 0 AND case_id % 7 <> 0 AS supported, CASE WHEN case_id % 5 <> 0 AND case_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN case_id % 5 = 0 THEN 1 ELSE 0 END
  + CASE WHEN case_id % 3 = 0 AND (case_id % 5 = 0 OR case_id % 7 <> 0) THEN 1 ELSE 0 END + CASE WHEN case_id % 4 = 0 THEN 1 ELSE 0 END AS n_reasons FROM (SELECT DISTINCT sender_account_id AS case_id FROM txn WHERE sender_account_id IS NOT NULL) x"""))
def _(b):
    c, e = claims(b)
    return doc.ground_claims(c, e).select("case_id", "supported", F.size("reasons").cast("long").alias("n_reasons"))

"""Document fingerprints by I-Match over randomised lexicons, with DataFrame functions only.

Terms within a band of inverse document frequency make up the lexicon: those of a single document say nothing, those of a tenth of all
documents or more tell documents apart badly. The lexicon is split at random into `SUBSETS` lexicons, and each of these into ever thinner
ones (a level halves it). A text is fingerprinted at the level that leaves some dozens of its terms, and at the next thinner one, so that
texts of similar size always share a level. Of each lexicon, the text's distinct terms are sorted and hashed: an edit breaks only the hashes
of the lexicons that hold a changed term. Likeness is the share of equal hashes among the lexicons that either text touches, at shared levels.

The band's lower end is a share of all documents, so the lexicon has at most (mean number of distinct terms of a document) / `RARE` terms,
whatever the size of the corpus. It is counted, and joined by broadcast up to `SMALL_TERMS` terms, by shuffle beyond.

The order of documents is found without a global window: cut points put ids into buckets of neighbours, the largest id of a bucket is also
sent to the bucket before it, and windows stay inside buckets. All later steps keep that partitioning: each whole text is shuffled once.

Defined results: a null text is empty; a null id comes last in the order; rows of one id are ordered by text; repeated rows are rows of their
own; a text with few terms of the lexicon (and any text of a table of few documents) is fingerprinted by its other terms as well, in hashes of their
own, one without terms has the empty fingerprint; equal fingerprints have likeness 1; an empty table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The band: a term's documents are at least two and at least this share of all, and at most the larger of two and this share.
RARE, FREQUENT = 0.001, 0.1
#: Randomised lexicons, and distinct terms of a text (as a power of two) from which on thinner ones are used.
SUBSETS, FULL_BITS = 64, 6
#: A text with fewer hashes than this also gets those of its other terms.
FEW_HASHES = 16
#: Lexicons up to this many terms go to every executor (about 100 bytes a term).
SMALL_TERMS = 1_000_000
#: Text in a bucket of neighbouring ids, about, and rows at least.
BUCKET_BYTES, MIN_BUCKET_ROWS = 32_000_000, 50
LOWEST = -(2 ** 63)


def terms(text: Column) -> Column:
    """Distinct terms of a text, A-Z lower-cased."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))


def lexicon(docs: DataFrame, rare: float = RARE, frequent: float = FREQUENT) -> DataFrame:
    """(term) of the band, by document counts over all rows of `docs` (text)."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low, high = max(2.0, rare * n), max(2.0, frequent * n)
    return df.filter((F.col("df") >= low) & (F.col("df") <= high)).select("term")


def _level(n: Column) -> Column:
    """Halvings that leave 2**(FULL_BITS - 1) up to 2**FULL_BITS of n terms."""
    return F.greatest(F.lit(0), F.length(F.bin(n)) - F.lit(FULL_BITS))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, however often and however deep in lambdas `body` names it."""
    return F.transform(F.array(value), body)[0]


MARK = "struct<side:int, level:int, subset:int, up:boolean, term:string, code:string, about:struct<{}>>"


def _marks(side: int, text: Column, mark: str) -> Column:
    """The terms of a text inside its level, each with whether it is in the next thinner one (up); a level keeps half of the one before."""
    def limit(level: Column) -> Column:
        return F.when(level > 0, F.lower(F.lpad(F.hex(F.call_function("shiftright", F.lit(2 ** 24), level)), 6, "0"))).otherwise("g")

    def kept(digests: Column, v: Column) -> Column:
        return F.transform(F.filter(digests, lambda x: F.substring(x["d"], 1, 6) < v["limit"]), lambda x: F.struct(
            F.lit(side).alias("side"), v["level"].alias("level"), (F.conv(F.substring(x["d"], 7, 2), 16, 10).cast("int") % SUBSETS).alias("subset"),
            (F.substring(x["d"], 1, 6) < v["thinner"]).alias("up"), x["term"].alias("term"), F.substring(x["d"], 9, 16).alias("code"), F.lit(None).alias("about")))

    digests = F.transform(terms(text), lambda t: F.struct(t.alias("term"), F.md5(t).alias("d")))
    return _bound(digests, lambda ds: _bound(_level(F.size(ds).cast("long")).cast("int"), lambda level: _bound(
        F.struct(level.alias("level"), limit(level).alias("limit"), limit(level + 1).alias("thinner")), lambda v: kept(ds, v)))).cast(f"array<{mark}>")


def fingerprints(texts: DataFrame, key: list[str], sides: list[str], about: list[str], lexicon_: DataFrame, small: bool) -> DataFrame:
    """`key` (unique), the columns `about`, and `fp`, an array of one fingerprint for each of the text columns `sides` (null texts: empty).

    Every row is exploded to its terms and put together again. `about` travels on a row of its own, so that term rows stay narrow.
    """
    mark = MARK.format(", ".join(f"{c}:{texts.schema[c].dataType.simpleString()}" for c in about))
    empty = [F.lit(None)] * 6
    own = F.array(F.struct(*[x.alias(c) for x, c in zip([F.lit(-1), *empty[1:]], ("side", "level", "subset", "up", "term", "code"), strict=True)],
                           F.struct(*about).alias("about"))).cast(f"array<{mark}>")
    every = texts.select(*key, F.explode(F.concat(own, *[F.coalesce(_marks(i, F.col(c), mark), F.array().cast(f"array<{mark}>")) for i, c in enumerate(sides)])).alias("m"))
    known = lexicon_.select("term", F.lit(True).alias("known"))

    def code(of: Column) -> Column:
        codes = F.collect_list(of)
        return F.when(F.size(codes) > 0, F.substring(F.md5(F.array_join(F.sort_array(codes), ",")), 1, 8))

    def part(up: int, h: str) -> Column:
        return F.concat_ws("", F.col("level") + up, F.lit("."), F.col("subset"), F.when(F.col("known"), "=").otherwise("u="), F.col(h))

    hashed = (every.select(*key, "m.*").join(F.broadcast(known) if small else known, "term", "left")
              .groupBy(*key, "side", "level", "subset", F.coalesce("known", F.lit(False)).alias("known"))
              .agg(code(F.col("code")).alias("h"), code(F.when(F.col("up"), F.col("code"))).alias("thin"), F.first("about", True).alias("about")))
    pair = F.array_compact(F.array(F.when(F.col("h").isNotNull(), part(0, "h")), F.when(F.col("thin").isNotNull(), part(1, "thin"))))
    parts = (hashed.select(*key, "about", F.struct("side", "known", pair.alias("pair")).alias("p"))
             .groupBy(*key).agg(F.first("about", True).alias("about"), F.collect_list("p").alias("parts")))

    def joined(i: int) -> Column:
        mine = F.filter("parts", lambda p: p["side"] == i)
        return _bound(F.struct(F.flatten(F.transform(mine, lambda p: p["pair"])).alias("all"),
                               F.flatten(F.transform(F.filter(mine, lambda p: p["known"]), lambda p: p["pair"])).alias("known")),
                      lambda p: F.array_join(F.sort_array(F.when(F.size(p["known"]) < FEW_HASHES, p["all"]).otherwise(p["known"])), " "))

    return parts.select(*key, "about.*", F.array(*[joined(i) for i in range(len(sides))]).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, from 0 to 1."""
    def levels(p: Column) -> Column:
        return F.array_distinct(F.transform(p, lambda x: F.substring_index(x, ".", 1)))

    def lexicons(p: Column, shared: Column) -> Column:
        return F.transform(F.filter(p, lambda x: F.array_contains(shared, F.substring_index(x, ".", 1))), lambda x: F.substring_index(x, "=", 1))

    def share(pa: Column, pb: Column, shared: Column) -> Column:
        touched = F.size(F.array_union(lexicons(pa, shared), lexicons(pb, shared)))
        return F.when(touched == 0, 0.0).otherwise(F.size(F.array_intersect(pa, pb)) / touched)

    both = F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b"))
    some = _bound(both, lambda p: _bound(F.array_intersect(levels(p["a"]), levels(p["b"])), lambda shared: share(p["a"], p["b"], shared)))
    return F.when(a == b, 1.0).otherwise(some)


def _bucket(k: Column, edges: list[int]) -> Column:
    """How many of the sorted `edges` lie below k, by halving."""
    if not edges:
        return F.lit(0)
    values = F.array(*[F.lit(e) for e in edges])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(edges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(at + s <= len(edges), F.when(F.get(values, at + s - 1) < k, at + s).otherwise(at)).otherwise(at))


def neighbours(docs: DataFrame, columns: list[str], bucket_rows: int | None = None) -> DataFrame:
    """`docs` (doc_id, text without nulls, ...) with `bucket`, `place` (unique inside it) and `next_text`, that of the next smaller id.

    Rows with `guest` > 0 are copies of the first rows of the bucket that follows. After the last document comes the first; nulls count as the smallest id. Few numbers of cut points come to the driver: one for each
    `BUCKET_BYTES` of text.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    facts = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first()
    wanted = int(max(1, min(max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), facts["bytes"] // BUCKET_BYTES), facts["n"] // (bucket_rows or MIN_BUCKET_ROWS))))
    cuts = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        cuts = sorted(set(docs.select(F.percentile_approx(k, shares, 100 * wanted).alias("c")).first()["c"] or []))
    # the cut points are approximate; the largest id of each bucket is exact
    edges = sorted(r["k"] for r in docs.select(k.alias("k")).groupBy(_bucket(F.col("k"), cuts).alias("b")).agg(F.max("k").alias("k")).collect())
    own = docs.select("doc_id", *columns, k.alias("k")).withColumn("home", _bucket(F.col("k"), edges))
    last, only = (edges[-1] if edges else 0), len(edges) <= 1
    first_of = F.get(F.array(*[F.lit(e) for e in edges]), F.col("home")) if edges else F.lit(0)
    to = [F.when(F.col("k") == last, F.lit(0))] + ([] if only else [F.when((F.col("k") == first_of) & (F.col("home") < len(edges) - 1), F.col("home") + 1)])
    places = F.concat(F.array(F.struct(F.col("home").alias("bucket"), F.lit(0).alias("guest"))),
                      F.transform(F.array_compact(F.array(*to)), lambda b: F.struct(b.alias("bucket"), F.when(b == 0, 2).otherwise(1).alias("guest"))))
    dealt = own.select("*", F.inline(places)).drop("home")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("k").desc(), "text")
    return (dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
            .drop("k"))


def edited(text: Column, n_chars: Column, next_text: Column) -> Column:
    """`text` with its last third replaced by as much of the beginning of `next_text`."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - third), F.substring(next_text, F.lit(1), third))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of `docs` (doc_id, text)."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = stage(lexicon(whole), "imatch-lexicon")
    small = words.count() <= SMALL_TERMS
    placed = neighbours(whole, ["text"]).withColumn("n_chars", F.char_length("text"))
    mine = F.col("guest") == 0
    texts = placed.withColumn("edited", F.when(mine, edited(F.col("text"), F.col("n_chars"), F.col("next_text"))))
    texts = texts.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    prints = fingerprints(texts, ["bucket", "place"], ["text", "edited"], ["doc_id", "n_chars", "edited_sha256", "guest"], words, small)
    own, new = F.col("fp")[0], F.col("fp")[1]
    following = F.lead(own).over(Window.partitionBy("bucket").orderBy("place"))
    return prints.withColumn("following", following).filter(mine).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", own.alias("fingerprint"), new.alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, F.col("following")).alias("near_next"))


def fingerprint_sql() -> str:
    """The same in DuckDB SQL, over one global window and with the lexicon joined by plain joins."""
    term = TERM.replace("'", "''")
    return rf"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS text FROM documents),
near AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY r), first(text) OVER (ORDER BY r)) AS next_text FROM docs),
edit AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) AS edited FROM near),
sides AS (SELECT r, 0 AS side, text AS t FROM edit UNION ALL SELECT r, 1, edited FROM edit UNION ALL SELECT r, 2, next_text FROM edit),
words AS (SELECT r, side, list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS ws FROM sides),
freq AS (SELECT w, count(*) AS df FROM (SELECT unnest(ws) AS w FROM words WHERE side = 0) GROUP BY w),
lexicon AS (SELECT w FROM freq, (SELECT count(*) AS n FROM docs)
  WHERE df >= greatest(2.0::DOUBLE, {RARE}::DOUBLE * n) AND df <= greatest(2.0::DOUBLE, {FREQUENT}::DOUBLE * n)),
levels AS (SELECT r, side, ws, greatest(0, length(bin(len(ws))) - {FULL_BITS}) AS level FROM words),
marks AS (SELECT r, side, level + up AS level, w, md5(w) AS d FROM (SELECT r, side, level, unnest(ws) AS w FROM levels), (VALUES (0), (1)) u(up)),
kept AS (SELECT m.*, l.w IS NOT NULL AS known FROM marks m LEFT JOIN lexicon l ON l.w = m.w
  WHERE level = 0 OR substr(d, 1, 6) < lower(lpad(to_hex(16777216 >> level), 6, '0'))),
parts AS (SELECT r, side, known, level || '.' || (('0x' || substr(d, 7, 2))::INT % {SUBSETS}) || CASE WHEN known THEN '=' ELSE 'u=' END AS lex,
    lex || substr(md5(string_agg(substr(d, 9, 16), ',' ORDER BY substr(d, 9, 16))), 1, 8) AS part FROM kept GROUP BY r, side, known, level, lex),
best AS (SELECT * FROM parts QUALIFY known OR count(*) FILTER (known) OVER (PARTITION BY r, side) < {FEW_HASHES}),
prints AS (SELECT s.r, s.side, coalesce(string_agg(part, ' ' ORDER BY part), '') AS fp FROM sides s LEFT JOIN best b ON b.r = s.r AND b.side = s.side GROUP BY s.r, s.side),
wide AS (SELECT r, max(fp) FILTER (side = 0) AS a, max(fp) FILTER (side = 1) AS b, max(fp) FILTER (side = 2) AS c FROM prints GROUP BY r),
pairs AS (SELECT r, 1 AS side, a AS p, b AS q FROM wide UNION ALL SELECT r, 2, a, c FROM wide),
split AS (SELECT r, side, p, q, string_split(p, ' ') AS ps, string_split(q, ' ') AS qs FROM pairs),
shared AS (SELECT *, list_intersect([split_part(x, '.', 1) FOR x IN ps], [split_part(x, '.', 1) FOR x IN qs]) AS levs FROM split),
likes AS (SELECT r, side, CASE WHEN p = q THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(ps, qs))::DOUBLE
    / nullif(len(list_distinct([split_part(x, '=', 1) FOR x IN list_concat(ps, qs) IF list_contains(levs, split_part(x, '.', 1))])), 0), 0) END AS likeness FROM shared)
SELECT e.doc_id, e.n_chars::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, w.a AS fingerprint, w.b AS edited_fingerprint, x.likeness AS near_edited, y.likeness AS near_next
FROM edit e JOIN wide w ON w.r = e.r JOIN likes x ON x.r = e.r AND x.side = 1 JOIN likes y ON y.r = e.r AND y.side = 2"""

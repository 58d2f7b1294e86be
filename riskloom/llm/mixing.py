"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document is due `target / source size` copies of itself. The whole copies are certain; the fraction left is its inclusion
probability. Documents are ranked by random odds divided by inclusion odds (Pareto order sampling) and taken in that order until the
words still due to the source are reached: the sample's size is fixed, in words. At most one further document a source, the one whose
size comes nearest to what is left, closes the gap that whole documents leave. Running sums go over bins of the rank's logarithm first, and
over the documents of one fine bin a source last.

Random numbers come from a keyed digest of the document id, so that reruns and other engines agree.

Defined results: a null or empty text has size 0 and takes 0; a null id is drawn like the empty id; rows that agree in id, size and
source are taken together; a source without words gets target 0; an empty table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import stage

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
#: Coarse and fine bins of the rank's logarithm: only one fine bin a source is ever sorted.
COARSE, FINE = 64, 4096
#: Per-source tables up to this many rows go to every executor; beyond it the joins are shuffled.
SMALL_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> with `target`: shares by weight 1, 2, 3, repeating, of all words, none above `max_copies` sizes.

    Sources are filled in the order in which they reach their limit: when the level no longer lifts the next one above its limit,
    it is the final level.
    """
    cap = F.lit(max_copies) * F.col("source_size")
    catalogue = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (sizes.withColumn("place", F.row_number().over(catalogue))
              .withColumn("weight", (F.col("place") - 1) % 3 + 1).withColumn("cap", cap)
              .withColumn("stop", F.row_number().over(by_limit))
              .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
                          / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))))
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("stop", "level"))).over(whole)["level"]
    return (ranked.withColumn("final", final)
            .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target")))


def _with_small(big: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    """Join per-source facts; `few` says that their number was checked."""
    right = small.withColumnRenamed("source", "of_source")
    return big.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")


def ranked(docs: DataFrame, aims: DataFrame, few: bool, seed: str) -> DataFrame:
    """`docs` (doc_id, source, size, ...) with whole copies, words still due to the source (`rest`), rank `q` and the bins of its logarithm.

    q is null for documents that can't be drawn: those of size 0, or without a fraction of a copy due.
    """
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(2 ** 48))
    frac = F.col("due") - F.col("whole")
    return (_with_small(docs, aims, few).withColumn("due", due).withColumn("whole", F.floor("due")).withColumn("u", u)
            .withColumn("q", F.when((frac > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (frac / (1 - frac))))
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .withColumn("z", F.log2("q") * COARSE).withColumn("b1", F.floor("z"))
            .withColumn("b2", F.floor((F.col("z") - F.col("b1")) * FINE)).drop("z", "due", "u"))


def cut(rows: DataFrame, bin_: str, limit: Column) -> DataFrame:
    """The bin of each source in which the running sum of sizes passes `limit`, and the sum before it."""
    upto = Window.partitionBy("source").orderBy(bin_)
    bins = rows.groupBy("source", bin_).agg(F.sum("size").alias("words"), F.first(limit).alias("limit"))
    return (bins.withColumn("upto", F.sum("words").over(upto)).filter(F.col("upto") > F.col("limit"))
            .groupBy("source").agg(F.min(F.struct(F.col(bin_).alias("bin"), (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
            .select("source", F.col("x.bin").alias(f"cut_{bin_}"), F.col("x.before").alias(f"before_{bin_}")))


def place() -> Column:
    return F.struct("q", "size", "doc_id")


def drawn() -> Column:
    """Whether the draw takes a document, by the cuts of its source (cut_b1, cut_b2, last)."""
    before = (F.col("cut_b1").isNull() | (F.col("b1") < F.col("cut_b1"))
              | ((F.col("b1") == F.col("cut_b1")) & (F.col("cut_b2").isNull() | (F.col("b2") < F.col("cut_b2")))))
    at = (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2"))
    return F.col("q").isNotNull() & F.coalesce(before | (at & (place() <= F.col("last"))), F.lit(False))


def mix(docs: DataFrame, seed: str = "mix", max_copies: int = MAX_COPIES) -> DataFrame:
    """`docs` (doc_id, source, text, ...) with size, source_size, target, copies and taken.

    Sizes are summed and ranked in a narrow table; what was found out about each source then decides every row, without a join of rows.
    """
    fields = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    sized = docs.select(*fields).withColumn("size", word_count(F.col("text")))
    base = stage(sized.select("doc_id", "source", "size"), "mix-sizes")
    aims = stage(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), max_copies), "mix-targets")
    few = aims.count() <= SMALL_ROWS
    rows = stage(ranked(base, aims, few, seed).filter(F.col("q").isNotNull()).select("doc_id", "source", "size", "rest", "q", "b1", "b2"), "mix-ranked")

    first = stage(cut(rows, "b1", F.col("rest")), "mix-coarse")
    inside = _with_small(rows, first, few).filter(F.col("b1") == F.col("cut_b1"))
    second = stage(cut(inside, "b2", F.col("rest") - F.col("before_b1")), "mix-fine")
    bounds = _with_small(first, second, few)
    # only the fine bin at the cut is sorted; rows that agree in rank, size and id are one group, of which a whole number is taken
    alike = (_with_small(rows, bounds, few).filter((F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2")))
             .groupBy("source", "q", "size", "doc_id").agg(F.count("*").alias("n"), F.first("rest").alias("rest"), F.first(F.col("before_b1") + F.col("before_b2")).alias("start")))
    upto = F.col("start") + F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("q", "size", "doc_id"))
    fits = F.floor((F.col("rest") - F.col("upto") + F.col("size") * F.col("n")) / F.col("size"))
    at_cut = (alike.withColumn("upto", upto).groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), place())).alias("last"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.struct("q", "size", "doc_id", fits.cast("long").alias("n")))).alias("part")))
    cuts = stage(_with_small(bounds, at_cut, few), "mix-cuts")

    taken = _with_small(rows, cuts, few).withColumn("taken", drawn())
    part_words = F.coalesce(F.col("part.n") * F.col("part.size"), F.lit(0))
    gaps = stage(taken.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)) - F.first(part_words)).alias("gap")), "mix-gaps")
    off = F.abs(F.col("size") - F.col("gap"))
    nearest = (_with_small(taken, gaps, few).filter(~F.col("taken") & (off < F.col("gap"))).groupBy("source")
               .agg(F.min(F.struct(off.alias("off"), "q", "size", "doc_id")).alias("n"))
               .select("source", F.struct(F.col("n.q").alias("q"), F.col("n.size").alias("size"), F.col("n.doc_id").alias("doc_id")).alias("closing")))
    facts = stage(_with_small(_with_small(aims, cuts, few), nearest, few), "mix-facts")
    at_part = F.coalesce(place().eqNullSafe(F.struct(F.col("part.q").alias("q"), F.col("part.size").alias("size"), F.col("part.doc_id").alias("doc_id"))), F.lit(False))
    at_closing = F.coalesce(place().eqNullSafe(F.col("closing")), F.lit(False))
    # how many of the rows that agree with it a row at one of these places shares with; null at all other places
    quota = F.when(F.col("q").isNotNull() & ~drawn() & (at_part | at_closing),
                   F.when(at_part, F.coalesce(F.col("part.n"), F.lit(0))).otherwise(0) + at_closing.cast("long"))
    decided = ranked(sized, facts, few, seed).withColumn("extra", drawn().cast("long")).withColumn("quota", quota)
    split = _with_small(rows, facts, few).filter(quota.isNotNull()).groupBy("source", "q", "size", "doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if split.isEmpty():
        chosen = decided.withColumn("extra", F.coalesce("quota", "extra"))
    else:
        chosen = decided.filter("quota IS NULL").unionByName(_numbered(decided.filter("quota IS NOT NULL")))
    return (chosen.withColumn("copies", F.col("whole").cast("long") + F.col("extra"))
            .withColumn("taken", F.col("copies") * F.col("size")).select(*fields, "size", "source_size", "target", "copies", "taken"))


def _numbered(rows: DataFrame) -> DataFrame:
    """`extra` of rows that share a `quota`: the first ones by text take it. Numbers go through parts of a group, so that a large one is spread."""
    group = ["source", "doc_id", "size"]
    rows = rows.withColumn("part_of", F.pmod(F.xxhash64("text"), F.lit(64)))
    sizes = rows.groupBy(*group, "part_of").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("part_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"g_{c}").eqNullSafe(F.col(c)) for c in (*group, "part_of")]
    starts = sizes.withColumn("before", before).select(*[F.col(c).alias(f"g_{c}") for c in (*group, "part_of")], "before")
    number = F.col("before") + F.row_number().over(Window.partitionBy(*group, "part_of").orderBy("text"))
    return (rows.join(starts, same[0] & same[1] & same[2] & same[3]).withColumn("extra", (number <= F.col("quota")).cast("long"))
            .drop("part_of", "before", *[f"g_{c}" for c in (*group, "part_of")]))


def mix_sql(docs: str = "documents", seed: str = "mix") -> str:
    """The same mix in DuckDB SQL, with windows over whole sources."""
    return rf"""
base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM base GROUP BY source),
weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight, {MAX_COPIES} * source_size AS cap FROM sizes),
levels AS (SELECT *, row_number() OVER o AS stop,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, place), p AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, stop) FROM levels WHERE level * weight <= cap) * weight) AS target FROM levels),
due AS (SELECT b.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS due,
    (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM base b JOIN aims a ON a.source IS NOT DISTINCT FROM b.source),
ranked AS (SELECT *, floor(due) AS whole, target - floor(due) * source_size AS rest,
    CASE WHEN due - floor(due) > 0 AND size > 0 THEN (u / (1 - u)) / ((due - floor(due)) / (1 - (due - floor(due)))) END AS q FROM due),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM ranked),
drawn AS (SELECT *, CASE WHEN q IS NOT NULL AND upto <= rest THEN 1 ELSE 0 END AS extra FROM summed),
gaps AS (SELECT *, rest - sum(size * extra) OVER (PARTITION BY source) AS gap FROM drawn),
near AS (SELECT *, q IS NOT NULL AND extra = 0 AND abs(size - gap) < gap AS spare FROM gaps),
closed AS (SELECT *, CASE WHEN spare AND row_number() OVER (PARTITION BY source, spare ORDER BY abs(size - gap), q, size, doc_id) = 1
    THEN 1 ELSE extra END AS more FROM near),
mixed AS (SELECT doc_id, size, source_size, target, ((whole + more) * size)::BIGINT AS taken FROM closed)"""

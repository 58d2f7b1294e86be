"""First-in-first-out matching of outgoing to earlier incoming money, without a task that holds an entity.

Money in is laid out on a line, credit after credit. An outflow takes the next stretch of that line that is neither taken, nor too old, nor still to
come: with `h` the end of what was taken or lost before, E the end of the credits that are too old for the outflow and I the end of those that had come,
the outflow of value o moves the end to min(max(h, E) + o, I). Such moves are of the form min(max(h + a, b), c), and so are sequences of them. Every
stretch of an entity's time line is therefore summarised by three numbers, in any order and anywhere; the summaries, put one after the other, give
the state in which each stretch begins, and only then are its outflows walked through, a few dozen at a time.

Rows are summed per (entity, second) first, so that an entity has at most one row a second, and its time line is worked on by weeks ("day" names such a stretch below). Amounts are whole
cents. Credits of one second are interchangeable, as are outflows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.numeric import rnd, top_k
from riskloom.operators.profile import done, is_in, is_out
from riskloom.operators.quantiles import exact_quantiles, value_counts
from riskloom.session import stage

#: Seconds of a stretch ("day") of the time line that is worked on as one, a week; most entities have few rows a day, and each stretch has its price.
DAY = 7 * 86_400
#: Outflows that are walked through in one go, and a number beyond any sum of cents.
WALK, FAR = 64, 10 ** 17


def flow_seconds(legs: DataFrame, keys: list[str], inbound) -> DataFrame:
    """(keys, sec, money in and out in cents, first ids, number of credits): completed credits that satisfy `inbound`, and completed outflows."""
    taken = is_in() & inbound
    cents = F.round(F.col("amount_usd").cast("decimal(18,2)") * 100).cast("long")
    side = F.when(is_out(), "out").when(taken, "in")
    rows = legs.filter(done()).withColumn("side", side).filter("side IS NOT NULL").select(*keys, "side", "sec", cents.alias("cents"), "transaction_id")

    def of(side: str, c: Column) -> Column:
        return F.when(F.col("side") == side, c)

    return rows.groupBy(*keys, "sec").agg(
        F.coalesce(F.sum(of("in", F.col("cents"))), F.lit(0)).alias("in_cents"), F.coalesce(F.sum(of("out", F.col("cents"))), F.lit(0)).alias("out_cents"),
        F.min(of("in", F.col("transaction_id"))).cast("string").alias("in_id"), F.min(of("out", F.col("transaction_id"))).cast("string").alias("out_id"),
        F.count(of("in", F.lit(1))).alias("n_in"))


def _move(h: Column, m: Column) -> Column:
    return F.least(F.greatest(h + m["a"], m["b"]), m["c"])


def _then(first: Column, second: Column) -> Column:
    """The move that makes `first` and then `second`."""
    return F.struct((first["a"] + second["a"]).alias("a"), F.greatest(first["b"] + second["a"], second["b"]).alias("b"),
                    F.least(F.greatest(first["c"] + second["a"], second["b"]), second["c"]).alias("c"))


def _stay() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(-FAR).cast("long").alias("b"), F.lit(FAR).cast("long").alias("c"))


def _of_outflow(o: Column) -> Column:
    return F.struct(o["out_cents"].alias("a"), (o["too_old"] + o["out_cents"]).alias("b"), o["come"].alias("c"))


def _placed(flow: DataFrame, keys: list[str], horizon: int) -> tuple[DataFrame, DataFrame]:
    """Credits with their stretch of the line (from, to), and outflows with the ends of what is too old and of what has come."""
    marks = flow.filter("out_cents > 0").select(*keys, (F.col("sec") - horizon).alias("sec"), F.lit(0).cast("long").alias("in_cents"), F.lit(0).cast("long").alias("out_cents"),
                                                F.lit(None).cast("string").alias("in_id"), F.lit(None).cast("string").alias("out_id"), F.col("sec").alias("for_sec"))
    rows = flow.select(*keys, "sec", "in_cents", "out_cents", "in_id", "out_id", F.lit(None).cast("long").alias("for_sec")).unionByName(marks)
    rows = rows.withColumn("day", F.floor(F.col("sec") / DAY))
    days = rows.groupBy(*keys, "day").agg(F.sum("in_cents").alias("day_in"))
    before_day = F.coalesce(F.sum("day_in").over(W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select(*keys, "day", before_day.alias("before_day"))
    inside = W.partitionBy(*keys, "day").orderBy("sec")
    rows = (rows.join(days, [*keys, "day"])
            .withColumn("before", F.col("before_day") + F.coalesce(F.sum("in_cents").over(inside.rangeBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("upto", F.col("before_day") + F.sum("in_cents").over(inside.rangeBetween(W.unboundedPreceding, 0))))
    rows = stage(rows.drop("before_day"), "fifo-rows")
    credits = rows.filter("in_cents > 0").select(*keys, "day", F.col("sec").alias("in_sec"), "in_id", F.col("before").alias("from"), F.col("upto").alias("to"))
    out = (rows.filter("out_cents > 0 OR for_sec IS NOT NULL").withColumn("at", F.coalesce("for_sec", "sec"))
           .groupBy(*keys, "at").agg(F.max("out_cents").alias("out_cents"), F.max("out_id").alias("out_id"),
                                     F.max(F.when(F.col("for_sec").isNotNull(), F.col("before"))).alias("too_old"),
                                     F.max(F.when(F.col("for_sec").isNull(), F.col("upto"))).alias("come")))
    return credits, out.withColumnRenamed("at", "sec").withColumn("day", F.floor(F.col("sec") / DAY))


def taken(outflows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, out_sec, out_id, from, to): the stretch that each outflow takes, if it takes any."""
    order = W.partitionBy(*keys, "day").orderBy("sec")
    walks = outflows.withColumn("walk", F.floor((F.row_number().over(order) - 1) / WALK))
    outs = F.array_sort(F.collect_list(F.struct("sec", "out_cents", "too_old", "come", "out_id")))
    walks = walks.groupBy(*keys, "day", "walk").agg(outs.alias("outs"))
    walks = stage(walks.withColumn("move", F.aggregate("outs", _stay(), lambda m, o: _then(m, _of_outflow(o)))), "fifo-walks")
    day = walks.groupBy(*keys, "day").agg(F.array_sort(F.collect_list(F.struct("walk", "move"))).alias("walks"))
    # the moves of a day before each of its walks, and all of them together
    start = F.struct(_stay().alias("so_far"), F.array().cast("array<struct<walk:bigint,move:struct<a:bigint,b:bigint,c:bigint>>>").alias("before"))
    folded = F.aggregate("walks", start, lambda s, w: F.struct(
        _then(s["so_far"], w["move"]).alias("so_far"), F.array_append(s["before"], F.struct(w["walk"].alias("walk"), s["so_far"].alias("move"))).alias("before")))
    day = stage(day.withColumn("f", folded).select(*keys, "day", F.col("f.so_far").alias("move"), F.col("f.before").alias("before")), "fifo-days")
    all_days = day.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "move"))).alias("days"))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.array().cast("array<struct<day:bigint,h:bigint>>").alias("begins"))
    begins = F.aggregate("days", start, lambda s, d: F.struct(
        _move(s["h"], d["move"]).alias("h"), F.array_append(s["begins"], F.struct(d["day"].alias("day"), s["h"].alias("h"))).alias("begins")))
    begins = all_days.select(*keys, F.explode(begins["begins"]).alias("x")).select(*keys, "x.day", F.col("x.h").alias("h"))
    at_walk = day.select(*keys, "day", F.explode("before").alias("x")).join(begins, [*keys, "day"]).select(*keys, "day", "x.walk", _move(F.col("h"), F.col("x.move")).alias("h"))
    stretches = F.array().cast("array<struct<out_sec:bigint,out_id:string,from:bigint,to:bigint>>")

    def step(s: Column, o: Column) -> Column:
        begin = F.greatest(s["h"], o["too_old"])
        end = F.least(begin + o["out_cents"], o["come"])
        return F.struct(end.alias("h"), F.array_append(s["all"], F.struct(o["sec"].alias("out_sec"), o["out_id"].alias("out_id"), begin.alias("from"), end.alias("to"))).alias("all"))

    walked = walks.join(at_walk, [*keys, "day", "walk"]).withColumn("s", F.aggregate("outs", F.struct(F.col("h").alias("h"), stretches.alias("all")), step))
    return walked.select(*keys, F.inline("s.all")).filter(F.col("to") > F.col("from"))


def slices(flow: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """(keys, in_sec, in_id, out_sec, out_id, cents, place): which credit paid which outflow, in order of `place`.

    A slice ends where a credit ends or where an outflow ends; the other side is the next to end after that. Both are met in the days of the credits, so
    the line of an entity is never in one task.
    """
    credits, outflows = _placed(flow, keys, horizon)
    outs = stage(taken(outflows, keys), "fifo-taken")
    ends = credits.groupBy(*keys, "day").agg(F.min("from").alias("begin"), F.max("to").alias("end"))
    # a short list for each entity: the days that have credits, and their stretches of the line
    table = ends.groupBy(*keys).agg(F.collect_list(F.struct("begin", "end", "day")).alias("days"))
    touched = F.filter("days", lambda d: (d["end"] > F.col("from")) & (d["begin"] < F.col("to")))
    dealt = outs.join(table, keys).select(*keys, F.explode(touched).alias("d"), "out_sec", "out_id", "from", "to")
    none = F.lit(None)
    events = (dealt.select(*keys, F.col("d.day").alias("day"), F.col("to").alias("at"), F.lit(0).alias("kind"), "out_sec", "out_id", F.col("from").alias("out_from"),
                           none.cast("long").alias("in_sec"), none.cast("string").alias("in_id"), none.cast("long").alias("in_from"))
              .unionByName(credits.select(*keys, "day", F.col("to").alias("at"), F.lit(1).alias("kind"), none.cast("long").alias("out_sec"), none.cast("string").alias("out_id"),
                                          none.cast("long").alias("out_from"), "in_sec", "in_id", F.col("from").alias("in_from"))))
    ahead = W.partitionBy(*keys, "day").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, -1)
    credit, outflow = F.struct("in_sec", "in_id", "in_from"), F.struct("out_sec", "out_id", "out_from")
    met = (events.withColumn("next_in", F.last(F.when(F.col("kind") == 1, credit), True).over(ahead))
           .withColumn("next_out", F.last(F.when(F.col("kind") == 0, outflow), True).over(ahead)))
    c = F.when(F.col("kind") == 1, credit).otherwise(F.col("next_in"))
    o = F.when(F.col("kind") == 0, outflow).otherwise(F.col("next_out"))
    both = met.select(*keys, "at", "kind", c.alias("c"), o.alias("o")).filter(
        F.col("c").isNotNull() & F.col("o").isNotNull() & ((F.col("kind") == 0) | (F.col("o.out_from") < F.col("at"))))
    return both.select(*keys, "c.in_sec", "c.in_id", "o.out_sec", "o.out_id",
                       (F.col("at") - F.greatest("c.in_from", "o.out_from")).alias("cents"), F.col("at").alias("place"))


def pass_through(legs: DataFrame, keys: list[str], hours: float, types: tuple[str, ...], pairs: int = 8) -> DataFrame:
    """Share of inbound value that left within the horizon; `pairs` holds ids of the first matched seconds, as many as asked for.

    Without pairs it is enough to know how long a stretch each outflow takes.
    """
    flow = stage(flow_seconds(legs, keys, F.col("transaction_type").isin(*types)), "fifo-seconds")
    came = flow.groupBy(*keys).agg(F.sum("in_cents").alias("inbound"), F.sum("n_in").alias("n_inbound")).filter("n_inbound > 0")
    if not pairs:
        outs = taken(_placed(flow, keys, round(hours * 3600))[1], keys)
        moved = outs.groupBy(*keys).agg(F.sum(F.col("to") - F.col("from")).alias("matched")).withColumn("pairs", F.array().cast("array<string>"))
    else:
        moved = _moved_with_pairs(flow, keys, hours, pairs)
    usd = {c: F.coalesce(F.col(c), F.lit(0)) / 100 for c in ("inbound", "matched")}
    return came.join(moved, keys, "left").select(
        *keys, F.when(F.col("inbound") > 0, rnd(usd["matched"] / usd["inbound"], 4)).otherwise(0.0).alias("ratio"), rnd(usd["inbound"]).alias("inbound_usd"),
        rnd(usd["matched"]).alias("matched_usd"), "n_inbound", F.coalesce("pairs", F.array().cast("array<string>")).alias("pairs"))


def _moved_with_pairs(flow: DataFrame, keys: list[str], hours: float, pairs: int) -> DataFrame:
    met = stage(slices(flow, keys, round(hours * 3600)), "fifo-slices")
    moved = met.groupBy(*keys).agg(F.sum("cents").alias("matched"))
    first = top_k(met, keys, [F.col("place")], pairs).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.array("in_id", "out_id").alias("ids")))).alias("x"))
    return moved.join(first.select(*keys, F.flatten(F.transform("x", lambda v: v["ids"])).alias("pairs")), keys, "left")


def fifo_dwell(legs: DataFrame, keys: list[str], hours: float, ids_kept: int = 10) -> DataFrame:
    """Queue matching of transfers in to completed outflows: matched value, median dwell hours, consuming ids."""
    flow = stage(flow_seconds(legs, keys, F.col("other_account").isNotNull()), "fifo-seconds")
    met = stage(slices(flow, keys, round(hours * 3600)), "fifo-slices")
    moved = met.groupBy(*keys).agg(F.sum("cents").alias("matched"))
    dwell = met.withColumn("dwell", (F.col("out_sec") - F.col("in_sec")).cast("double"))
    median = exact_quantiles(value_counts(dwell, keys, "dwell"), keys, {"median": 0.5}).select(*keys, (F.col("median") / 3600.0).alias("median_dwell_hours"))
    paid = met.groupBy(*keys, "out_sec").agg(F.first("out_id").alias("out_id"))
    ids = top_k(paid, keys, [F.col("out_sec")], ids_kept).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("out_sec", "out_id"))).alias("x"))
    ids = ids.select(*keys, F.transform("x", lambda v: v["out_id"]).alias("moved_ids"))
    return flow.select(*keys).distinct().join(moved, keys, "left").join(median, keys, "left").join(ids, keys, "left").select(
        *keys, (F.coalesce("matched", F.lit(0)) / 100).alias("matched_usd"), "median_dwell_hours", F.coalesce("moved_ids", F.array().cast("array<string>")).alias("moved_ids"))

"""Detection quality on labelled data. Labels are read here only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.numeric import rnd, top_k


def confusion(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn of boolean `truth` against boolean `predicted`."""
    t, p = F.col("truth"), F.col("predicted")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*keys).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))


def share(num: Column, den: Column, missing: float | None) -> Column:
    return F.when(den > 0, rnd(num / den, 4)).otherwise(F.lit(missing))


def rates(cm: DataFrame, missing: float | None = None) -> DataFrame:
    """Precision, recall, F1, false-positive and false-negative rate; `missing` stands for an undefined one."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = cm.withColumn("precision", share(tp, tp + fp, missing)).withColumn("recall", share(tp, tp + fn, missing))
    # 2PR / (P + R) = 2tp / (2tp + fp + fn); 0 when both are defined and tp is 0
    f1 = F.when((tp + fp > 0) & (tp + fn > 0), rnd(2 * tp / (2 * tp + fp + fn), 4)).otherwise(F.lit(missing))
    return out.withColumn("f1", f1).withColumn("false_positive_rate", share(fp, fp + tn, missing)).withColumn("false_negative_rate", share(fn, fn + tp, missing))


def _score_steps(rows: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score. Scores are points rounded to tenths between 0 and 100, so there are at
    most 1,001 of them and the running totals over them are small."""
    return rows.groupBy(rnd(F.col("score"), 1).alias("score")).agg(F.count(F.when(F.col("truth"), 1)).alias("pos"), F.count(F.when(~F.col("truth"), 1)).alias("neg"))


def roc_auc(rows: DataFrame, missing: float | None = None) -> DataFrame:
    """Probability that a positive outranks a negative, ties one half, from cumulative counts."""
    below = W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    s = _score_steps(rows).withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    a = s.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return a.select(F.when((F.col("p") > 0) & (F.col("n") > 0), rnd(F.col("wins") / (F.col("p") * F.col("n")), 4)).otherwise(F.lit(missing)).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Area under the precision-recall steps, one step per distinct score; null with one class only."""
    upto = W.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    s = _score_steps(rows).withColumn("tp", F.sum("pos").over(upto)).withColumn("all", F.sum(F.col("pos") + F.col("neg")).over(upto))
    a = s.agg(F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return a.select(F.when((F.col("p") > 0) & (F.col("n") > 0), rnd(F.col("s") / F.col("p"), 4)).alias("average_precision"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query P@k, R@k and reciprocal rank. `ranked` (query_id, id, rank), `relevant` (query_id, id)."""
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    j = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    aggs = [F.count(F.when((F.col("hit") == 1) & (F.col("rank") <= k), 1)).alias(f"h{k}") for k in ks]
    h = n.join(j.groupBy("query_id").agg(*aggs, F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")), "query_id", "left").fillna(0, [f"h{k}" for k in ks])
    cols = [c for k in ks for c in (rnd(F.col(f"h{k}") / k, 4).alias(f"p_at_{k}"), rnd(F.least(F.col(f"h{k}"), F.col("n_relevant")) / F.col("n_relevant"), 4).alias(f"r_at_{k}"))]
    return h.select("query_id", *cols, F.coalesce(rnd(1.0 / F.col("first"), 4), F.lit(0.0)).alias("reciprocal_rank"))


def mean_quality(per_query: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    metrics = [c for c in per_query.columns if c not in ("query_id", *keys)]
    return per_query.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), *[rnd(F.avg(c), 4).alias("mrr" if c == "reciprocal_rank" else c) for c in metrics])


def one_label_per_subject(labels: DataFrame, order: str) -> DataFrame:
    """Customer labels, one per customer, a suspicious one preferred, then the first by `order`."""
    rows = labels.filter("entity_type = 'customer'")
    return top_k(rows, ["entity_id"], [F.col("is_suspicious").desc(), F.col(order)], 1).drop("rank")


def stratified_sample(labels: DataFrame, per_scenario: int, seed: int = 11) -> DataFrame:
    """A fixed number of subjects per scenario, three times as many of 'normal', in seeded digest order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("entity_id").cast("string")))
    ranked = top_k(labels.withColumn("digest", digest), ["scenario"], [F.col("digest")], 3 * per_scenario)
    return ranked.filter((F.col("scenario") == "normal") | (F.col("rank") <= per_scenario)).drop("digest")


def scenario_report(labels: DataFrame, scored: DataFrame, signals: DataFrame) -> DataFrame:
    """Per scenario: size, flag rate, mean score and the share of expected rules that fired."""
    hits = (labels.select("entity_id", F.explode("expected_signals").alias("detector")).join(signals.select("entity_id", "detector").distinct(), ["entity_id", "detector"], "left_semi")
            .groupBy("entity_id").agg(F.count(F.lit(1)).alias("hit")))
    j = labels.join(scored.select("entity_id", "score", "flagged"), "entity_id", "left").join(hits, "entity_id", "left").fillna(0, ["score", "hit"]).fillna(False, ["flagged"])
    expected = F.size("expected_signals")
    return j.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.max("is_suspicious").alias("suspicious"), rnd(F.count(F.when(F.col("flagged"), 1)) / F.count(F.lit(1)), 4).alias("flag_rate"),
        rnd(F.sum(F.col("score").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 2).alias("mean_score"),
        rnd(F.avg(F.when(expected > 0, F.col("hit") / expected)), 4).alias("expected_signal_recall"))


def signal_precision(labels: DataFrame, signals: DataFrame) -> DataFrame:
    """Share of suspicious subjects among those on whom each rule fired."""
    j = signals.select("entity_id", "detector").distinct().join(labels.select("entity_id", "is_suspicious"), "entity_id")
    return j.groupBy("detector").agg(F.count(F.lit(1)).alias("fired"), rnd(F.count(F.when(F.col("is_suspicious"), 1)) / F.count(F.lit(1)), 4).alias("precision"))


def operating_points(rows: DataFrame, cuts: tuple[int, ...] = (0, 20, 30, 40, 50, 60)) -> DataFrame:
    """Rates when everything with an alert of at least each score is predicted. `score` is null without an alert."""
    each = rows.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts]))).withColumn("predicted", F.coalesce(F.col("score") >= F.col("cut"), F.lit(False)))
    return rates(confusion(each, ("cut",)))


def alert_report(labels: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per scenario: customers, alerted ones, alert rate, and how often an expected rule alerted."""
    pairs = alerts.select(F.col("customer_id").alias("entity_id"), "detector_id").distinct()
    alerted = pairs.select("entity_id").distinct().withColumn("alerted", F.lit(1))
    hit = labels.select("entity_id", F.explode("expected_signals").alias("detector_id")).join(pairs, ["entity_id", "detector_id"], "left_semi").select("entity_id").distinct().withColumn("hit", F.lit(1))
    j = labels.join(alerted, "entity_id", "left").join(hit, "entity_id", "left")
    expected = F.col("is_suspicious") & (F.size("expected_signals") > 0)
    g = j.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.count("alerted").alias("alerted"), F.count(F.when(expected, 1)).alias("expected"),
                                  F.count(F.when(expected & F.col("hit").isNotNull(), 1)).alias("expected_alerted"))
    return g.withColumn("alert_rate", rnd(F.col("alerted") / F.col("n"), 4)).withColumn("expected_rate", share(F.col("expected_alerted"), F.col("expected"), None))


def detector_precision(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    bad = labels.filter("is_suspicious").select(F.col("entity_id").alias("customer_id")).distinct().withColumn("s", F.lit(1))
    return alerts.join(bad, "customer_id", "left").groupBy("detector_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.count("s").alias("on_suspicious"), rnd(F.count("s") / F.count(F.lit(1)), 4).alias("precision"))


def alerts_per_thousand(alerts: DataFrame, customers: DataFrame, txn: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    j = n(alerts, "alerts").crossJoin(F.broadcast(n(customers, "customers"))).crossJoin(F.broadcast(n(txn, "transactions")))  # single rows
    return j.select("alerts", rnd(F.col("alerts") * 1000.0 / F.greatest("customers", F.lit(1))).alias("per_1000_customers"),
                    rnd(F.col("alerts") * 1000.0 / F.greatest("transactions", F.lit(1)), 3).alias("per_1000_transactions"))


PRIORITY_PLACE = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def priority_report(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Confirmed rate per triage priority, and whether it does not rise from one priority to the next lower one."""
    bad = labels.filter("is_suspicious").select(F.col("entity_id").alias("customer_id")).distinct().withColumn("s", F.lit(1))
    g = alerts.filter("triage_score IS NOT NULL").join(bad, "customer_id", "left").groupBy("triage_priority").agg(F.count(F.lit(1)).alias("alerts"), F.count("s").alias("confirmed"))
    g = g.withColumn("confirmed_rate", rnd(F.col("confirmed") / F.col("alerts"), 4)).withColumn("place", F.array_position(F.array(*[F.lit(p) for p in PRIORITY_PLACE]), F.col("triage_priority")))
    w = W.orderBy("place")  # four rows
    return g.withColumn("falls", F.coalesce(F.lag("confirmed_rate").over(w) >= F.col("confirmed_rate"), F.lit(True)))


def top_precision(alerts: DataFrame, labels: DataFrame, orders: dict[str, Column], ks: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """Share of suspicious customers among the first k alerts of each ordering; only the first max(ks) rows are ranked."""
    bad = labels.filter("is_suspicious").select(F.col("entity_id").alias("customer_id")).distinct().withColumn("s", F.lit(1))
    out = None
    for name, order in orders.items():
        first = alerts.orderBy(order, "alert_id").limit(max(ks)).withColumn("rank", F.row_number().over(W.orderBy(order, "alert_id")))
        j = first.join(bad, "customer_id", "left").select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "rank", "s").filter("rank <= k")
        part = j.groupBy("k").agg(F.lit(name).alias("ordering"), rnd(F.count("s") / F.count(F.lit(1)), 4).alias("precision"))
        out = part if out is None else out.unionByName(part)
    return out


def mule_report(scored: DataFrame, labels: DataFrame, typologies: tuple[str, ...], indicators: list[str]) -> DataFrame:
    """Per scenario: customers, bands and how often each indicator fired."""
    j = labels.select("entity_id", "scenario").join(scored, "entity_id")
    band = lambda b: F.count(F.when(F.col("band") == b, 1)).alias(b.lower())
    return j.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), band("HIGH"), band("MEDIUM"), band("LOW"), band("NONE"),
                                     *[F.count(F.when(F.col(i) > 0, 1)).alias(i) for i in indicators]).withColumn("mule_typology", F.col("scenario").isin(*typologies))


def mule_rates(scored: DataFrame, labels: DataFrame, alerts: DataFrame, typologies: tuple[str, ...]) -> DataFrame:
    """Rates of 'medium or high', 'high only' and the plain rule 'has a fan-in or pass-through alert'."""
    flow = alerts.filter("detector_id IN ('FAN_IN', 'RAPID_PASS_THROUGH')").select(F.col("customer_id").alias("entity_id")).distinct().withColumn("flow", F.lit(True))
    j = labels.join(scored, "entity_id").join(flow, "entity_id", "left").withColumn("truth", F.col("scenario").isin(*typologies))
    picks = F.array(F.struct(F.lit("medium_or_high").alias("rule"), F.col("band").isin("MEDIUM", "HIGH").alias("predicted")),
                    F.struct(F.lit("high_only").alias("rule"), (F.col("band") == "HIGH").alias("predicted")),
                    F.struct(F.lit("fan_in_or_rapid_alert").alias("rule"), F.coalesce("flow", F.lit(False)).alias("predicted")))
    return rates(confusion(j.select("truth", F.explode(picks).alias("x")).select("truth", "x.*"), ("rule",)))


def decision_outcomes(decisions: DataFrame, investigations: DataFrame, threshold: float) -> DataFrame:
    """Human decisions with their investigation's score and what they say about the rules."""
    j = decisions.join(investigations.filter("risk_score IS NOT NULL").select("investigation_id", "risk_score", "signals"), "investigation_id")
    flagged = F.col("risk_score") >= threshold
    return j.withColumn("false_positive", (F.col("decision") == "reject") & flagged).withColumn(
        "false_negative", F.col("decision").isin("confirm", "escalate") & ~flagged).withColumn("agrees", F.col("decision").isin("confirm", "escalate"))


def signal_outcomes(outcomes: DataFrame) -> DataFrame:
    """False and true positives and false negatives per rule."""
    s = outcomes.select(F.explode("signals").alias("signal"), "false_positive", "false_negative", "agrees")
    return s.groupBy("signal").agg(F.count(F.when(F.col("false_positive"), 1)).alias("fp"), F.count(F.when(~F.col("false_positive") & F.col("agrees"), 1)).alias("tp"),
                                   F.count(F.when(F.col("false_negative"), 1)).alias("fn"))

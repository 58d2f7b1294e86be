"""Queries over labelled evaluation and the anomaly model."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import TRIAL_RULES
from riskloom.operators import anomaly as an
from riskloom.operators import detectors as det
from riskloom.operators import evaluation as ev
from riskloom.operators import mule
from riskloom.operators import retrieval as ret
from riskloom.operators.orient import legs_for
from riskloom.plans import casework, library, risk
from riskloom.plans.registry import oracle, query
from riskloom.session import stage
from riskloom.sources.generated import Bank

R4 = "floor(({}) * 10000 + 0.5) / 10000"


def judged(b: Bank) -> DataFrame:
    """Every labelled customer with its highest alert score (null without alert)."""
    best = b.monitoring.groupBy(F.col("customer_id").alias("entity_id")).agg(F.max("risk_score").alias("score"))
    return b.labels.join(best, "entity_id", "left").select("entity_id", "scenario", F.col("is_suspicious").alias("truth"), "score", F.coalesce(F.col("score") >= 85, F.lit(False)).alias("predicted"))


JUDGED = """judged AS (SELECT l.entity_id, l.scenario, l.is_suspicious AS truth, score, coalesce(score >= 85, false) AS predicted FROM labels_ l LEFT JOIN (SELECT customer_id AS entity_id, max(risk_score) AS score FROM monitoring GROUP BY 1) m ON m.entity_id = l.entity_id)"""
CM = "count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) FILTER (NOT truth AND NOT predicted) AS tn"


def rates_sql(source: str, keys: str, missing: str) -> str:
    r = lambda a, b: f"CASE WHEN {b} > 0 THEN {R4.format(f'{a} / ({b})')} ELSE {missing} END"
    return f"""SELECT {keys} tp, fp, fn, tn, {r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN {R4.format('2 * tp / (2 * tp + fp + fn)')} ELSE {missing} END AS f1,
  {r('fp', 'fp + tn')} AS false_positive_rate, {r('fn', 'fn + tp')} AS false_negative_rate FROM ({source}) c"""


LV = "labels_ monitoring"


@query("e01_classification", oracle(LV, rates_sql(f"SELECT {CM} FROM judged", "", "0.0"), JUDGED))
def _(b):
    return ev.rates(ev.confusion(judged(b)), 0.0)


@query("e02_rates_by_scenario", oracle(LV, rates_sql(f"SELECT scenario, {CM} FROM judged GROUP BY 1", "scenario,", "NULL"), JUDGED))
def _(b):
    return ev.rates(ev.confusion(judged(b), ("scenario",)))


@query("e03_roc_auc", oracle(LV, f"SELECT {R4.format('sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)')} AS auc FROM (SELECT coalesce(score, 0) AS score FROM judged WHERE truth) p, (SELECT coalesce(score, 0) AS score FROM judged WHERE NOT truth) n", JUDGED))
def _(b):
    return ev.roc_auc(judged(b).fillna(0.0, ["score"]))


@query("e04_average_precision", oracle(LV, f"""SELECT {R4.format('sum(pos * tp / al) / sum(pos)')} AS average_precision FROM (SELECT pos, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS al FROM (
  SELECT coalesce(score, 0) AS score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM judged GROUP BY 1) x WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) y""", JUDGED))
def _(b):
    return ev.average_precision(judged(b).fillna(0.0, ["score"]))


REL = "rel AS (SELECT label AS query_id, vec_id AS id FROM embeddings)"


def quality_sql(source: str) -> str:
    ks = ", ".join(f"{R4.format(f'count(*) FILTER (hit AND rank <= {k}) / {k}')} AS p_at_{k}, {R4.format(f'least(count(*) FILTER (hit AND rank <= {k}), any_value(n)) / any_value(n)')} AS r_at_{k}" for k in (1, 3, 5))
    return f"SELECT query_id, {ks}, coalesce({R4.format('1.0 / min(rank) FILTER (hit)')}, 0) AS reciprocal_rank FROM (SELECT s.*, EXISTS (SELECT 1 FROM rel WHERE rel.query_id = s.query_id AND rel.id = s.id) AS hit, (SELECT count(*) FROM rel WHERE rel.query_id = s.query_id) AS n FROM {source} s) x GROUP BY 1"


def relevant(b: Bank) -> DataFrame:
    return library.vectors(b).select(F.col("label").cast("long").alias("query_id"), F.col("id"))


@query("e05_ranking_quality", oracle("", quality_sql("(SELECT * FROM sem WHERE rank <= 20)"), library.SEM.replace("{where}", "") + ",\n" + REL))
def _(b):
    ranked = ret.cosine_top_k(library.vectors(b), library.label_queries(b).withColumn("query_id", F.col("query_id").cast("long")), 20)
    return ev.ranking_quality(ranked, relevant(b))


@query("e13_retrieval_benchmark", oracle("", " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS n_queries, " + ", ".join(f"{R4.format(f'avg({c})')} AS {a}" for c, a in [(f"{x}_at_{k}", f"{x}_at_{k}") for k in (1, 3, 5) for x in "pr"] + [("reciprocal_rank", "mrr")]) + f" FROM ({quality_sql(s)}) q_{m}"
    for m, s in (("semantic", "(SELECT query_id, id, rank FROM ss WHERE rank <= 5)"), ("keyword", "(SELECT query_id, id, rank FROM ks WHERE rank <= 5)"), ("hybrid", "(SELECT query_id, id, place AS rank FROM fused WHERE place <= 5)"))), library.FUSE_CTE + ",\nrel AS (SELECT query_id, vec_id AS id FROM ask JOIN embeddings e ON e.label = ask.label)"))
def _(b):
    sem, kw, of = library.both_lists(b)
    sought = of.join(library.vectors(b), "label").select("query_id", "id")
    modes = {"semantic": sem.filter("rank <= 5"), "keyword": kw.filter("rank <= 5"), "hybrid": ret.fuse(sem, kw, 5)}
    out = None
    for name, ranked in modes.items():
        part = ev.ranking_quality(ranked.select("query_id", "id", "rank"), sought).withColumn("mode", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return ev.mean_quality(out, ("mode",))


def subjects(b: Bank) -> DataFrame:
    """Several labels per customer: one for each closed investigation."""
    i = b.investigations.filter("status = 'closed'")
    bad = F.col("conclusion") == "confirmed_suspicious"
    return i.select(F.lit("customer").alias("entity_type"), F.col("subject_id").alias("entity_id"), bad.alias("is_suspicious"), F.when(bad, F.col("signals")[0]).otherwise("normal").alias("scenario"), "investigation_id")


SUBJECTS = """sub AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY is_suspicious DESC, investigation_id) AS rn FROM (
  SELECT subject_id AS entity_id, conclusion = 'confirmed_suspicious' AS is_suspicious, CASE WHEN conclusion = 'confirmed_suspicious' THEN split_part(signal_list, ',', 1) ELSE 'normal' END AS scenario, investigation_id FROM investigations WHERE status = 'closed') x) y WHERE rn = 1)"""


@query("e07_one_label_per_subject", oracle("investigations", "SELECT entity_id, is_suspicious, scenario, investigation_id FROM sub", SUBJECTS))
def _(b):
    return ev.one_label_per_subject(subjects(b), "investigation_id").select("entity_id", "is_suspicious", "scenario", "investigation_id")


@query("e07_stratified_sample", oracle("investigations", "SELECT entity_id, scenario, rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY md5(concat('11:', entity_id))) AS rank FROM sub) x WHERE rank <= CASE WHEN scenario = 'normal' THEN 60 ELSE 20 END", SUBJECTS))
def _(b):
    return ev.stratified_sample(ev.one_label_per_subject(subjects(b), "investigation_id"), 20).select("entity_id", "scenario", "rank")


def scored(b: Bank) -> tuple[DataFrame, DataFrame]:
    s = b.monitoring.groupBy(F.col("customer_id").alias("entity_id")).agg(F.max("risk_score").alias("score")).withColumn("flagged", F.col("score") >= 85)
    return s, b.monitoring.filter("risk_score >= 70").select(F.col("customer_id").alias("entity_id"), F.col("detector_id").alias("detector")).distinct()


SIG = JUDGED + """, sig AS (SELECT DISTINCT customer_id AS entity_id, detector_id AS detector FROM monitoring WHERE risk_score >= 70),
lab AS (SELECT l.*, list_filter(string_split(expected_list, ','), lambda x: x <> '') AS exp, coalesce((SELECT list(detector) FROM sig s WHERE s.entity_id = l.entity_id), []) AS got FROM labels_ l)"""


@query("e08_scenario_report", oracle(LV, f"""
SELECT lab.scenario, count(*) AS n, bool_or(is_suspicious) AS suspicious, {R4.format('count(*) FILTER (predicted) / count(*)')} AS flag_rate, floor(CAST(sum(CAST(coalesce(score, 0) AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS mean_score,
  {R4.format("avg(CASE WHEN len(exp) > 0 THEN len(list_intersect(exp, got)) / len(exp) END)")} AS expected_signal_recall FROM lab JOIN judged j ON j.entity_id = lab.entity_id GROUP BY 1""", SIG))
def _(b):
    s, signals = scored(b)
    return ev.scenario_report(b.labels, s, signals)


@query("e08_signal_precision", oracle(LV, f"SELECT detector, count(*) AS fired, {R4.format('count(*) FILTER (is_suspicious) / count(*)')} AS precision FROM sig JOIN labels_ l ON l.entity_id = sig.entity_id GROUP BY 1", SIG))
def _(b):
    return ev.signal_precision(b.labels, scored(b)[1])


@query("e09_operating_points", oracle(LV, rates_sql("SELECT cut, count(*) FILTER (truth AND coalesce(score >= cut, false)) AS tp, count(*) FILTER (NOT truth AND coalesce(score >= cut, false)) AS fp, count(*) FILTER (truth AND NOT coalesce(score >= cut, false)) AS fn, count(*) FILTER (NOT truth AND NOT coalesce(score >= cut, false)) AS tn FROM judged, (SELECT unnest([0, 20, 30, 40, 50, 60]) AS cut) k GROUP BY 1", "cut,", "NULL"), JUDGED))
def _(b):
    return ev.operating_points(judged(b))


@query("e10_alert_report", oracle(LV, f"""
SELECT scenario, n, alerted, expected, expected_alerted, {R4.format('alerted / n')} AS alert_rate, CASE WHEN expected > 0 THEN {R4.format('expected_alerted / expected')} END AS expected_rate FROM (
  SELECT scenario, count(*) AS n, count(*) FILTER (len(al) > 0) AS alerted, count(*) FILTER (is_suspicious AND len(exp) > 0) AS expected, count(*) FILTER (is_suspicious AND len(list_intersect(exp, al)) > 0) AS expected_alerted FROM (
    SELECT l.*, coalesce((SELECT list(detector_id) FROM monitoring m WHERE m.customer_id = l.entity_id), []) AS al FROM lab l) x GROUP BY 1) y""", SIG))
def _(b):
    return ev.alert_report(b.labels, b.monitoring)


@query("e10_detector_precision", oracle(LV, f"SELECT detector_id, count(*) AS alerts, count(*) FILTER (is_suspicious) AS on_suspicious, {R4.format('count(*) FILTER (is_suspicious) / count(*)')} AS precision FROM monitoring m LEFT JOIN labels_ l ON l.entity_id = m.customer_id GROUP BY 1"))
def _(b):
    return ev.detector_precision(b.monitoring, b.labels)


@query("e10_alerts_per_thousand", oracle("monitoring customers txn", "SELECT a AS alerts, floor(a * 1000.0 / c * 100 + 0.5) / 100 AS per_1000_customers, floor(a * 1000.0 / t * 1000 + 0.5) / 1000 AS per_1000_transactions FROM (SELECT (SELECT count(*) FROM monitoring) AS a, (SELECT count(*) FROM customers) AS c, (SELECT count(*) FROM txn) AS t) x"))
def _(b):
    return ev.alerts_per_thousand(b.monitoring, b.customers, b.txn)


PLACE = "CASE triage_priority WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END"


@query("e11_priority_report", oracle(LV, f"""
SELECT *, coalesce(lag(confirmed_rate) OVER (ORDER BY place) >= confirmed_rate, true) AS falls FROM (SELECT triage_priority, {PLACE} AS place, count(*) AS alerts, count(*) FILTER (is_suspicious) AS confirmed, {R4.format('count(*) FILTER (is_suspicious) / count(*)')} AS confirmed_rate
  FROM monitoring m LEFT JOIN labels_ l ON l.entity_id = m.customer_id WHERE triage_score IS NOT NULL GROUP BY 1, 2) x"""))
def _(b):
    return ev.priority_report(b.monitoring, b.labels)


def _top_sql(name: str, order: str) -> str:
    return f"SELECT k, '{name}' AS ordering, {R4.format('count(*) FILTER (s) / count(*)')} AS precision FROM (SELECT row_number() OVER (ORDER BY {order}, alert_id) AS rank, coalesce(is_suspicious, false) AS s FROM monitoring m LEFT JOIN labels_ l ON l.entity_id = m.customer_id WHERE triage_score IS NOT NULL) x, (SELECT unnest([10, 25, 50, 100]) AS k) y WHERE rank <= k GROUP BY 1"


@query("e11_top_precision", oracle(LV, " UNION ALL ".join((_top_sql("triage_score", "triage_score DESC"), _top_sql("risk_score", "risk_score DESC"), _top_sql("random", "md5(concat('1:', alert_id))")))))
def _(b):
    rows = b.monitoring.filter("triage_score IS NOT NULL")
    return ev.top_precision(rows, b.labels, {"triage_score": F.col("triage_score").desc(), "risk_score": F.col("risk_score").desc(), "random": F.md5(F.concat(F.lit("1:"), F.col("alert_id").cast("string")))})


BANDED = casework.RAPID + f""",
mb AS (SELECT p.*, l.scenario, l.scenario = 'mule' AS truth, {casework.BANDS} AS band FROM scored p JOIN labels_ l ON l.entity_id = p.entity_id)"""
MV = casework.MULE_VIEWS + " labels_"


@query("e12_mule_report", oracle(MV, "SELECT scenario, count(*) AS n, " + ", ".join(f"count(*) FILTER (band = '{x}') AS {x.lower()}" for x in ("HIGH", "MEDIUM", "LOW", "NONE")) + ", " + ", ".join(f"count(*) FILTER ({i} > 0) AS {i}" for i in mule.INDICATORS) + ", scenario = 'mule' AS mule_typology FROM mb GROUP BY ALL", BANDED))
def _(b):
    return ev.mule_report(casework.mule_scores(b, True), b.labels, ("mule",), list(mule.INDICATORS))


@query("e12_mule_rates", oracle(MV, " UNION ALL ".join(rates_sql(f"SELECT '{n}' AS rule, count(*) FILTER (truth AND {p}) AS tp, count(*) FILTER (NOT truth AND {p}) AS fp, count(*) FILTER (truth AND NOT {p}) AS fn, count(*) FILTER (NOT truth AND NOT {p}) AS tn FROM mb", "rule,", "NULL")
    for n, p in (("medium_or_high", "(band IN ('MEDIUM', 'HIGH'))"), ("high_only", "(band = 'HIGH')"), ("fan_in_or_rapid_alert", "(entity_id IN (SELECT customer_id FROM monitoring WHERE detector_id IN ('FAN_IN', 'RAPID_PASS_THROUGH')))"))), BANDED))
def _(b):
    return ev.mule_rates(casework.mule_scores(b, True), b.labels, b.monitoring, ("mule",))


@query("e12_mule_auc", oracle(MV, f"SELECT {R4.format('sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)')} AS auc FROM (SELECT score FROM mb WHERE truth) p, (SELECT score FROM mb WHERE NOT truth) n", BANDED))
def _(b):
    """How well the indicator score tells customers of the mule scenario from all others with a label."""
    scored = casework.mule_scores(b, True).select("entity_id", "score")
    return ev.roc_auc(b.labels.select("entity_id", (F.col("scenario") == "mule").alias("truth")).join(scored, "entity_id"))


def decisions(b: Bank) -> DataFrame:
    k = F.col("investigation_id") % 3
    return b.investigations.filter("status = 'closed'").select("investigation_id", F.when(k == 0, "confirm").when(k == 1, "reject").otherwise("escalate").alias("decision"))


DECIDED = "dec AS (SELECT *, CASE investigation_id % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' ELSE 'escalate' END AS decision FROM investigations WHERE status = 'closed')"


@query("j09_decisions", oracle("investigations", "SELECT investigation_id, decision, risk_score, decision = 'reject' AND risk_score >= 40 AS false_positive, decision <> 'reject' AND risk_score < 40 AS false_negative FROM dec", DECIDED))
def _(b):
    return ev.decision_outcomes(decisions(b), b.investigations, 40.0).select("investigation_id", "decision", "risk_score", "false_positive", "false_negative")


@query("e14_signal_outcomes", oracle("investigations", "SELECT signal, count(*) FILTER (decision = 'reject' AND risk_score >= 40) AS fp, count(*) FILTER (decision <> 'reject') AS tp, count(*) FILTER (decision <> 'reject' AND risk_score < 40) AS fn FROM (SELECT *, unnest(string_split(signal_list, ',')) AS signal FROM dec) x GROUP BY 1", DECIDED))
def _(b):
    return ev.signal_outcomes(ev.decision_outcomes(decisions(b), b.investigations, 40.0))


@query("g01_audit_filter", oracle("alert_events", "SELECT alert_id, event_id, epoch_us(ts) AS us FROM alert_events WHERE actor = 'analyst2' AND ts >= TIMESTAMP '1998-06-01 00:00:00' AND to_status = 'ESCALATED'"))
def _(b):
    return (b.alert_events.filter((F.col("actor") == "analyst2") & (F.col("ts") >= F.lit(datetime(1998, 6, 1))) & (F.col("to_status") == "ESCALATED"))
            .orderBy(F.col("ts").desc()).select("alert_id", "event_id", F.unix_micros("ts").alias("us")))


# ------------------------------------------------------------------------------------------------------- anomaly model
def feature_rows(b: Bank) -> DataFrame:
    f = risk.frames(b, legs=stage(legs_for(b.txn, b.accounts, b.period), "legs"))
    return stage(an.features(f, det.all_results(f, an.RATIOS)), "features")


@query("d20_anomaly_model")
def _(b):
    rows = feature_rows(b)
    forest, sample = an.train(rows)
    return an.anomaly_results(an.percentiles(an.score(rows, forest, sample)), TRIAL_RULES.anomaly_percentile)


@query("d21_top_features")
def _(b):
    return an.top_features(feature_rows(b))

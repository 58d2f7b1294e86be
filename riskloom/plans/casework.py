"""Queries over alerts, triage, queues, cases and money-mule indicators."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import DETECTORS, FLOW_DETECTORS, TRIAL_MULE, TRIAL_RULES, AlertPolicy, TriageRules
from riskloom.functions.numeric import top_k
from riskloom.operators import alerts as al
from riskloom.operators import detectors as det
from riskloom.operators import graph as g
from riskloom.operators import mule
from riskloom.operators import scoring as sc
from riskloom.operators.orient import legs_for
from riskloom.plans import network, risk
from riskloom.plans.registry import oracle, query
from riskloom.plans.scores import BAND, EVIDENCE, SCORED, VIEWS_USED, body_of, case
from riskloom.session import stage
from riskloom.sources.generated import AS_OF, Bank, table, view

POLICY = AlertPolicy(supporting_gate=20.0)
TRIAGE = TriageRules()
OPEN = "('NEW', 'TRIAGED', 'INVESTIGATING', 'ESCALATED')"
TIERS = {d[0]: d[3] for d in DETECTORS}
RANKS = "CASE {} WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def cites_of_alerts(b: Bank, legs: DataFrame) -> DataFrame:
    """Transactions each stored alert holds: the first ten of the customer's window rows that fall to it."""
    m = b.monitoring.select("alert_id", "customer_id", "detector_id", (F.col("alert_id") % 7).alias("part"))
    rows = legs.filter("period = 'win' AND direction = 'out'").select(F.col("entity_id").alias("customer_id"), "transaction_id", (F.col("transaction_id") % 7).alias("part"))
    return top_k(m.join(rows, ["customer_id", "part"]), ["alert_id"], [F.col("transaction_id")], 10).select(
        "alert_id", "customer_id", "detector_id", F.col("transaction_id").cast("string").alias("transaction_id"))


HELD = """held AS (SELECT alert_id, customer_id, detector_id, CAST(transaction_id AS VARCHAR) AS transaction_id FROM (
  SELECT m.alert_id, m.customer_id, m.detector_id, l.transaction_id, row_number() OVER (PARTITION BY m.alert_id ORDER BY l.transaction_id) AS rn FROM monitoring m
  JOIN legs l ON l.entity_id = m.customer_id AND l.period = 'win' AND l.direction = 'out' AND l.transaction_id % 7 = m.alert_id % 7) x WHERE rn <= 10)"""
CANDS = f"""banded AS (SELECT *, {BAND} AS band FROM scores),
cands AS (SELECT c.entity_id AS customer_id, c.detector AS detector_id, c.category, {case('c.detector', TIERS)} AS tier, b.score, b.band, c.points,
  CASE WHEN b.band = 'critical' THEN 'critical' WHEN c.strength >= 0.85 THEN 'high' WHEN c.strength >= 0.65 THEN 'medium' ELSE 'low' END AS severity
  FROM contrib c JOIN banded b ON b.entity_id = c.entity_id WHERE {case('c.detector', TIERS)} = 'standalone' OR ({case('c.detector', TIERS)} = 'supporting' AND b.score >= 20))"""
ALL = SCORED + "," + EVIDENCE + ",\n" + CANDS
ACTIONS = ALL + ",\n" + HELD + f""",
cite AS (SELECT DISTINCT entity_id AS customer_id, detector AS detector_id, CAST(transaction_id AS VARCHAR) AS transaction_id FROM cited),
acts AS (SELECT c.*, u.alert_id, coalesce(n, 0) AS n_cited, coalesce(fresh, 0) AS n_fresh,
  CASE WHEN u.alert_id IS NOT NULL THEN 'updated' WHEN n > 0 AND coalesce(fresh, 0) = 0 THEN 'suppressed' WHEN coalesce(n, 0) = 0 AND last > TIMESTAMP '2024-01-24 00:00:00' THEN 'suppressed' ELSE 'created' END AS action
  FROM cands c LEFT JOIN (SELECT customer_id, detector_id, arg_max(alert_id, struct_pack(a := triggered_at, b := alert_id)) AS alert_id FROM monitoring WHERE status IN {OPEN} GROUP BY 1, 2) u USING (customer_id, detector_id)
  LEFT JOIN (SELECT customer_id, detector_id, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM held h JOIN monitoring m ON m.alert_id = h.alert_id AND m.status = 'RESOLVED' WHERE h.customer_id = cite.customer_id AND h.detector_id = cite.detector_id AND h.transaction_id = cite.transaction_id)) AS fresh FROM cite GROUP BY 1, 2) e USING (customer_id, detector_id)
  LEFT JOIN (SELECT customer_id, detector_id, max(resolved_at) AS last FROM monitoring WHERE status = 'RESOLVED' GROUP BY 1, 2) r USING (customer_id, detector_id))"""
AVIEWS = VIEWS_USED + " monitoring"


class Run:
    """A monitoring run over all rules."""

    def __init__(self, b: Bank):
        self.legs = stage(legs_for(b.txn, b.accounts, b.period), "legs")
        f = risk.frames(b, legs=self.legs)
        self.assessment = sc.assess(f)
        self.cands = al.candidates(self.assessment.contributions, self.assessment.scores, POLICY)
        self.evidence = stage(sc.evidence(f, self.assessment.results), "evidence")
        self.cited = self.evidence.filter("kind = 'transaction'").select(
            F.col("entity_id").alias("customer_id"), F.col("detector").alias("detector_id"), F.col("id").alias("transaction_id")).distinct()
        self.held = cites_of_alerts(b, self.legs)
        self.actions = al.upsert(self.cands, self.cited, b.monitoring, self.held, AS_OF, POLICY)


@query("al01_candidates", oracle(VIEWS_USED, "SELECT customer_id, detector_id, tier, score, points FROM cands", ALL))
def _(b):
    return Run(b).cands.select("customer_id", "detector_id", "tier", "score", "points")


@query("al02_severity", oracle(VIEWS_USED, "SELECT customer_id, detector_id, band, severity FROM cands", ALL))
def _(b):
    return Run(b).cands.select("customer_id", "detector_id", "band", "severity")


@query("al03_upsert", oracle(AVIEWS, "SELECT customer_id, detector_id, action, alert_id, n_cited, n_fresh FROM acts", ACTIONS))
def _(b):
    return Run(b).actions.select("customer_id", "detector_id", "action", "alert_id", "n_cited", "n_fresh")


@query("al04_merge", oracle(AVIEWS, f"""
SELECT a.alert_id, m.occurrence_count + 1 AS occurrence_count, greatest(m.risk_score, a.score) AS risk_score, greatest(m.risk_contribution, a.points) AS risk_contribution,
  CASE WHEN {RANKS.format('a.severity')} > {RANKS.format('m.severity')} THEN a.severity ELSE m.severity END AS severity,
  CASE WHEN coalesce(usd, 0) <> 0 OR m.amount_usd IS NOT NULL THEN floor((coalesce(m.amount_usd, 0) + coalesce(usd, 0)) * 100 + 0.5) / 100 END AS amount_usd, m.txn_count + coalesce(n, 0) AS txn_count
FROM acts a JOIN monitoring m ON m.alert_id = a.alert_id LEFT JOIN (SELECT a.alert_id, count(*) AS n, CAST(sum(CAST(t.amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS usd FROM acts a JOIN cite c ON c.customer_id = a.customer_id AND c.detector_id = a.detector_id
  JOIN txn t ON CAST(t.transaction_id AS VARCHAR) = c.transaction_id WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.alert_id = a.alert_id AND h.transaction_id = c.transaction_id) GROUP BY 1) x ON x.alert_id = a.alert_id""", ACTIONS))
def _(b):
    r = Run(b)
    amounts = b.txn.select(F.col("transaction_id").cast("string").alias("transaction_id"), "amount_usd")
    return al.merge(r.actions, b.monitoring, r.cited, r.held, amounts).select(
        "alert_id", "occurrence_count", "risk_score", "risk_contribution", "severity", "amount_usd", "txn_count")


R2 = "floor(({}) * 100 + 0.5) / 100"
AGE = "CASE WHEN status <> 'RESOLVED' THEN greatest((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(triggered_at)) / 3600e6, 0.0) END"
SCORE = f"""tri AS (SELECT *, floor(CAST(
    CAST(CASE severity WHEN 'critical' THEN 13 WHEN 'high' THEN 11 WHEN 'medium' THEN 7 ELSE 3 END AS DECIMAL(18,2)) + CAST({R2.format('least(25.0E0, risk_score / 100.0 * 25.0)')} AS DECIMAL(18,2))
  + CAST(CASE {case('detector_id', TIERS)} WHEN 'standalone' THEN 5 WHEN 'supporting' THEN 4 ELSE 0 END AS DECIMAL(18,2))
  + CAST(CASE categories WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 8 ELSE 10 END AS DECIMAL(18,2))
  + CAST(CASE WHEN amount_usd IS NULL THEN 0 WHEN amount_usd < 1000 THEN 2 WHEN amount_usd < 5000 THEN 4 WHEN amount_usd < 10000 THEN 6 WHEN amount_usd < 50000 THEN 8 ELSE 10 END AS DECIMAL(18,2))
  + CAST(CASE WHEN txn_count = 0 THEN 0 WHEN txn_count = 1 THEN 1 WHEN txn_count < 5 THEN 3 ELSE 5 END AS DECIMAL(18,2)) + CAST(CASE WHEN occurrence_count <= 1 THEN 1 WHEN occurrence_count <= 3 THEN 3 ELSE 5 END AS DECIMAL(18,2))
  + CAST({R2.format('least(network_points / 10.0, 1.0E0) * 7.0')} AS DECIMAL(18,2)) + CAST(CASE identity_signals WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 5 END AS DECIMAL(18,2))
  + CAST(CASE WHEN prior_confirmed > 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) + CAST(CASE WHEN prior_cleared > 0 THEN 0 ELSE 5 END AS DECIMAL(18,2))
  + CAST(CASE WHEN {AGE} IS NULL THEN 0 WHEN {AGE} >= 96 THEN 5 WHEN {AGE} >= 48 THEN 3 WHEN {AGE} >= 24 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS DOUBLE) * 10 + 0.5) / 10 AS new_score FROM hist),
pri AS (SELECT *, CASE WHEN new_score >= 65 THEN 'CRITICAL' WHEN new_score >= 50 THEN 'HIGH' WHEN new_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS new_priority FROM tri)"""


ROW_CONTEXT = """
tctx AS (SELECT entity_id AS customer_id, count(DISTINCT category) AS categories, coalesce(CAST(sum(CAST(points AS DECIMAL(18,2))) FILTER (detector = 'NETWORK_EXPOSURE') AS DOUBLE), 0) AS network_points,
  count(*) FILTER (category = 'device_identity') AS identity_signals FROM contrib WHERE points > 0 GROUP BY 1),
efacts AS (SELECT * FROM (SELECT c.entity_id AS customer_id, c.detector AS detector_id, CAST(l.transaction_id AS VARCHAR) AS first_transaction_id, l.account_id,
    row_number() OVER (PARTITION BY c.entity_id, c.detector ORDER BY l.ts, CAST(l.transaction_id AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY c.entity_id, c.detector) AS txn_count,
    CAST(sum(CAST(l.amount_usd AS DECIMAL(18,2))) OVER (PARTITION BY c.entity_id, c.detector) AS DOUBLE) AS amount_usd
  FROM (SELECT DISTINCT entity_id, detector, transaction_id FROM cited) c JOIN legs l ON l.entity_id = c.entity_id AND l.transaction_id = c.transaction_id) x WHERE rn = 1),
grown AS (SELECT a.alert_id, count(*) AS n, CAST(sum(CAST(t.amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS usd FROM acts a JOIN cite c ON c.customer_id = a.customer_id AND c.detector_id = a.detector_id
  JOIN txn t ON CAST(t.transaction_id AS VARCHAR) = c.transaction_id WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.alert_id = a.alert_id AND h.transaction_id = c.transaction_id) GROUP BY 1),
touched AS (
  SELECT NULL::BIGINT AS alert_id, a.customer_id, a.detector_id, 'NEW' AS status, a.severity, a.score AS risk_score, a.points AS risk_contribution, 1 AS occurrence_count, f.amount_usd, coalesce(f.txn_count, 0) AS txn_count, f.account_id,
    f.first_transaction_id, TIMESTAMP '2024-01-31 00:00:00' AS triggered_at, NULL::VARCHAR AS triage_priority FROM acts a LEFT JOIN efacts f USING (customer_id, detector_id) WHERE action = 'created'
  UNION ALL SELECT a.alert_id, m.customer_id, m.detector_id, m.status, CASE WHEN """ + RANKS.format("a.severity") + " > " + RANKS.format("m.severity") + """ THEN a.severity ELSE m.severity END, greatest(m.risk_score, a.score),
    greatest(m.risk_contribution, a.points), m.occurrence_count + 1, CASE WHEN coalesce(usd, 0) <> 0 OR m.amount_usd IS NOT NULL THEN floor((coalesce(m.amount_usd, 0) + coalesce(usd, 0)) * 100 + 0.5) / 100 END,
    m.txn_count + coalesce(n, 0), NULL, NULL, m.triggered_at, m.triage_priority FROM acts a JOIN monitoring m ON m.alert_id = a.alert_id LEFT JOIN grown g ON g.alert_id = a.alert_id),
hist AS (SELECT t.*, coalesce(c.categories, 0) AS categories, coalesce(c.network_points, 0) AS network_points, coalesce(c.identity_signals, 0) AS identity_signals,
  (SELECT count(*) FROM monitoring o WHERE o.customer_id = t.customer_id AND o.status = 'RESOLVED' AND o.resolution = 'CONFIRMED_SUSPICIOUS') AS prior_confirmed,
  (SELECT count(*) FROM monitoring o WHERE o.customer_id = t.customer_id AND o.detector_id = t.detector_id AND o.status = 'RESOLVED' AND o.resolution IN ('CLEARED', 'FALSE_POSITIVE')) AS prior_cleared
  FROM touched t LEFT JOIN tctx c ON c.customer_id = t.customer_id)"""


def outcome(b: Bank) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = Run(b)
    facts = al.evidence_facts(r.evidence, r.legs)
    amounts = b.txn.select(F.col("transaction_id").cast("string").alias("transaction_id"), "amount_usd")
    current, cites = al.shaped(b.monitoring, al.STATE), al.shaped(r.held, al.CITES)
    actions = stage(al.upsert(r.cands, r.cited, current, cites, AS_OF, POLICY), "actions")
    return al.applied(actions, current, cites, r.cited, facts, al.triage_context(r.assessment.contributions), amounts, AS_OF, TRIAGE)


@query("al03_new_alert_rows", oracle(AVIEWS, """SELECT customer_id, detector_id, status, severity, risk_score, risk_contribution, occurrence_count, amount_usd, txn_count, categories, network_points, identity_signals, account_id,
  first_transaction_id, new_score AS triage_score, new_priority AS triage_priority FROM pri WHERE alert_id IS NULL""", ACTIONS + "," + ROW_CONTEXT + ",\n" + SCORE))
def _(b):
    """The rows that the run adds to the alert table."""
    rows = outcome(b)[0].filter("alert_id LIKE 'MAL-%'")
    return rows.select("customer_id", "detector_id", "status", "severity", "risk_score", "risk_contribution", "occurrence_count", "amount_usd", "txn_count", "categories", "network_points", "identity_signals",
                       "account_id", "first_transaction_id", "triage_score", "triage_priority")


@query("al04_run_events", oracle(AVIEWS, """SELECT customer_id, detector_id, 'created' AS event, NULL AS before, new_priority AS triage_priority FROM pri WHERE alert_id IS NULL
UNION ALL SELECT customer_id, detector_id, 'updated', triage_priority, new_priority FROM pri WHERE alert_id IS NOT NULL
UNION ALL SELECT customer_id, detector_id, 'priority_changed', triage_priority, new_priority FROM pri WHERE alert_id IS NOT NULL AND triage_priority IS DISTINCT FROM new_priority""", ACTIONS + "," + ROW_CONTEXT + ",\n" + SCORE))
def _(b):
    """What happened to the alerts of a run: created, merged, and merged with another priority than before."""
    return outcome(b)[2].drop("alert_id").select("customer_id", "detector_id", "event", "before", "triage_priority")


@query("al05_primary_transaction", oracle(VIEWS_USED, """
SELECT customer_id, detector_id, tid AS first_transaction_id, account_id, n AS txn_count, usd AS amount_usd FROM (
  SELECT c.entity_id AS customer_id, c.detector AS detector_id, CAST(l.transaction_id AS VARCHAR) AS tid, l.account_id, row_number() OVER (PARTITION BY c.entity_id, c.detector ORDER BY l.ts, CAST(l.transaction_id AS VARCHAR)) AS rn,
    count(*) OVER (PARTITION BY c.entity_id, c.detector) AS n, CAST(sum(CAST(l.amount_usd AS DECIMAL(18,2))) OVER (PARTITION BY c.entity_id, c.detector) AS DOUBLE) AS usd
  FROM (SELECT DISTINCT entity_id, detector, transaction_id FROM cited) c JOIN legs l ON l.entity_id = c.entity_id AND l.transaction_id = c.transaction_id) x WHERE rn = 1""", ALL))
def _(b):
    r = Run(b)
    return al.evidence_facts(r.evidence, r.legs).select("customer_id", "detector_id", "first_transaction_id", "account_id", "txn_count", "amount_usd")


@query("al06_triage_context", oracle(VIEWS_USED, """
SELECT entity_id AS customer_id, count(DISTINCT category) AS categories, coalesce(CAST(sum(CAST(points AS DECIMAL(18,2))) FILTER (detector = 'NETWORK_EXPOSURE') AS DOUBLE), 0) AS network_points, count(*) FILTER (category = 'device_identity') AS identity_signals
FROM contrib WHERE points > 0 GROUP BY 1""", SCORED))
def _(b):
    f = risk.frames(b, legs=stage(legs_for(b.txn, b.accounts, b.period), "legs"))
    return al.triage_context(sc.assess(f).contributions)


HISTORY = """hist AS (SELECT m.*, (SELECT count(*) FROM monitoring o WHERE o.customer_id = m.customer_id AND o.alert_id <> m.alert_id AND o.status = 'RESOLVED' AND o.resolution = 'CONFIRMED_SUSPICIOUS') AS prior_confirmed,
  (SELECT count(*) FROM monitoring o WHERE o.customer_id = m.customer_id AND o.detector_id = m.detector_id AND o.alert_id <> m.alert_id AND o.status = 'RESOLVED' AND o.resolution IN ('CLEARED', 'FALSE_POSITIVE')) AS prior_cleared FROM monitoring m)"""


@query("al07_alert_history", oracle("monitoring", "SELECT alert_id, prior_confirmed, prior_cleared FROM hist", HISTORY))
def _(b):
    return al.history(b.monitoring).select("alert_id", "prior_confirmed", "prior_cleared")


@query("al08_triage_score", oracle("monitoring", "SELECT alert_id, new_score, new_priority FROM pri", HISTORY + ",\n" + SCORE))
def _(b):
    return al.triage(al.history(b.monitoring), AS_OF, TRIAGE).select("alert_id", "new_score", "new_priority")


@query("al09_bulk_rescore", oracle("monitoring", f"SELECT alert_id, new_score, new_priority, new_priority IS DISTINCT FROM triage_priority AS changed FROM pri WHERE status IN {OPEN}", HISTORY + ",\n" + SCORE))
def _(b):
    return al.rescore(b.monitoring, AS_OF, TRIAGE).select("alert_id", "new_score", "new_priority", "changed")


@query("al10_run_summary", oracle(AVIEWS, "SELECT action, count(*) AS n, count(DISTINCT customer_id) AS customers FROM acts GROUP BY 1", ACTIONS))
def _(b):
    return al.run_summary(Run(b).actions)


@query("al11_kpis", oracle("monitoring cases", f"""
SELECT a.*, c.* FROM (SELECT count(*) AS alerts_generated, count(*) FILTER (status IN {OPEN}) AS open_alerts, count(*) FILTER (status IN {OPEN} AND severity IN ('high', 'critical')) AS high_risk_alerts, count(*) FILTER (status = 'RESOLVED') AS resolved_alerts,
  floor(count(*) FILTER (resolution IN ('CLEARED', 'FALSE_POSITIVE')) / count(*) FILTER (status = 'RESOLVED') * 10000 + 0.5) / 10000 AS false_discovery_rate, floor(count(*) FILTER (resolution = 'CONFIRMED_SUSPICIOUS') / count(*) FILTER (status = 'RESOLVED') * 10000 + 0.5) / 10000 AS confirmation_rate FROM monitoring) a,
 (SELECT count(*) FILTER (status IN ('OPEN', 'INVESTIGATING', 'PENDING_REVIEW')) AS cases_under_investigation, count(*) FILTER (status = 'ESCALATED') AS cases_escalated, count(*) FILTER (status = 'CLOSED') AS cases_resolved,
  floor(avg((epoch_us(closed_at) - epoch_us(opened_at)) / 3600e6) FILTER (status = 'CLOSED' AND closed_at IS NOT NULL) * 1000 + 0.5) / 1000 AS avg_investigation_hours FROM cases) c"""))
def _(b):
    return al.kpis(b.monitoring, b.cases)


GROUP_RATES = """count(*) AS alerts, count(*) FILTER (d) AS decided, count(*) FILTER (d AND resolution = 'CONFIRMED_SUSPICIOUS') AS confirmed, count(*) FILTER (d AND resolution = 'CLEARED') AS cleared, count(*) FILTER (d AND resolution = 'FALSE_POSITIVE') AS false_positive,
  CASE WHEN count(*) FILTER (d) > 0 THEN floor(count(*) FILTER (d AND resolution = 'CONFIRMED_SUSPICIOUS') / count(*) FILTER (d) * 10000 + 0.5) / 10000 END AS confirmation_rate,
  CASE WHEN count(*) FILTER (d) > 0 THEN floor(count(*) FILTER (d AND resolution IN ('CLEARED', 'FALSE_POSITIVE')) / count(*) FILTER (d) * 10000 + 0.5) / 10000 END AS false_discovery_rate,
  floor(count(*) FILTER (d) / count(*) * 10000 + 0.5) / 10000 AS closure_rate, count(*) FILTER (d) < 30 AS low_sample"""


@query("al11_kpi_counts", oracle("monitoring cases", f"""
SELECT 'alerts_by_status' AS measure, status AS name, count(*) AS n FROM monitoring GROUP BY 2 UNION ALL SELECT 'alerts_by_detector', detector_id, count(*) FROM monitoring GROUP BY 2
UNION ALL SELECT 'open_alerts_by_severity', severity, count(*) FROM monitoring WHERE status IN {OPEN} GROUP BY 2 UNION ALL SELECT 'cases_by_status', status, count(*) FROM cases GROUP BY 2"""))
def _(b):
    return al.kpi_counts(b.monitoring, b.cases)


@query("al11_run_measures", oracle("txn accounts monitoring", """
SELECT count(*) AS monitoring_runs, arg_max(n, day) AS transactions_monitored_last_run, sum(c) AS customers_evaluated_total, sum(made) AS alerts_created_total, floor(sum(7 * c + n % 13) / sum(c) * 100 + 0.5) / 100 AS avg_detection_ms_per_customer FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT a.customer_id) AS c FROM txn t LEFT JOIN accounts a ON a.account_id = t.sender_account_id GROUP BY 1) d
LEFT JOIN (SELECT CAST(triggered_at AS DATE) AS day, count(*) AS made FROM monitoring GROUP BY 1) m USING (day)"""))
def _(b):
    """A run a day: it screens the senders of the day."""
    days = (b.txn.join(b.accounts.select(F.col("account_id").alias("sender_account_id"), "customer_id"), "sender_account_id", "left")
            .groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("transactions_in_scope"), F.count_distinct("customer_id").alias("customers_evaluated")))
    made = b.monitoring.groupBy(F.to_date("triggered_at").alias("day")).agg(F.count(F.lit(1)).alias("alerts_created"))
    runs = days.join(made, "day", "left").withColumn("started_at", F.to_timestamp("day")).withColumn("duration_ms", 7 * F.col("customers_evaluated") + F.col("transactions_in_scope") % 13)
    return al.run_measures(runs)


@query("al12_alert_quality", oracle("monitoring", f"""
SELECT 'overall' AS by, 'all' AS value, {GROUP_RATES} FROM q UNION ALL SELECT 'priority', coalesce(triage_priority, 'UNSCORED'), {GROUP_RATES} FROM q GROUP BY 2
UNION ALL SELECT 'detector', detector_id, {GROUP_RATES} FROM q GROUP BY 2 UNION ALL SELECT 'severity', severity, {GROUP_RATES} FROM q GROUP BY 2""",
    "q AS (SELECT *, status = 'RESOLVED' AND resolution IS NOT NULL AS d FROM monitoring WHERE triggered_at >= TIMESTAMP '2024-01-10 00:00:00')"))
def _(b):
    return al.alert_quality(b.monitoring, datetime(2024, 1, 10))


@query("al12_decision_hours", oracle("monitoring", """
SELECT count(*) AS total, floor(quantile_cont(h, 0.5) * 100 + 0.5) / 100 AS median_hours, floor(max(h) * 100 + 0.5) / 100 AS max_hours
FROM (SELECT (epoch_us(resolved_at) - epoch_us(triggered_at)) / 3600e6 AS h FROM monitoring WHERE status = 'RESOLVED' AND resolved_at IS NOT NULL) x"""))
def _(b):
    return al.decision_hours(b.monitoring)


@query("al13_feedback", oracle("monitoring", """
SELECT alert_id, customer_id, detector_id, resolution AS decision, assigned_to AS investigator FROM monitoring WHERE status = 'RESOLVED' AND resolution IS NOT NULL ORDER BY resolved_at DESC, alert_id LIMIT 200"""))
def _(b):
    return al.feedback(b.monitoring, 200).select("alert_id", "customer_id", "detector_id", F.col("resolution").alias("decision"), F.col("assigned_to").alias("investigator"))


@query("al14_my_work", oracle("monitoring cases", f"""
SELECT coalesce(a.assigned_to, c.assigned_to) AS assigned_to, coalesce(open, 0) AS open, coalesce(high_priority, 0) AS high_priority, coalesce(overdue, 0) AS overdue, coalesce(escalated, 0) AS escalated, coalesce(confirmed_recent, 0) AS confirmed_recent, coalesce(cleared_recent, 0) AS cleared_recent, coalesce(open_cases, 0) AS open_cases FROM (
  SELECT assigned_to, count(*) FILTER (status IN {OPEN}) AS open, count(*) FILTER (status IN {OPEN} AND triage_priority IN ('CRITICAL', 'HIGH')) AS high_priority,
    count(*) FILTER (status IN {OPEN} AND (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(triggered_at)) / 3600e6 > CASE coalesce(triage_priority, 'LOW') WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 24 WHEN 'MEDIUM' THEN 72 ELSE 168 END) AS overdue,
    count(*) FILTER (status = 'ESCALATED') AS escalated, count(*) FILTER (status = 'RESOLVED' AND resolved_at >= TIMESTAMP '2024-01-24 00:00:00' AND resolution = 'CONFIRMED_SUSPICIOUS') AS confirmed_recent,
    count(*) FILTER (status = 'RESOLVED' AND resolved_at >= TIMESTAMP '2024-01-24 00:00:00' AND resolution IN ('CLEARED', 'FALSE_POSITIVE')) AS cleared_recent FROM monitoring WHERE assigned_to IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT assigned_to, count(*) AS open_cases FROM cases WHERE status <> 'CLOSED' AND assigned_to IS NOT NULL GROUP BY 1) c ON c.assigned_to = a.assigned_to"""))
def _(b):
    return al.my_work(b.monitoring, b.cases, AS_OF, TRIAGE)


@query("al14_my_open_alerts", oracle("monitoring", f"""
SELECT assigned_to, alert_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY assigned_to ORDER BY triage_score DESC NULLS LAST, alert_id) AS rank FROM monitoring WHERE status IN {OPEN} AND assigned_to IS NOT NULL) x WHERE rank <= 50"""))
def _(b):
    return al.my_open_alerts(b.monitoring).select("assigned_to", "alert_id", "rank")


MOVES = "(VALUES " + ", ".join(f"('{a}', '{t}')" for a, ts in al.ALERT_MOVES.items() for t in ts) + ") ok(f, t)"


@query("al15_illegal_moves", oracle("alert_events", f"SELECT alert_id, event_id, from_status, to_status, epoch_us(ts) AS us FROM alert_events e WHERE NOT EXISTS (SELECT 1 FROM {MOVES} WHERE ok.f = e.from_status AND ok.t = e.to_status)"))
def _(b):
    return al.illegal_moves(b.alert_events).select("alert_id", "event_id", "from_status", "to_status", F.unix_micros("ts").alias("us"))


RESOLUTION_LIST = ", ".join(f"'{r}'" for r in al.RESOLUTIONS)


@query("al15_incomplete_changes", oracle("monitoring", f"""
SELECT * FROM (SELECT alert_id, CASE WHEN status = 'RESOLVED' THEN CASE WHEN resolution IS NULL OR resolution NOT IN ({RESOLUTION_LIST}) THEN 'resolution missing' WHEN short THEN 'reason too short' END
    WHEN resolution IS NOT NULL THEN 'resolution not allowed' WHEN status = 'ESCALATED' AND short THEN 'reason too short' END AS fault
  FROM (SELECT alert_id, status, CASE WHEN alert_id % 5 = 0 THEN NULL WHEN alert_id % 7 = 0 THEN 'SOMETHING' WHEN alert_id % 11 = 0 THEN 'CLEARED' ELSE resolution END AS resolution,
    length(trim(coalesce(CASE WHEN alert_id % 3 = 0 THEN ' abc  ' ELSE description END, ''))) < 5 AS short FROM monitoring) x) y WHERE fault IS NOT NULL"""))
def _(b):
    """A log in which every kind of fault occurs."""
    i = F.col("alert_id")
    resolution = F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 7 == 0, "SOMETHING").when(i % 11 == 0, "CLEARED").otherwise(F.col("resolution"))
    log = b.monitoring.select("alert_id", F.col("status").alias("to_status"), resolution.alias("resolution"),
                              F.when(i % 3 == 0, " abc  ").otherwise(F.col("description")).alias("reason"))
    return al.incomplete_changes(log).select("alert_id", "fault")


@query("al16_current_state", oracle("alert_events", """
SELECT alert_id, to_status AS status, epoch_us(ts) AS since_us, changes FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, event_id DESC, to_status DESC) AS rn, count(*) OVER (PARTITION BY alert_id) AS changes FROM alert_events) x WHERE rn = 1"""))
def _(b):
    return al.current_status(b.alert_events).select("alert_id", "status", F.unix_micros("since").alias("since_us"), "changes")


@query("al16_case_cascade", oracle("monitoring cases", """
SELECT alert_id, m.case_id, CASE WHEN c.decision IS NULL THEN 'ESCALATED' ELSE 'RESOLVED' END AS new_status, c.decision AS new_resolution FROM monitoring m JOIN cases c ON c.case_id = m.case_id
WHERE m.status <> 'RESOLVED' AND (c.decision IS NOT NULL OR c.status = 'ESCALATED') AND (c.decision IS NOT NULL OR m.status <> 'ESCALATED')"""))
def _(b):
    return al.cascade(b.monitoring, b.cases)


@query("al17_case_attach", oracle("monitoring cases", f"""
SELECT f.alert_id, f.customer_id, coalesce(CAST(o.case_id AS VARCHAR), concat('CASE-', f.customer_id)) AS case_key, o.case_id IS NULL AS new_case, t.priority, t.n_alerts, CASE WHEN f.status IN ('NEW', 'TRIAGED') THEN 'INVESTIGATING' ELSE f.status END AS new_status
FROM monitoring f JOIN (SELECT customer_id, count(*) AS n_alerts, CASE max({RANKS.format('severity')}) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority FROM monitoring WHERE status IN {OPEN} AND case_id IS NULL GROUP BY 1) t ON t.customer_id = f.customer_id
LEFT JOIN (SELECT customer_id, min(case_id) AS case_id FROM cases WHERE status <> 'CLOSED' GROUP BY 1) o ON o.customer_id = f.customer_id WHERE f.status IN {OPEN} AND f.case_id IS NULL"""))
def _(b):
    return al.attach_to_cases(b.monitoring, b.cases)


def case_log(b: Bank) -> DataFrame:
    case_events = b.cases.select("case_id", F.col("opened_at").alias("ts"), F.concat(F.lit("opened-"), F.col("case_number")).alias("event_id"))
    linked = b.monitoring.filter("case_id IS NOT NULL").select("case_id", "alert_id")
    alert_events = b.alert_events.join(linked, "alert_id").select("case_id", "ts", F.concat_ws("/", F.col("alert_id").cast("string"), "event_id").alias("event_id"))
    notes = table(b.spark, b.folder, "conversations").select(F.col("conv_id").alias("case_id"), F.timestamp_seconds(F.lit(1705000000) + F.col("turn") * 60).alias("ts"),
                                                             F.concat_ws("-", F.lit("note"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"))
    return al.timeline(case_events, alert_events, notes, ("event_id",))


LOG = """log AS (SELECT case_id, opened_at AS ts, concat('opened-', case_number) AS event_id, 'case' AS origin FROM cases
UNION ALL SELECT m.case_id, e.ts, concat(e.alert_id, '/', e.event_id), 'alert' FROM alert_events e JOIN monitoring m ON m.alert_id = e.alert_id WHERE m.case_id IS NOT NULL
UNION ALL SELECT conv_id, make_timestamp((1705000000 + turn * 60) * 1000000), concat('note-', conv_id, '-', turn), 'note' FROM conversations)"""


@query("x02_case_timeline", oracle("cases monitoring alert_events", "SELECT CAST(case_id AS VARCHAR) AS case_id, epoch_us(ts) AS us, event_id, origin, row_number() OVER (PARTITION BY case_id ORDER BY ts, origin, event_id) AS place FROM log", LOG))
def _(b):
    return case_log(b).select(F.col("case_id").cast("string").alias("case_id"), F.unix_micros("ts").alias("us"), "event_id", "origin", "place")


@query("al18_case_workbench", oracle("legs cases monitoring alert_events", f"""
SELECT c.case_id, coalesce(na, 0) AS n_alerts, ids AS alert_ids, txns AS transaction_ids, coalesce(d1, 0) AS direct_counterparties, coalesce(d2, 0) AS second_counterparties, coalesce(nl, 0) AS timeline_rows FROM cases c
LEFT JOIN (SELECT case_id, count(*) AS na, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 50) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY triage_score DESC NULLS LAST, alert_id) AS rn FROM monitoring) x GROUP BY 1) a ON a.case_id = c.case_id
LEFT JOIN (SELECT entity_id, string_agg(CAST(transaction_id AS VARCHAR), ',' ORDER BY rn) AS txns FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, transaction_id) AS rn FROM legs WHERE period = 'win') x WHERE rn <= 50 GROUP BY 1) t ON t.entity_id = c.customer_id
LEFT JOIN (SELECT customer_id, count(*) FILTER (degree = 1) AS d1, count(*) FILTER (degree = 2) AS d2 FROM (SELECT customer_id, degree FROM first UNION ALL SELECT customer_id, degree FROM second) x GROUP BY 1) p ON p.customer_id = c.customer_id
LEFT JOIN (SELECT CAST(case_id AS VARCHAR) AS case_id, least(count(*), 50) AS nl FROM log GROUP BY 1) l ON l.case_id = CAST(c.case_id AS VARCHAR) WHERE c.status <> 'CLOSED'""", network.TWO + ",\n" + LOG))
def _(b):
    legs = legs_for(b.txn, b.accounts, b.period)
    edges = g.transfer_edges(b.txn, 0)
    hubs = g.degrees(g.live(edges, network.SINCE)).filter(F.col("degree") > g.HUB_DEGREE).select(F.col("id").alias("account_id"))
    near = g.customer_counterparties(edges, b.accounts, 2, network.SINCE, hubs)
    scored = sc.assess(risk.frames(b, legs=stage(legs, "legs"))).scores
    w = al.workbench(b.cases, b.monitoring, scored, legs, near, case_log(b))
    ids = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return w.select("case_id", "n_alerts", ids("alerts", "alert_id").alias("alert_ids"), ids("recent_transactions", "transaction_id").alias("transaction_ids"),
                    "direct_counterparties", "second_counterparties", F.coalesce(F.size("timeline"), F.lit(0)).cast("long").alias("timeline_rows"))


# --------------------------------------------------------------------------------------------------------------- queues
FILTER = al.QueueFilter(statuses=("NEW", "TRIAGED"), severities=("high", "critical"), min_risk=20, max_risk=90, assigned_to="analyst1", date_from=datetime(2024, 1, 3), text="100% of PLAN_")


@query("p09_alert_queue", oracle("monitoring", """
SELECT alert_id, status, severity, risk_score FROM monitoring WHERE status IN ('NEW', 'TRIAGED') AND severity IN ('high', 'critical') AND risk_score >= 20 AND risk_score <= 90 AND assigned_to = 'analyst1'
  AND triggered_at >= TIMESTAMP '2024-01-03 00:00:00' AND contains(lower(concat_ws(' ', CAST(alert_id AS VARCHAR), CAST(customer_id AS VARCHAR), detector_id, description)), '100% of plan_')"""))
def _(b):
    return al.alert_queue(b.monitoring, FILTER).select("alert_id", "status", "severity", "risk_score")


@query("p10_case_queue", oracle("cases", "SELECT case_id, status, priority FROM cases WHERE status IN ('OPEN', 'ESCALATED') AND assigned_to IS NULL AND contains(lower(concat_ws(' ', case_number, CAST(customer_id AS VARCHAR), title)), 'customer#')"))
def _(b):
    return al.case_queue(b.cases, ("OPEN", "ESCALATED"), assigned_to="unassigned", text="Customer#").select("case_id", "status", "priority")


@query("t01_queue_page", oracle("monitoring", f"""
SELECT alert_id, severity, count(*) OVER () AS total_matches FROM monitoring WHERE status IN {OPEN} ORDER BY {RANKS.format('severity')} DESC, alert_id LIMIT 50 OFFSET 100"""))
def _(b):
    rows = al.alert_queue(b.monitoring, al.QueueFilter(statuses=("NEW", "TRIAGED", "INVESTIGATING", "ESCALATED")))
    return al.queue_page(rows, "severity_rank", True, 100, 50).select("alert_id", "severity", "total_matches")


@query("t01_queue_by_triage", oracle("monitoring", "SELECT alert_id, triage_score, count(*) OVER () AS total_matches FROM monitoring ORDER BY triage_score DESC NULLS LAST, alert_id LIMIT 50"))
def _(b):
    return al.queue_page(b.monitoring, "triage_score", True, 0, 50).select("alert_id", "triage_score", "total_matches")


# ----------------------------------------------------------------------------------------------------------------- mule
MULE = network.EDGES + f""",
ml AS (SELECT CASE WHEN so.customer_id = ro.customer_id THEN 'internal' ELSE 'out' END AS direction, so.customer_id AS entity_id, t.receiver_account_id AS other_account, t.* FROM txn t JOIN accounts so ON so.account_id = t.sender_account_id LEFT JOIN accounts ro ON ro.account_id = t.receiver_account_id
  UNION ALL SELECT 'in', ro.customer_id, t.sender_account_id, t.* FROM txn t JOIN accounts ro ON ro.account_id = t.receiver_account_id LEFT JOIN accounts so ON so.account_id = t.sender_account_id WHERE so.customer_id IS DISTINCT FROM ro.customer_id),
mw AS (SELECT * FROM ml WHERE ts >= {{ws}} AND ts <= {{we}} AND status = 'completed'),
mi AS (SELECT entity_id, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS in_usd, min(ts) AS first_in, max(ts) AS last_in, count(DISTINCT other_account) AS n_in FROM mw WHERE direction = 'in' AND other_account IS NOT NULL GROUP BY 1),
mo AS (SELECT entity_id, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS out_usd, count(DISTINCT other_account) + count(DISTINCT external_counterparty) AS n_out FROM mw WHERE direction = 'out' GROUP BY 1),
ma AS (SELECT w.entity_id, CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS out_after FROM mw w JOIN mi ON mi.entity_id = w.entity_id WHERE direction = 'out' AND ts >= first_in AND ts <= last_in + INTERVAL 72 HOUR GROUP BY 1),
my AS (SELECT DISTINCT a.customer_id AS entity_id FROM accounts a JOIN mi ON mi.entity_id = a.customer_id WHERE floor((epoch_us(first_in) - epoch_us(opened_at)) / 86400e6) < 30),
md AS (SELECT DISTINCT customer_id AS entity_id FROM (SELECT *, count(*) OVER (PARTITION BY device_id) AS c FROM (SELECT DISTINCT a.customer_id, device_id FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE t.status = 'completed' AND device_id IS NOT NULL) x) y WHERE c >= 2),
id AS (SELECT entity_id FROM (SELECT customer_id AS entity_id, max(n) AS n, bool_or(n >= 3 OR identifier_type IN ('phone', 'email')) AS hit FROM (SELECT a.customer_id, a.identifier_type, count(DISTINCT b.customer_id) + 1 AS n FROM identifiers a JOIN identifiers b ON a.identifier_type = b.identifier_type AND a.value_hash = b.value_hash AND a.customer_id <> b.customer_id GROUP BY 1, 2) x GROUP BY 1) z WHERE hit),
le AS (SELECT * FROM edges WHERE last_ts >= {{ws}}),
touch AS (SELECT source AS account_id, target AS other FROM le UNION ALL SELECT target, source FROM le),
hubs AS (SELECT account_id FROM touch GROUP BY 1 HAVING count(*) > 60),
n1 AS (SELECT DISTINCT customer_id, other AS account_id FROM touch JOIN accounts a USING (account_id) WHERE NOT EXISTS (SELECT 1 FROM accounts o WHERE o.account_id = other AND o.customer_id = a.customer_id)),
n2 AS (SELECT * FROM n1 UNION SELECT f.customer_id, t.other FROM n1 f JOIN touch t ON t.account_id = f.account_id WHERE f.account_id NOT IN (SELECT account_id FROM hubs) AND NOT EXISTS (SELECT 1 FROM accounts o WHERE o.account_id = t.other AND o.customer_id = f.customer_id)),
mf AS (SELECT n2.customer_id AS entity_id, count(DISTINCT a.customer_id) AS n FROM n2 JOIN accounts a ON a.account_id = n2.account_id WHERE a.customer_id <> n2.customer_id AND a.customer_id IN (SELECT customer_id FROM monitoring WHERE status IN {OPEN}) GROUP BY 1),
be AS (SELECT * FROM le WHERE total_usd >= 100 AND source <> target),
mc AS (SELECT DISTINCT a.customer_id AS entity_id FROM be x JOIN be y ON y.source = x.target AND y.target <> x.source AND y.last_ts >= x.first_ts JOIN be z ON z.source = y.target AND z.target NOT IN (x.source, x.target) AND z.last_ts >= y.first_ts JOIN accounts a ON a.account_id = x.source),
pts AS (SELECT c.entity_id, CASE WHEN n_in >= 5 THEN {R2.format('least(n_in / 10.0, 1.0) * 20.0')} ELSE 0 END AS fan_in, CASE WHEN n_out >= 5 THEN {R2.format('least(n_out / 10.0, 1.0) * 15.0')} ELSE 0 END AS fan_out,
  CASE WHEN in_usd >= 200 AND out_after > 0 AND (in_usd - out_after) / in_usd <= 0.5 THEN 10 ELSE 0 END AS low_retention, CASE WHEN my.entity_id IS NOT NULL THEN 10 ELSE 0 END AS new_or_dormant_account,
  CASE WHEN md.entity_id IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN id.entity_id IS NOT NULL THEN 4 ELSE 0 END AS shared_device_identity, CASE WHEN mf.n > 0 THEN {R2.format('least(mf.n / 3.0, 1.0) * 10.0')} ELSE 0 END AS flagged_network,
  CASE WHEN mc.entity_id IS NOT NULL THEN 5 ELSE 0 END AS layering_chain
  FROM (SELECT DISTINCT customer_id AS entity_id FROM accounts) c LEFT JOIN mi USING (entity_id) LEFT JOIN mo USING (entity_id) LEFT JOIN ma USING (entity_id) LEFT JOIN my USING (entity_id) LEFT JOIN md USING (entity_id) LEFT JOIN id USING (entity_id) LEFT JOIN mf USING (entity_id) LEFT JOIN mc USING (entity_id))"""
MULE_RULES = type(TRIAL_MULE)(**{**TRIAL_MULE.__dict__, "min_usd": 200})


def mule_scores(b: Bank, rapid: bool) -> DataFrame:
    f = risk.frames(b)
    names = ("SHARED_IDENTIFIER",) if not rapid else ("SHARED_IDENTIFIER", "DORMANT_REACTIVATION", "CIRCULAR_FLOW")
    contribs = sc.contributions(stage(det.all_results(f, names), "results"))
    return mule.indicators(f, contribs, b.monitoring, MULE_RULES, rapid)


@query("u02_mule_indicators_without_rapid", oracle("txn accounts identifiers monitoring", """
SELECT *, floor((fan_in + fan_out + low_retention + new_or_dormant_account + shared_device_identity + flagged_network + layering_chain) * 10 + 0.5) / 10 AS score FROM pts""", MULE))
def _(b):
    return mule_scores(b, False).select("entity_id", *[k for k in mule.INDICATORS if k != "rapid_movement"], "score")


RAPID = MULE.replace("CASE WHEN my.entity_id IS NOT NULL THEN 10", "CASE WHEN my.entity_id IS NOT NULL OR dorm.entity_id IS NOT NULL THEN 10").replace(
    "CASE WHEN mc.entity_id IS NOT NULL THEN 5 ELSE 0 END AS layering_chain\n", f"""CASE WHEN mc.entity_id IS NOT NULL OR circ.entity_id IS NOT NULL THEN 5 ELSE 0 END AS layering_chain,
  CASE WHEN in_usd >= {MULE_RULES.min_usd} AND coalesce(matched, 0) / 100 / in_usd >= {MULE_RULES.rapid_share}
    THEN {R2.format(f"(greatest(0.0E0, least(1.0E0, (coalesce(matched, 0) / 100 / in_usd - {MULE_RULES.rapid_share}E0) / {1 - MULE_RULES.rapid_share!r}E0)) * 0.5 + 0.5) * 20.0")} ELSE 0 END AS rapid_movement,
  coalesce(in_usd, 0) AS in_usd, coalesce(out_usd, 0) AS out_usd, dwell\n""").replace(
    "LEFT JOIN mc USING (entity_id))", """LEFT JOIN mc USING (entity_id) LEFT JOIN rm USING (entity_id) LEFT JOIN dorm USING (entity_id) LEFT JOIN circ USING (entity_id)),
scored AS (SELECT *, floor((fan_in + fan_out + rapid_movement + low_retention + new_or_dormant_account + shared_device_identity + flagged_network + layering_chain) * 10 + 0.5) / 10 AS score FROM pts)""").replace(
    "\npts AS (", f"""
{risk.fifo_sql("entity_id", "other_account IS NOT NULL", MULE_RULES.rapid_hours * 3600, "period = 'win'").strip()},
rm AS (SELECT entity_id, sum(cents) AS matched, round(median(out_sec - in_sec) / 3600, 9) AS dwell FROM sl GROUP BY 1),
{risk.CYCLES.strip() + ",\n" + risk.gaps_sql("{bs}", "{ws}")},
dorm AS (SELECT entity_id FROM ({body_of("DORMANT_REACTIVATION")}) z WHERE state = 'fired'),
circ AS (SELECT entity_id FROM ({body_of("CIRCULAR_FLOW")}) z WHERE state = 'fired'),
pts AS (""")
BANDS = "CASE " + " ".join(f"WHEN score >= {bound} THEN '{label}'" for label, bound in MULE_RULES.bands) + " ELSE 'NONE' END"
MULE_VIEWS = "recursive legs identifiers monitoring"


@query("u02_mule_indicators", oracle(MULE_VIEWS, f"SELECT entity_id, {', '.join(mule.INDICATORS)}, score, {BANDS} AS band, in_usd, out_usd, dwell AS median_dwell_hours FROM scored", RAPID))
def _(b):
    return mule_scores(b, True).select("entity_id", *mule.INDICATORS, "score", "band", "in_usd", "out_usd", F.round("median_dwell_hours", 9).alias("median_dwell_hours"))


@query("u03_mule_suspects", oracle(MULE_VIEWS, f"""
SELECT entity_id, score, {BANDS} AS band FROM scored WHERE {BANDS} <> 'NONE' AND entity_id IN (SELECT customer_id FROM monitoring WHERE status IN {OPEN} AND detector_id IN {FLOW_DETECTORS!r})
ORDER BY score DESC, entity_id LIMIT 25""", RAPID))
def _(b):
    return mule.suspects(mule_scores(b, True), b.monitoring).select("entity_id", "score", "band")

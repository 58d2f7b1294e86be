"""Alerts and cases as tables: candidates, upsert, triage, queues, quality rates, state from logs."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from riskloom.config import DETECTORS, RESOLUTIONS, SEVERITY_RANK, UNRESOLVED, AlertPolicy, TriageRules
from riskloom.functions.numeric import ladder, lookup, money_sum, rnd, severity, top_k
from riskloom.operators.profile import value_or_zero

TIER = {d[0]: d[3] for d in DETECTORS}
CATEGORY = {d[0]: d[2] for d in DETECTORS}


# --------------------------------------------------------------------------------------------------- candidates, upsert
def candidates(contributions: DataFrame, scored: DataFrame, policy: AlertPolicy) -> DataFrame:
    """Fired rules that may alert: standalone ones always, supporting ones from the gate score on, context never."""
    tier = lookup(F.col("detector"), TIER, "standalone")
    j = contributions.join(scored.select("entity_id", "score", "band"), "entity_id").withColumn("tier", tier)
    ok = (F.col("points") >= policy.min_points) & ((F.col("tier") == "standalone") | ((F.col("tier") == "supporting") & (F.col("score") >= policy.supporting_gate)))
    base = severity(F.col("strength"))
    return j.filter(ok).select(
        F.col("entity_id").alias("customer_id"), F.col("detector").alias("detector_id"), "category", "tier", "score", "band", "points",
        F.when(F.col("band") == policy.critical_band, "critical").otherwise(base).alias("severity"))


def triage_context(contributions: DataFrame) -> DataFrame:
    """Customer facts that go with every alert: categories, network points, identity signals."""
    live = contributions.filter("points > 0")
    cats = live.select("entity_id", "category").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("categories"))
    rest = live.groupBy("entity_id").agg(
        F.coalesce(F.sum(F.when(F.col("detector") == "NETWORK_EXPOSURE", F.col("points").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("network_points"),
        F.count(F.when(F.col("category") == "device_identity", 1)).alias("identity_signals"))
    return cats.join(rest, "entity_id").withColumnRenamed("entity_id", "customer_id")


def evidence_facts(evidence: DataFrame, legs: DataFrame) -> DataFrame:
    """Per (customer, detector): cited transactions, their value, the earliest one and the account it used."""
    cites = evidence.filter("kind = 'transaction'").select("entity_id", "detector", F.col("id").alias("tid")).distinct()
    rows = legs.select("entity_id", F.col("transaction_id").cast("string").alias("tid"), "ts", "amount_usd", "account_id")
    j = cites.join(rows, ["entity_id", "tid"])
    return j.groupBy(F.col("entity_id").alias("customer_id"), F.col("detector").alias("detector_id")).agg(
        F.count(F.lit(1)).alias("txn_count"), money_sum(F.col("amount_usd")).alias("amount_usd"),
        F.min(F.struct("ts", "tid", "account_id")).alias("first"), F.array_sort(F.collect_list("tid")).alias("transaction_ids")).select(
        "customer_id", "detector_id", "txn_count", "amount_usd", "transaction_ids", F.col("first.tid").alias("first_transaction_id"),
        F.col("first.account_id").alias("account_id"))


def upsert(cands: DataFrame, cited: DataFrame, current: DataFrame, current_cites: DataFrame, as_of: datetime, policy: AlertPolicy) -> DataFrame:
    """What each candidate does to the alert table: updated, suppressed or created.

    `cited` and `current_cites` are (customer_id, detector_id, [alert_id,] transaction_id) rows. An unresolved alert of
    the same customer and rule merges; evidence that resolved alerts of the key already hold entirely, or, without
    evidence, a resolution within the cool-down, suppresses.
    """
    keys = ["customer_id", "detector_id"]
    unresolved = current.filter(F.col("status").isin(*UNRESOLVED))
    newest = unresolved.groupBy(*keys).agg(F.max(F.struct("triggered_at", "alert_id")).alias("x")).select(*keys, F.col("x.alert_id").alias("alert_id"))
    resolved = current.filter("status = 'RESOLVED'")
    seen = current_cites.join(resolved.select("alert_id"), "alert_id", "left_semi").select(*keys, "transaction_id").distinct()
    n = cited.select(*keys, "transaction_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cited"))
    fresh = (cited.select(*keys, "transaction_id").distinct().join(seen, [*keys, "transaction_id"], "left_anti")
             .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fresh")))
    last = resolved.groupBy(*keys).agg(F.max("resolved_at").alias("last_resolved"))
    j = cands.join(newest, keys, "left").join(n, keys, "left").join(fresh, keys, "left").join(last, keys, "left").fillna(0, ["n_cited", "n_fresh"])
    cooling = F.col("last_resolved") > F.lit(as_of - timedelta(days=policy.cooldown_days))
    action = (F.when(F.col("alert_id").isNotNull(), "updated")
              .when((F.col("n_cited") > 0) & (F.col("n_fresh") == 0), "suppressed")
              .when((F.col("n_cited") == 0) & F.coalesce(cooling, F.lit(False)), "suppressed").otherwise("created"))
    new_id = F.concat(F.lit("MAL-"), F.hex(F.xxhash64("customer_id", "detector_id", F.lit(as_of.isoformat()))))
    return j.withColumn("action", action).withColumn("alert_key", F.coalesce(F.col("alert_id").cast("string"), new_id)).select(
        *cands.columns, "action", "alert_id", "alert_key", "n_cited", "n_fresh")


def merge(actions: DataFrame, current: DataFrame, cited: DataFrame, current_cites: DataFrame, amounts: DataFrame) -> DataFrame:
    """New values of every alert that an updated candidate merges into.

    Cited transactions the alert does not hold yet add to its value and count; scores and severity keep their maximum.
    `amounts` is (transaction_id, amount_usd).
    """
    keys = ["customer_id", "detector_id"]
    up = actions.filter("action = 'updated'")
    extra = (cited.join(up.select(*keys, "alert_id"), keys).join(current_cites.select("alert_id", "transaction_id"), ["alert_id", "transaction_id"], "left_anti")
             .join(amounts, "transaction_id").groupBy("alert_id").agg(F.count(F.lit(1)).alias("new_txns"), money_sum(F.col("amount_usd")).alias("new_usd")))
    old = current.select("alert_id", *[F.col(c).alias(f"old_{c}") for c in ("severity", "risk_score", "risk_contribution", "occurrence_count", "amount_usd", "txn_count")])
    j = up.join(old, "alert_id").join(extra, "alert_id", "left").fillna(0, ["new_txns", "new_usd"])
    rank = lambda c: lookup(F.col(c), SEVERITY_RANK, 0)
    return j.select(
        "alert_id", *keys, (F.col("old_occurrence_count") + 1).alias("occurrence_count"), F.greatest("old_risk_score", "score").alias("risk_score"),
        F.greatest("old_risk_contribution", "points").alias("risk_contribution"),
        F.when(rank("severity") > rank("old_severity"), F.col("severity")).otherwise(F.col("old_severity")).alias("severity"),
        F.when((F.col("new_usd") != 0) | F.col("old_amount_usd").isNotNull(), rnd(F.coalesce("old_amount_usd", F.lit(0.0)) + F.col("new_usd"))).alias("amount_usd"),
        (F.col("old_txn_count") + F.col("new_txns")).alias("txn_count"), "new_txns")


STATE = {"alert_id": "string", "customer_id": "bigint", "detector_id": "string", "status": "string", "severity": "string", "risk_score": "double",
         "risk_contribution": "double", "occurrence_count": "bigint", "amount_usd": "double", "txn_count": "bigint", "categories": "bigint", "network_points": "double",
         "identity_signals": "bigint", "account_id": "bigint", "first_transaction_id": "string", "triggered_at": "timestamp", "last_seen_at": "timestamp",
         "resolved_at": "timestamp", "resolution": "string", "triage_score": "double", "triage_priority": "string"}
CITES = {"alert_id": "string", "customer_id": "bigint", "detector_id": "string", "transaction_id": "string"}


def shaped(rows: DataFrame, shape: dict[str, str]) -> DataFrame:
    """The columns of a stored table; those that `rows` lacks are null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()])


def applied(actions: DataFrame, current: DataFrame, cites: DataFrame, cited: DataFrame, facts: DataFrame, context: DataFrame, amounts: DataFrame,
            as_of: datetime, rules: TriageRules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The alert table, its cited transactions and the events after a run: what `actions` create is added, what they update is merged, both are triaged.

    `current` and `cites` have the columns of `STATE` and `CITES`, `facts` those of `evidence_facts`, `context` those of `triage_context`. A merged
    alert keeps its account and first transaction, takes the customer facts of this run, and adds the evidence that it did not hold.
    """
    keys = ["customer_id", "detector_id"]
    customer = ["categories", "network_points", "identity_signals"]
    known = context.select("customer_id", *customer)
    mine = facts.select(*keys, "txn_count", "amount_usd", "first_transaction_id", "account_id")
    new = (actions.filter("action = 'created'").join(mine, keys, "left").join(known, "customer_id", "left").fillna(0, ["txn_count", *customer])
           .withColumns({"alert_id": F.col("alert_key"), "status": F.lit("NEW"), "risk_score": F.col("score"), "risk_contribution": F.col("points"),
                         "occurrence_count": F.lit(1), "triggered_at": F.lit(as_of), "last_seen_at": F.lit(as_of)}))
    changes = merge(actions, current, cited, cites, amounts).select(
        "alert_id", *[F.col(c).alias(f"new_{c}") for c in ("occurrence_count", "risk_score", "risk_contribution", "severity", "amount_usd", "txn_count")])
    merged = current.join(changes, "alert_id").drop(*customer).join(known, "customer_id", "left").fillna(0, customer)
    merged = merged.withColumns({c: F.col(f"new_{c}") for c in ("occurrence_count", "risk_score", "risk_contribution", "severity", "amount_usd", "txn_count")})
    merged = merged.withColumn("last_seen_at", F.lit(as_of))
    touched = shaped(new, STATE).withColumn("was", F.lit("created")).unionByName(shaped(merged, STATE).withColumn("was", F.lit("updated")))
    rest = current.join(changes.select("alert_id"), "alert_id", "left_anti").withColumn("was", F.lit(None).cast("string"))
    judged = triage(history(touched.unionByName(shaped(rest, STATE).withColumn("was", F.lit(None).cast("string")))), as_of, rules)
    fresh = F.col("was").isNotNull()
    alerts = judged.withColumns({"before": F.col("triage_priority"), "triage_score": F.when(fresh, F.col("new_score")).otherwise(F.col("triage_score")),
                                 "triage_priority": F.when(fresh, F.col("new_priority")).otherwise(F.col("triage_priority"))})
    happened = F.array_compact(F.array(F.col("was"), F.when((F.col("was") == "updated") & ~F.col("before").eqNullSafe(F.col("triage_priority")), "priority_changed")))
    events = alerts.filter(fresh).select("alert_id", *keys, "before", "triage_priority", F.explode(happened).alias("event"))
    held = actions.filter("action IN ('created', 'updated')").select(*keys, F.col("alert_key").alias("alert_id")).join(cited.select(*keys, "transaction_id").distinct(), keys)
    more = held.join(cites.select("alert_id", "transaction_id"), ["alert_id", "transaction_id"], "left_anti")
    return shaped(alerts, STATE), shaped(cites, CITES).unionByName(shaped(more, CITES)), events


def run_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers"))


# --------------------------------------------------------------------------------------------------------------- triage
def history(alerts: DataFrame) -> DataFrame:
    """Per alert: the customer's other confirmed alerts, and other clearances of the same rule. Counts per key minus the
    alert itself, so no pairs of alerts are formed."""
    confirmed = F.col("resolution") == "CONFIRMED_SUSPICIOUS"
    cleared = F.col("resolution").isin("CLEARED", "FALSE_POSITIVE")
    done = alerts.filter("status = 'RESOLVED'")
    c = done.groupBy("customer_id").agg(F.count(F.when(confirmed, 1)).alias("all_confirmed"))
    d = done.groupBy("customer_id", "detector_id").agg(F.count(F.when(cleared, 1)).alias("all_cleared"))
    own = F.col("status") == "RESOLVED"
    j = alerts.join(c, "customer_id", "left").join(d, ["customer_id", "detector_id"], "left").fillna(0, ["all_confirmed", "all_cleared"])
    return (j.withColumn("prior_confirmed", F.col("all_confirmed") - F.when(own & confirmed, 1).otherwise(0))
            .withColumn("prior_cleared", F.col("all_cleared") - F.when(own & cleared, 1).otherwise(0)).drop("all_confirmed", "all_cleared"))


# ---- fixed values: what each factor adds at most
FACTORS = {"detector_severity": 13.0, "customer_risk_score": 25.0, "detector_tier": 5.0, "corroborating_categories": 10.0,
           "amount_at_risk": 10.0, "evidence_volume": 5.0, "pattern_repetition": 5.0, "network_exposure": 7.0,
           "identity_device_signals": 5.0, "prior_confirmed_outcomes": 5.0, "no_prior_clearance": 5.0, "alert_age": 5.0}


def triage_factors(as_of: datetime, rules: TriageRules) -> dict[str, Column]:
    """Twelve capped factors of an alert row that carries its context and history; they add up to at most 100."""
    amount = F.when(F.col("amount_usd").isNull(), 0.0)
    for bound, pts in rules.amount_tiers:
        amount = amount.when(F.col("amount_usd") < bound, float(pts))
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("triggered_at")) / 3600e6
    age = F.when(F.col("status") != "RESOLVED", F.greatest(age, F.lit(0.0)))
    aged = F.lit(0.0)
    for hours, pts in rules.age_hours:
        aged = F.when(age >= hours, float(pts)).otherwise(aged)
    n, t, o, ident = F.col("categories"), F.col("txn_count"), F.col("occurrence_count"), F.col("identity_signals")
    raw = {
        "detector_severity": lookup(F.col("severity"), rules.severity_points, 0.0),
        "customer_risk_score": F.col("risk_score") / 100.0 * FACTORS["customer_risk_score"],
        "detector_tier": lookup(lookup(F.col("detector_id"), TIER, "context"), rules.tier_points, 0.0),
        "corroborating_categories": F.when(n == 0, 0.0).when(n == 1, 2.0).when(n == 2, 5.0).when(n == 3, 8.0).otherwise(10.0),
        "amount_at_risk": amount.otherwise(FACTORS["amount_at_risk"]),
        "evidence_volume": F.when(t == 0, 0.0).when(t == 1, 1.0).when(t < 5, 3.0).otherwise(5.0),
        "pattern_repetition": F.when(o <= 1, 1.0).when(o <= 3, 3.0).otherwise(5.0),
        "network_exposure": F.least(F.col("network_points") / float(rules.network_points_full), F.lit(1.0)) * FACTORS["network_exposure"],
        "identity_device_signals": F.when(ident == 0, 0.0).when(ident == 1, 3.0).otherwise(5.0),
        "prior_confirmed_outcomes": F.when(F.col("prior_confirmed") > 0, 5.0).otherwise(0.0),
        "no_prior_clearance": F.when(F.col("prior_cleared") > 0, 0.0).otherwise(5.0),
        "alert_age": F.when(age.isNull(), 0.0).otherwise(aged),
    }
    return {k: rnd(F.greatest(F.lit(0.0), F.least(v.cast("double"), F.lit(FACTORS[k])))) for k, v in raw.items()}


def triage(alerts: DataFrame, as_of: datetime, rules: TriageRules) -> DataFrame:
    """Score, priority and factors of every alert; expects the columns of `history`."""
    f = triage_factors(as_of, rules)
    out = alerts.withColumns({f"f_{k}": v for k, v in f.items()})
    total = sum((F.col(f"f_{k}").cast("decimal(18,2)") for k in list(f)[1:]), F.col(f"f_{list(f)[0]}").cast("decimal(18,2)"))
    return out.withColumn("new_score", rnd(total.cast("double"), 1)).withColumn("new_priority", ladder(F.col("new_score"), rules.thresholds, "LOW"))


def rescore(alerts: DataFrame, as_of: datetime, rules: TriageRules) -> DataFrame:
    """All unresolved alerts re-scored, with whether the priority changed."""
    t = triage(history(alerts), as_of, rules).filter(F.col("status").isin(*UNRESOLVED))
    return t.withColumn("changed", ~F.col("new_priority").eqNullSafe(F.col("triage_priority")))


# --------------------------------------------------------------------------------------------------------------- queues
@dataclass(frozen=True)
class QueueFilter:
    statuses: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    detector: str | None = None
    min_risk: float | None = None
    max_risk: float | None = None
    priorities: tuple[str, ...] = ()
    customer_id: object | None = None
    case_id: object | None = None
    assigned_to: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    text: str | None = None


def contains_text(columns: list[str], text: str) -> Column:
    """Case-insensitive substring over the joined columns; `%` and `_` in the text mean themselves."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lit(text.lower()))


def alert_queue(alerts: DataFrame, q: QueueFilter) -> DataFrame:
    tests = []
    for column, values in (("status", q.statuses), ("severity", q.severities), ("triage_priority", q.priorities)):
        if values:
            tests.append(F.col(column).isin(*values))
    for column, value in (("detector_id", q.detector), ("customer_id", q.customer_id), ("case_id", q.case_id)):
        if value is not None:
            tests.append(F.col(column) == value)
    if q.assigned_to is not None:
        tests.append(F.col("assigned_to").isNull() if q.assigned_to == "unassigned" else F.col("assigned_to") == q.assigned_to)
    for column, low, high in (("risk_score", q.min_risk, q.max_risk), ("triggered_at", q.date_from, q.date_to)):
        if low is not None:
            tests.append(F.col(column) >= F.lit(low))
        if high is not None:
            tests.append(F.col(column) <= F.lit(high))
    if q.text:
        tests.append(contains_text(["alert_id", "customer_id", "detector_id", "description"], q.text))
    out = alerts
    for t in tests:
        out = out.filter(t)
    return out


SORT_KEYS = ("triggered_at", "severity_rank", "triage_score", "risk_score", "risk_contribution", "occurrence_count", "status", "customer_id")


def queue_page(alerts: DataFrame, sort: str, descending: bool, offset: int, limit: int, tie: str = "alert_id") -> DataFrame:
    """One page in queue order with the total number of matches; alerts without a triage score come last."""
    key = lookup(F.col("severity"), SEVERITY_RANK, 0) if sort == "severity_rank" else F.col(sort if sort in SORT_KEYS else "triggered_at")
    total = alerts.agg(F.count(F.lit(1)).alias("total_matches"))
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return alerts.orderBy(order, F.col(tie)).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def case_queue(cases: DataFrame, statuses: tuple[str, ...] = (), priority: str | None = None, customer_id=None, assigned_to: str | None = None,
               text: str | None = None) -> DataFrame:
    """Cases that match, newest change first."""
    out = cases
    if statuses:
        out = out.filter(F.col("status").isin(*statuses))
    if priority:
        out = out.filter(F.col("priority") == priority)
    if customer_id is not None:
        out = out.filter(F.col("customer_id") == customer_id)
    if assigned_to:
        out = out.filter(F.col("assigned_to").isNull() if assigned_to == "unassigned" else F.col("assigned_to") == assigned_to)
    if text:
        out = out.filter(contains_text(["case_number", "customer_id", "title"], text))
    return out.orderBy(F.col("updated_at").desc(), "case_id")


# ----------------------------------------------------------------------------------------------------- rates and counts
def rate(num: Column, den: Column, digits: int = 4) -> Column:
    """Rounded ratio; null when the denominator is zero."""
    return F.when(den > 0, rnd(num / den, digits))


def kpis(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    open_ = F.col("status").isin(*UNRESOLVED)
    fp = F.col("resolution").isin("CLEARED", "FALSE_POSITIVE")
    a = alerts.agg(
        F.count(F.lit(1)).alias("alerts_generated"), F.count(F.when(open_, 1)).alias("open_alerts"),
        F.count(F.when(open_ & F.col("severity").isin("high", "critical"), 1)).alias("high_risk_alerts"),
        F.count(F.when(~open_, 1)).alias("resolved_alerts"), F.count(F.when(~open_ & fp, 1)).alias("fp"),
        F.count(F.when(~open_ & (F.col("resolution") == "CONFIRMED_SUSPICIOUS"), 1)).alias("confirmed"))
    hours = (F.unix_micros("closed_at") - F.unix_micros("opened_at")) / 3600e6
    c = cases.agg(
        F.count(F.when(F.col("status").isin("OPEN", "INVESTIGATING", "PENDING_REVIEW"), 1)).alias("cases_under_investigation"),
        F.count(F.when(F.col("status") == "ESCALATED", 1)).alias("cases_escalated"), F.count(F.when(F.col("status") == "CLOSED", 1)).alias("cases_resolved"),
        F.avg(F.when((F.col("status") == "CLOSED") & F.col("closed_at").isNotNull(), hours)).alias("h"))
    return a.crossJoin(F.broadcast(c)).select(  # one row each
        "alerts_generated", "open_alerts", "high_risk_alerts", "resolved_alerts", rate(F.col("fp"), F.col("resolved_alerts")).alias("false_discovery_rate"),
        rate(F.col("confirmed"), F.col("resolved_alerts")).alias("confirmation_rate"), "cases_under_investigation", "cases_escalated", "cases_resolved",
        rnd(F.col("h"), 3).alias("avg_investigation_hours"))


def kpi_counts(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """(measure, name, n): alerts by status and by rule, open alerts by severity, cases by status. Each table is read once, for all its groupings."""
    open_severity = F.when(F.col("status").isin(*UNRESOLVED), F.col("severity"))
    a = (alerts.select("status", "detector_id", open_severity.alias("severity"))
         .groupingSets([["status"], ["detector_id"], ["severity"]], "status", "detector_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")))
    measure = F.when(F.col("g") == 0b011, "alerts_by_status").when(F.col("g") == 0b101, "alerts_by_detector").otherwise("open_alerts_by_severity")
    a = a.select(measure.alias("measure"), F.coalesce("status", "detector_id", "severity").alias("name"), "n").filter("name IS NOT NULL")
    return a.unionByName(cases.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("cases_by_status").alias("measure"), "name", "n"))


def run_measures(runs: DataFrame) -> DataFrame:
    """Monitoring runs (started_at, transactions_in_scope, customers_evaluated, duration_ms, alerts_created) in one row; nulls without runs."""
    r = runs.agg(F.count(F.lit(1)).alias("monitoring_runs"), F.max_by("transactions_in_scope", "started_at").alias("transactions_monitored_last_run"),
                 F.coalesce(F.sum("customers_evaluated"), F.lit(0)).alias("customers_evaluated_total"), F.sum("duration_ms").alias("ms"), F.coalesce(F.sum("alerts_created"), F.lit(0)).alias("alerts_created_total"))
    return r.withColumn("avg_detection_ms_per_customer", F.when(F.col("customers_evaluated_total") > 0, rnd(F.col("ms") / F.col("customers_evaluated_total")))).drop("ms")


def alert_quality(alerts: DataFrame, since: datetime | None = None, low_sample: int = 30) -> DataFrame:
    """Rates over decided alerts, overall and by priority, rule and severity, in one pass."""
    pool = alerts if since is None else alerts.filter(F.col("triggered_at") >= F.lit(since))
    pool = pool.withColumn("priority", F.coalesce("triage_priority", F.lit("UNSCORED")))
    groups = F.array(F.struct(F.lit("overall").alias("by"), F.lit("all").alias("value")), F.struct(F.lit("priority").alias("by"), F.col("priority").alias("value")),
                     F.struct(F.lit("detector").alias("by"), F.col("detector_id").alias("value")), F.struct(F.lit("severity").alias("by"), F.col("severity").alias("value")))
    decided = (F.col("status") == "RESOLVED") & F.col("resolution").isNotNull()
    res = lambda *names: F.count(F.when(decided & F.col("resolution").isin(*names), 1))
    g = pool.select("status", "resolution", F.explode(groups).alias("g")).groupBy("g.by", "g.value").agg(
        F.count(F.lit(1)).alias("alerts"), F.count(F.when(decided, 1)).alias("decided"), res("CONFIRMED_SUSPICIOUS").alias("confirmed"),
        res("CLEARED").alias("cleared"), res("FALSE_POSITIVE").alias("false_positive"))
    return g.withColumn("confirmation_rate", rate(F.col("confirmed"), F.col("decided"))).withColumn(
        "false_discovery_rate", rate(F.col("cleared") + F.col("false_positive"), F.col("decided"))).withColumn(
        "closure_rate", rate(F.col("decided"), F.col("alerts"))).withColumn("low_sample", F.col("decided") < low_sample)


def decision_hours(alerts: DataFrame) -> DataFrame:
    """Median and longest time to a decision; the median is exact and distributed."""
    from riskloom.operators.quantiles import exact_quantiles, value_counts
    hours = ((F.unix_micros("resolved_at") - F.unix_micros("triggered_at")) / 3600e6).alias("hours")
    rows = alerts.filter("status = 'RESOLVED' AND resolved_at IS NOT NULL").select(F.lit("all").alias("key"), hours)
    q = exact_quantiles(value_counts(rows, ["key"], "hours"), ["key"], {"median": 0.5, "max": 1.0})
    return q.select("total", rnd(F.col("median")).alias("median_hours"), rnd(F.col("max")).alias("max_hours"))


def feedback(alerts: DataFrame, limit: int = 200) -> DataFrame:
    """Recorded decisions, newest first."""
    return (alerts.filter("status = 'RESOLVED' AND resolution IS NOT NULL").orderBy(F.col("resolved_at").desc(), "alert_id").limit(limit))


def my_work(alerts: DataFrame, cases: DataFrame, as_of: datetime, rules: TriageRules, recent_days: int = 7) -> DataFrame:
    """Counts of every assignee's queue: open, high priority, overdue, escalated, recent decisions, open cases."""
    open_ = F.col("status").isin(*UNRESOLVED)
    hours = (F.unix_micros(F.lit(as_of)) - F.unix_micros("triggered_at")) / 3600e6
    due = lookup(F.coalesce("triage_priority", F.lit("LOW")), rules.overdue_hours, rules.overdue_hours["LOW"])
    recent = ~open_ & (F.col("resolved_at") >= F.lit(as_of - timedelta(days=recent_days)))
    a = alerts.filter("assigned_to IS NOT NULL").groupBy("assigned_to").agg(
        F.count(F.when(open_, 1)).alias("open"), F.count(F.when(open_ & F.col("triage_priority").isin("CRITICAL", "HIGH"), 1)).alias("high_priority"),
        F.count(F.when(open_ & (hours > due), 1)).alias("overdue"), F.count(F.when(F.col("status") == "ESCALATED", 1)).alias("escalated"),
        F.count(F.when(recent & (F.col("resolution") == "CONFIRMED_SUSPICIOUS"), 1)).alias("confirmed_recent"),
        F.count(F.when(recent & F.col("resolution").isin("CLEARED", "FALSE_POSITIVE"), 1)).alias("cleared_recent"))
    c = cases.filter("status <> 'CLOSED' AND assigned_to IS NOT NULL").groupBy("assigned_to").agg(F.count(F.lit(1)).alias("open_cases"))
    return a.join(c, "assigned_to", "full").fillna(0)


def my_open_alerts(alerts: DataFrame, k: int = 50) -> DataFrame:
    """Every assignee's open alerts by triage score, the first k."""
    mine = alerts.filter(F.col("status").isin(*UNRESOLVED) & F.col("assigned_to").isNotNull())
    return top_k(mine, ["assigned_to"], [F.col("triage_score").desc_nulls_last(), F.col("alert_id")], k)


# ------------------------------------------------------------------------------------------------------- state and logs
# ---- fixed values: legal status changes of alerts and of cases
ALERT_MOVES = {"NEW": ("TRIAGED", "INVESTIGATING", "ESCALATED", "RESOLVED"), "TRIAGED": ("INVESTIGATING", "ESCALATED", "RESOLVED"),
               "INVESTIGATING": ("ESCALATED", "RESOLVED"), "ESCALATED": ("INVESTIGATING", "RESOLVED"), "RESOLVED": ()}
CASE_MOVES = {"OPEN": ("INVESTIGATING", "CLOSED"), "INVESTIGATING": ("ESCALATED", "PENDING_REVIEW", "CLOSED"),
              "ESCALATED": ("INVESTIGATING", "PENDING_REVIEW", "CLOSED"), "PENDING_REVIEW": ("INVESTIGATING", "CLOSED"), "CLOSED": ()}


def illegal_moves(events: DataFrame, moves: dict[str, tuple[str, ...]] = ALERT_MOVES) -> DataFrame:
    """Log rows whose change of status is not allowed."""
    legal = events.sparkSession.createDataFrame([(a, b) for a, bs in moves.items() for b in bs], "from_status string, to_status string")
    return events.join(F.broadcast(legal), ["from_status", "to_status"], "left_anti")  # a dozen legal pairs


def incomplete_changes(events: DataFrame, min_reason: int = 5) -> DataFrame:
    """Log rows whose change is legal but lacks what it needs: a known resolution and a reason when resolving, a reason
    when escalating, no resolution otherwise. Expects `to_status`, `resolution` and `reason`."""
    short = F.length(F.trim(F.coalesce("reason", F.lit("")))) < min_reason
    unknown = ~F.coalesce(F.col("resolution").isin(*RESOLUTIONS), F.lit(False))
    fault = (F.when((F.col("to_status") == "RESOLVED") & unknown, "resolution missing").when((F.col("to_status") == "RESOLVED") & short, "reason too short")
             .when((F.col("to_status") != "RESOLVED") & F.col("resolution").isNotNull(), "resolution not allowed")
             .when((F.col("to_status") == "ESCALATED") & short, "reason too short"))
    return events.withColumn("fault", fault).filter("fault IS NOT NULL")


def current_status(events: DataFrame, key: str = "alert_id") -> DataFrame:
    """Latest status per key: a maximum, combined before the shuffle."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "to_status")).alias("x"), F.count(F.lit(1)).alias("changes")).select(
        key, F.col("x.to_status").alias("status"), F.col("x.ts").alias("since"), "changes")


def cascade(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """Alert states after their case's decision: a closing decision resolves, an escalation escalates."""
    d = cases.filter("decision IS NOT NULL OR status = 'ESCALATED'").select("case_id", F.coalesce("decision", F.lit("ESCALATED")).alias("d"), "closed_at")
    j = alerts.filter("status <> 'RESOLVED'").join(d, "case_id")
    touched = (F.col("d") != "ESCALATED") | (F.col("status") != "ESCALATED")
    return j.filter(touched).select("alert_id", "case_id", F.when(F.col("d") == "ESCALATED", "ESCALATED").otherwise("RESOLVED").alias("new_status"),
                                    F.when(F.col("d") != "ESCALATED", F.col("d")).alias("new_resolution"))


def attach_to_cases(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """Unresolved alerts without a case join the customer's unclosed case, or the customer's new one."""
    free = alerts.filter(F.col("status").isin(*UNRESOLVED) & F.col("case_id").isNull())
    rank = lookup(F.col("severity"), SEVERITY_RANK, 0)
    top = free.groupBy("customer_id").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("n_alerts"))
    open_ = cases.filter("status <> 'CLOSED'").groupBy("customer_id").agg(F.min("case_id").alias("open_case"))
    per = top.join(open_, "customer_id", "left").withColumn("case_key", F.coalesce(F.col("open_case").cast("string"), F.concat(F.lit("CASE-"), F.col("customer_id").cast("string"))))
    label = F.element_at(F.array(*[F.lit(k) for k in SEVERITY_RANK]), F.col("top") + 1)
    per = per.select("customer_id", "case_key", F.col("open_case").isNull().alias("new_case"), label.alias("priority"), "n_alerts")
    moved = F.when(F.col("status").isin("NEW", "TRIAGED"), "INVESTIGATING").otherwise(F.col("status"))
    return free.join(per, "customer_id").select("alert_id", "customer_id", "case_key", "new_case", "priority", "n_alerts", moved.alias("new_status"))


def timeline(case_events: DataFrame, alert_events: DataFrame, notes: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """One log per case from three; `place` counts its rows in time order. Each input has case_id, ts and its own columns, `ties` order equal times."""
    parts = [case_events.withColumn("origin", F.lit("case")), alert_events.withColumn("origin", F.lit("alert")), notes.withColumn("origin", F.lit("note"))]
    log = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return log.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "origin", *ties)))


def workbench(cases: DataFrame, alerts: DataFrame, scored: DataFrame, legs: DataFrame, counterparties: DataFrame, log: DataFrame,
              recent: int = 50) -> DataFrame:
    """All unclosed cases with customer score, alerts, recent transactions, counterparties and timeline as bounded lists."""
    c = cases.filter("status <> 'CLOSED'")
    ids = c.select("customer_id").distinct()
    a = alerts.join(c.select("case_id"), "case_id", "left_semi")
    tops = top_k(a, ["case_id"], [F.col("triage_score").desc_nulls_last(), F.col("alert_id")], recent)
    tops = tops.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "alert_id", "detector_id", "status"))).alias("alerts"))
    n_alerts = a.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_alerts"))
    mine = legs.filter("period = 'win'").withColumnRenamed("entity_id", "customer_id").join(ids, "customer_id", "left_semi")
    tx = top_k(mine, ["customer_id"], [F.col("ts").desc(), F.col("transaction_id")], recent).groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "transaction_id", "amount_usd"))).alias("recent_transactions"))
    cp = counterparties.join(ids, "customer_id", "left_semi").groupBy("customer_id").agg(
        F.count(F.when(F.col("degree") == 1, 1)).alias("direct_counterparties"), F.count(F.when(F.col("degree") == 2, 1)).alias("second_counterparties"))
    ev = top_k(log.join(c.select("case_id"), "case_id", "left_semi"), ["case_id"], [F.col("ts").desc(), F.col("event_id")], recent).groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "origin", "event_id"))).alias("timeline"))
    out = c.join(scored.withColumnRenamed("entity_id", "customer_id").select("customer_id", "score", "band"), "customer_id", "left")
    for part, key in ((tops, "case_id"), (n_alerts, "case_id"), (tx, "customer_id"), (cp, "customer_id"), (ev, "case_id")):
        out = out.join(part, key, "left")
    return value_or_zero(out, "n_alerts", "direct_counterparties", "second_counterparties")

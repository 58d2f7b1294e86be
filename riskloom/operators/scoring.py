"""Points, score, categories, explanation and evidence from rule results."""
from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.config import CATEGORY_LABELS, DETECTORS, EVALUATION_ORDER, GROUP_CAPS, WEIGHTS, RiskRules
from riskloom.functions.numeric import ladder, lookup, rnd, severity, top_k
from riskloom.operators import detectors as det
from riskloom.operators.fifo import pass_through
from riskloom.operators.orient import device_users
from riskloom.operators.profile import KEYS, done, is_in, is_out
from riskloom.session import stage_parts

ORDER = {name: i for i, name in enumerate(EVALUATION_ORDER)}
CATEGORY = {d[0]: d[2] for d in DETECTORS}
CENTS = "decimal(18,2)"


def contributions(results: DataFrame) -> DataFrame:
    """Points of every fired rule. Rules of one group share a cap, spent in order of raw points."""
    fired = results.filter("state = 'fired'")
    d = F.col("detector")
    fired = (fired.withColumn("weight", lookup(d, {k: v[0] for k, v in WEIGHTS.items()}, 0.0).cast("double"))
             .withColumn("grp", lookup(d, {k: v[1] for k, v in WEIGHTS.items()}))
             .withColumn("cap", lookup(F.col("grp"), GROUP_CAPS).cast("double"))
             .withColumn("place", lookup(d, ORDER, 99)).withColumn("category", lookup(d, CATEGORY, "other"))
             .withColumn("raw_points", rnd(F.col("weight") * F.col("strength"))))
    # at most the handful of rules of one group per entity
    w = W.partitionBy("entity_id", "grp").orderBy(F.col("raw_points").desc(), "place").rowsBetween(W.unboundedPreceding, 0)
    spent = F.sum(F.col("raw_points").cast(CENTS)).over(w).cast("double")
    allowed = F.least(F.col("cap"), spent) - F.least(F.col("cap"), F.round(spent - F.col("raw_points"), 2))
    points = F.when(F.col("cap").isNull(), F.col("raw_points")).otherwise(rnd(allowed))
    return (fired.withColumn("points", points).withColumn("capped", F.col("points") < F.col("raw_points"))
            .select("entity_id", "detector", "category", "grp", "place", "weight", "strength", "observed", "threshold",
                    "baseline", "raw_points", "points", "capped"))


def points_sum() -> Column:
    return F.sum(F.col("points").cast(CENTS)).cast("double")


def band(score: Column, rules: RiskRules) -> Column:
    return ladder(score, rules.bands, "low")


def scores(contribs: DataFrame, entities: DataFrame, rules: RiskRules) -> DataFrame:
    """Score, band and flag of every entity; entities without a fired rule score 0."""
    s = contribs.groupBy("entity_id").agg(points_sum().alias("sum"), F.count(F.lit(1)).alias("n_fired"))
    out = entities.select("entity_id").join(s, "entity_id", "left")
    out = out.withColumn("score", rnd(F.least(F.lit(rules.score_cap), F.coalesce(F.col("sum"), F.lit(0.0))), 1))
    return out.select("entity_id", "score", band(F.col("score"), rules).alias("band"),
                      (F.col("score") >= rules.investigate_at).alias("flagged"),
                      F.coalesce("n_fired", F.lit(0)).alias("n_fired"))


def category_breakdown(contribs: DataFrame, scored: DataFrame) -> DataFrame:
    """Points per category, and a `cap_adjustment` row where the total cap took points away."""
    per = contribs.groupBy("entity_id", "category").agg(
        points_sum().alias("points"), F.array_join(F.array_sort(F.collect_list("detector")), ",").alias("signals"))
    total = per.groupBy("entity_id").agg(points_sum().alias("sum"))
    adj = (scored.join(total, "entity_id").withColumn("points", F.round(F.col("score") - F.col("sum"), 2))
           .filter(F.abs("points") >= 0.05)
           .select("entity_id", F.lit("cap_adjustment").alias("category"), "points", F.lit("").alias("signals")))
    label = lookup(F.col("category"), CATEGORY_LABELS, "Global score cap")
    return per.unionByName(adj).withColumn("label", label)


def explanations(contribs: DataFrame, scored: DataFrame, categories: DataFrame, rules: RiskRules) -> DataFrame:
    """One sentence per entity: score, side of the threshold, four largest rules, three largest categories."""
    top = top_k(contribs, ["entity_id"], [F.col("points").desc(), F.col("place")], 4)
    rule = F.struct("rank", F.format_string("%s +%.1f", "detector", rnd(F.col("points"), 1)).alias("t"))
    rules_text = top.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(rule)), lambda x: x["t"]), ", ").alias("rules"))
    cats = top_k(categories.filter("category <> 'cap_adjustment'"), ["entity_id"], [F.col("points").desc(), F.col("category")], 3)
    cat = F.struct("rank", F.format_string("%s %.1f", "label", rnd(F.col("points"), 1)).alias("t"))
    cats_text = cats.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cat)), lambda x: x["t"]), ", ").alias("cats"))
    j = scored.join(rules_text, "entity_id", "left").join(cats_text, "entity_id", "left")
    side = F.when(F.col("flagged"), "above").otherwise("below")
    text = F.when(F.col("rules").isNull(), F.format_string("Score %.1f (%s): no rule crossed its threshold.", "score", "band")).otherwise(
        F.format_string("Score %.1f (%s), %s the investigation threshold of %.0f. Largest: %s. Categories: %s.", "score", "band", side,
                        F.lit(rules.investigate_at), "rules", "cats"))
    return j.select("entity_id", text.alias("explanation"))


def data_quality_notes(activity: DataFrame, rules: RiskRules) -> DataFrame:
    """Notes on thin baselines and empty windows."""
    thin = F.when(F.col("n_base_out") < rules.thin_baseline,
                  F.format_string("thin baseline: %d outbound transactions", F.col("n_base_out")))
    empty = F.when(F.col("n_win") == 0, "no transactions in the window")
    return activity.select("entity_id", F.array_compact(F.array(thin, empty)).alias("notes"))


def detector_table(results: DataFrame, contribs: DataFrame, entities: DataFrame) -> DataFrame:
    """Every rule for every entity: fired ones with points, the others with the reason."""
    cat = results.sparkSession.createDataFrame(
        [(d[0], d[1], d[2], i) for i, d in enumerate(DETECTORS)], "detector string, name string, category string, place int")
    grid = entities.select("entity_id").crossJoin(F.broadcast(cat))  # the catalogue has twenty rows
    keys = ["entity_id", "detector"]
    j = grid.join(results.select(*keys, "state", "observed", "threshold", "strength"), keys, "left").join(
        contribs.select(*keys, "points"), keys, "left")
    reason = (F.when(F.col("state") == "fired", "triggered").when(F.col("state") == "not_evaluated", "not evaluated")
              .when(F.col("state").isNotNull(), "below threshold").otherwise("no data"))
    return j.select(*keys, "name", "category", (F.coalesce(F.col("state"), F.lit("")) == "fired").alias("triggered"),
                    F.coalesce("points", F.lit(0.0)).alias("points"), "observed", "threshold",
                    F.when(F.col("state") == "fired", severity(F.col("strength"))).alias("severity"), reason.alias("reason"))


def with_confidence(contribs: DataFrame, activity: DataFrame, rules: RiskRules) -> DataFrame:
    """How far to trust a fired rule: fixed for some rules, otherwise lower with a thin baseline."""
    thin = F.coalesce(F.col("n_base_out"), F.lit(0)) < rules.thin_baseline
    d = F.col("detector")
    c = (F.when(d == "CIRCULAR_FLOW", 0.9).when(d == "HISTORICAL_ALERTS", 0.7).when(d == "ML_ANOMALY", 0.6)
         .when((d == "NEW_DEVICE") & (F.col("baseline") == 0), 0.5).when(thin, 0.6)
         .when(d == "NEW_DEVICE", 0.85).otherwise(0.9))
    return contribs.join(activity.select("entity_id", "n_base_out"), "entity_id", "left").withColumn("confidence", c).drop("n_base_out")


# ----------------------------------------------------------------------------------------------------------- evidence
def evidence(f: det.Frames, results: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(entity_id, detector, pos, kind, id): what supports each fired rule, at most 25 references per rule.

    Every list is cut by `top_k`, which limits before the shuffle.
    """
    fired = results.filter("state = 'fired'").select("entity_id", "detector", "mark")

    def one(name: str) -> DataFrame:
        of = fired.filter(F.col("detector") == name).drop("detector")
        rows = None
        for part in EVIDENCE[name](f, of):
            part = part.select("entity_id", F.lit(name).alias("detector"), "pos", "kind", "id")
            rows = part if rows is None else rows.unionByName(part)
        return top_k(rows, ["entity_id"], [F.col("pos")], f.rules.evidence_limit, "place").drop("place")

    chosen = [n for n in names or tuple(EVIDENCE) if n in EVIDENCE]
    return stage_parts(f.txn.sparkSession, [lambda n=n: one(n) for n in chosen], "evidence")


BY_TIME = ("ts", "transaction_id")


def _refs(rows: DataFrame, order, k: int, kind: str = "transaction", key: str = "transaction_id", start: int = 0) -> DataFrame:
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    return top_k(rows, ["entity_id"], order, k).select("entity_id", (F.col("rank") + start).cast("int").alias("pos"), F.lit(kind).alias("kind"),
                                                      F.col(key).cast("string").alias("id"))


def _win(f: det.Frames) -> DataFrame:
    return f.legs.filter("period = 'win'").select(
        "entity_id", "transaction_id", "ts", "sec", "direction", "status", "amount_usd", "transaction_type", "device_id")


def _of_fired(f: det.Frames, of: DataFrame) -> det.Frames:
    """The same inputs with the rows of fired entities only, for rules whose evidence starts with work on an entity's own rows."""
    return replace(f, legs=f.legs.join(of, "entity_id", "left_semi"))


def _since_mark(rows: DataFrame, of: DataFrame, width: int) -> DataFrame:
    return rows.join(of, "entity_id").filter((F.col("sec") >= F.col("mark")) & (F.col("sec") <= F.col("mark") + width))


def _burst(f, of):
    return [_refs(_since_mark(_win(f).filter(is_out()), of, f.rules.burst_minutes * 60), BY_TIME, 10)]


def _velocity(f, of):
    out = _win(f).filter(is_out()).withColumn("day", F.to_date("ts")).join(of, "entity_id", "left_semi")
    peak = out.groupBy("entity_id", "day").agg(F.count(F.lit(1)).alias("c")).groupBy("entity_id").agg(
        F.max_by("day", F.struct("c", -F.unix_date("day"))).alias("day"))
    return [_refs(out.join(peak, ["entity_id", "day"]), BY_TIME, 10)]


def _amount(f, of):
    rows = _win(f).filter(is_out() & done()).join(of, "entity_id").filter(F.col("amount_usd") >= F.col("mark"))
    return [_refs(rows, [F.col("amount_usd").desc(), "transaction_id"], 10)]


def _pass_through(f, of):
    matched = pass_through(_of_fired(f, of).legs.filter("period = 'win'"), KEYS, f.rules.pass_hours, f.rules.pass_types)
    return [matched.select("entity_id", F.posexplode("pairs").alias("p", "id")).select(
        "entity_id", (F.col("p") + 1).alias("pos"), F.lit("transaction").alias("kind"), "id")]


def _fan_in(f, of):
    return [_refs(_win(f).filter(is_in()).join(of, "entity_id", "left_semi"), BY_TIME, 12)]


def _fan_out(f, of):
    rows = _win(f).filter(is_out() & done() & F.col("transaction_type").isin(*f.rules.fan_out_types))
    return [_refs(rows.join(of, "entity_id", "left_semi"), BY_TIME, 12)]


def _structuring(f, of):
    return [_refs(_since_mark(det.band_rows(f).filter("period = 'win'"), of, f.rules.band_hours * 3600), BY_TIME, 10)]


def _new_country(f, of):
    return [_refs(det.new_country_rows(_of_fired(f, of)), BY_TIME, 10)]


def _travel(f, of):
    win = f.legs.filter(is_out() & (F.col("period") == "win")).join(of, "entity_id", "left_semi")
    pairs = top_k(det.travel_pairs(win, ["entity_id"], f.rules), ["entity_id"], [F.col(c) for c in BY_TIME], 5)
    return [pairs.select("entity_id", "rank", F.posexplode(F.array("prev_transaction_id", "transaction_id")).alias("p", "x")).select(
        "entity_id", (F.col("rank") * 2 - 1 + F.col("p")).cast("int").alias("pos"), F.lit("transaction").alias("kind"), F.col("x").cast("string").alias("id"))]


def _new_device(f, of):
    f = _of_fired(f, of)
    fresh = det.device_use(f).filter("n_base = 0 AND n_win > 0").select("entity_id", "device_id")
    rows = _win(f).filter(is_out()).join(fresh, ["entity_id", "device_id"], "left_semi")
    return [_refs(fresh, ["device_id"], 5, "device", "device_id"), _refs(rows, BY_TIME, 8, start=5)]


def _device_sharing(f, of):
    users = device_users(f.txn, f.accounts, f.period.end - timedelta(days=f.rules.sharing_days), f.period.end).select("device_id", "customer_id")
    shared = users.groupBy("device_id").agg(F.count(F.lit(1)).alias("customers")).filter(F.col("customers") >= f.rules.sharing_customers)
    mine = (_win(f).filter(is_out() & F.col("device_id").isNotNull()).select("entity_id", "device_id").distinct()
            .join(of, "entity_id", "left_semi").join(shared, "device_id"))
    devices = top_k(mine, ["entity_id"], [F.col("customers").desc(), F.col("device_id")], f.rules.evidence_limit)
    some = top_k(users, ["device_id"], [F.col("customer_id")], 9).drop("rank")  # eight others and possibly the entity itself
    others = (devices.withColumnRenamed("rank", "device_rank").join(some, "device_id")
              .join(f.owner().withColumnRenamed("customer_id", "self"), "entity_id").filter("customer_id <> self"))
    users_of_each = top_k(others, ["entity_id", "device_rank"], [F.col("customer_id")], 8)
    return [devices.select("entity_id", (F.col("rank") * 9).cast("int").alias("pos"), F.lit("device").alias("kind"), F.col("device_id").cast("string").alias("id")),
            users_of_each.select("entity_id", (F.col("device_rank") * 9 + F.col("rank")).cast("int").alias("pos"), F.lit("customer").alias("kind"),
                                 F.col("customer_id").cast("string").alias("id"))]


def _identifier(f, of):
    r, ids = f.rules, ["identifier_type", "value_hash"]
    members = det.identifier_groups(f.identifiers).filter((F.col("customers") >= r.identifier_customers) | F.col("identifier_type").isin(*r.identifier_always))
    some = top_k(members.select(*ids, F.col("customer_id").alias("other")), ids, [F.col("other")], r.evidence_limit + 1).drop("rank")
    mine = members.select(*ids, "customer_id").join(f.owner(), "customer_id").join(of, "entity_id", "left_semi")
    peers = mine.join(some, ids).filter("other <> customer_id").select("entity_id", "other").distinct()
    return [_refs(peers, ["other"], r.evidence_limit, "customer", "other")]


def _cycle(f, of):
    own = f.accounts.select(F.col("customer_id" if f.grain == "customer" else "account_id").alias("entity_id"), "account_id")
    mine = f.cycles.select("cycle", "ids", F.explode("cycle").alias("account_id")).join(own, "account_id").select("entity_id", "cycle", "ids").distinct()
    five = top_k(mine.join(of, "entity_id", "left_semi"), ["entity_id"], [F.col("cycle")], 5)
    head = F.array(F.struct(F.lit("cycle").alias("kind"), F.array_join(F.array_append("cycle", F.col("cycle")[0]).cast("array<string>"), " -> ").alias("id")))
    hops = F.transform(F.col("ids").cast("array<string>"), lambda x: F.struct(F.lit("transaction").alias("kind"), x.alias("id")))
    return [five.select("entity_id", "rank", F.posexplode(F.concat(head, hops)).alias("p", "i")).select(
        "entity_id", (F.col("rank") * 8 + F.col("p")).cast("int").alias("pos"), "i.kind", "i.id")]


def _dormant(f, of):
    """The reactivated account of the largest value, then its own rows of the window."""
    hits = det.dormant_accounts(f).filter("hit").join(of, "entity_id", "left_semi")
    account = hits.groupBy("entity_id").agg(F.max(F.struct("usd", "gap", "account_id")).alias("h")).select("entity_id", F.col("h.account_id").alias("account_id"))
    window = f.txn.filter((F.col("ts") >= F.lit(f.period.window_start)) & (F.col("ts") <= F.lit(f.period.end)))
    rows = det.account_rows(window, "transaction_id").join(account, "account_id")
    return [account.select("entity_id", F.lit(0).alias("pos"), F.lit("account").alias("kind"), F.col("account_id").cast("string").alias("id")),
            _refs(rows, BY_TIME, 10)]


def _merchant(f, of):
    paid = det.high_risk_payments(f).filter("period = 'win'").join(of, "entity_id", "left_semi")
    per = paid.groupBy("entity_id", "merchant_id").agg(F.count(F.lit(1)).alias("c"))
    return [_refs(per, [F.col("c").desc(), "merchant_id"], 5, "merchant", "merchant_id"), _refs(paid, BY_TIME, 10, start=5)]


def _exposure(f, of):
    flags = det.flagged_customers(f.alerts, f.investigations)
    hit = det.exposure_pairs(f).join(flags, F.col("other") == F.col("customer_id"), "left_semi").join(of, "entity_id", "left_semi")
    return [_refs(hit, ["other"], 10, "customer", "other")]


def _history(f, of):
    old = f.alerts.filter(F.col("created_at") < F.lit(f.period.window_start)).select("alert_id", "created_at", F.col("entity_id").alias("customer_id"))
    return [_refs(old.join(f.owner(), "customer_id").join(of, "entity_id", "left_semi"), [F.col("created_at").desc(), "alert_id"], 10, "alert", "alert_id")]


EVIDENCE = {
    "TRANSACTION_BURST": _burst, "VELOCITY_SPIKE": _velocity, "AMOUNT_DEVIATION": _amount, "PEER_AMOUNT_DEVIATION": _amount,
    "RAPID_PASS_THROUGH": _pass_through, "FAN_IN": _fan_in, "FAN_OUT": _fan_out, "STRUCTURING": _structuring, "GEO_NEW_COUNTRY": _new_country,
    "IMPOSSIBLE_TRAVEL": _travel, "NEW_DEVICE": _new_device, "DEVICE_SHARING": _device_sharing, "SHARED_IDENTIFIER": _identifier,
    "CIRCULAR_FLOW": _cycle, "DORMANT_REACTIVATION": _dormant, "HIGH_RISK_MERCHANT": _merchant, "NETWORK_EXPOSURE": _exposure,
    "HISTORICAL_ALERTS": _history,
}


def supporting_transactions(ev: DataFrame, limit: int = 200) -> DataFrame:
    """Distinct transactions cited for an entity, in order of rule and position, the first `limit`."""
    order = lookup(F.col("detector"), ORDER, 99)
    first = ev.filter("kind = 'transaction'").groupBy("entity_id", "id").agg(F.min(F.struct(order.alias("d"), F.col("pos"))).alias("o"))
    return top_k(first, ["entity_id"], [F.col("o"), F.col("id")], limit).select("entity_id", F.col("id").alias("transaction_id"), "rank")


def most_cited(ev: DataFrame, txn: DataFrame, k: int = 5) -> DataFrame:
    """Transactions ranked by how many rules cite them, then by value."""
    cites = ev.filter("kind = 'transaction'").groupBy("entity_id", "id").agg(
        F.array_sort(F.collect_set("detector")).alias("signals"))
    values = txn.select(F.col("transaction_id").cast("string").alias("id"), "amount_usd")
    j = cites.join(values, "id").withColumn("n_signals", F.size("signals"))
    return top_k(j, ["entity_id"], [F.col("n_signals").desc(), F.col("amount_usd").desc(), F.col("id").desc()], k).select(
        "entity_id", F.col("id").alias("transaction_id"), "amount_usd", "n_signals", F.array_join("signals", ",").alias("signals"), "rank")


@dataclass(frozen=True)
class Assessment:
    results: DataFrame
    contributions: DataFrame
    scores: DataFrame
    categories: DataFrame
    activity: DataFrame


def entities(f: det.Frames) -> DataFrame:
    """Every customer (or account) that can be assessed: those with an account."""
    if f.grain == "account":
        return f.accounts.select(F.col("account_id").alias("entity_id"))
    return f.accounts.select(F.col("customer_id").alias("entity_id")).distinct()


def assess(f: det.Frames, names: tuple[str, ...] | None = None, extra: DataFrame | None = None) -> Assessment:
    """All rules and the score for all entities. The rule results, one small row each, are staged once."""
    parts = [lambda n=n: det.RULES[n](f) for n in names or tuple(det.RULES)]
    if extra is not None:
        parts.append(lambda: extra)
    results = stage_parts(f.txn.sparkSession, parts, "results")
    c = contributions(results)
    s = scores(c, entities(f), f.rules)
    return Assessment(results, c, s, category_breakdown(c, s), det.baseline_activity(f.legs))

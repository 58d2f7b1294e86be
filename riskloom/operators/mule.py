"""Money-mule indicators of all customers."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import FLOW_DETECTORS, UNRESOLVED, MuleRules
from riskloom.functions.numeric import ladder, money_sum, rnd, top_k
from riskloom.operators import graph as g
from riskloom.operators.detectors import Frames
from riskloom.operators.fifo import fifo_dwell
from riskloom.operators.orient import between, orient
from riskloom.operators.profile import done, is_in, is_out

INDICATORS = ("fan_in", "fan_out", "rapid_movement", "low_retention", "new_or_dormant_account", "shared_device_identity",
              "flagged_network", "layering_chain")


def onward_chains(edges: DataFrame, min_usd: float, since) -> DataFrame:
    """Accounts from which value can go on through three further accounts, every edge of at least `min_usd` and active
    after the one before it began.

    Only existence is asked, so each join partner list is cut to the few latest edges that can ever decide it: of the
    edges out of an account at most one leads back to a given account, so three last hops and eight middle hops per
    account are enough. Busy accounts therefore do not multiply.
    """
    e = g.live(edges, since).filter((F.col("total_usd") >= min_usd) & (F.col("source") != F.col("target"))).select(
        "source", "target", "first_ts", "last_ts")
    last3 = top_k(e.select(F.col("source").alias("v"), F.col("target").alias("w"), F.col("last_ts").alias("w_last")), ["v"],
                  [F.col("w_last").desc(), F.col("w")], 3).drop("rank")
    mid = (e.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("first_ts").alias("v_first"), F.col("last_ts").alias("v_last"))
           .join(last3, "v").filter("w <> u AND w_last >= v_first").groupBy("u", "v", "v_last")
           .agg(F.slice(F.array_sort(F.collect_set("w")), 1, 2).alias("ws")))
    order = [F.col("v_last").desc(), F.col("v")]
    two = top_k(mid.filter(F.size("ws") == 2), ["u"], order, 2).select("u", "v", "v_last", "ws")
    per_w = top_k(mid.filter(F.size("ws") == 1).withColumn("w", F.col("ws")[0]), ["u", "w"], order, 2)
    best = per_w.groupBy("u", "w").agg(F.max("v_last").alias("best"))
    w3 = top_k(best, ["u"], [F.col("best").desc(), F.col("w")], 3).select("u", "w")
    one = per_w.join(w3, ["u", "w"], "left_semi").select("u", "v", "v_last", "ws")
    partners = two.unionByName(one)
    first = e.select(F.col("source").alias("account_id"), F.col("target").alias("u"), "first_ts")
    ok = (F.col("v") != F.col("account_id")) & (F.col("v_last") >= F.col("first_ts")) & F.exists("ws", lambda w: w != F.col("account_id"))
    return first.join(partners, "u").filter(ok).select("account_id").distinct()


def indicators(f: Frames, contributions: DataFrame, monitoring: DataFrame, rules: MuleRules, rapid: bool = True) -> DataFrame:
    """Points of the eight indicators, one row per customer with an account."""
    end = f.period.end
    start = end - timedelta(days=rules.window_days)
    legs = orient(f.txn.filter(between("ts", start, end) & done()), f.accounts)
    inbound = legs.filter(is_in() & F.col("other_account").isNotNull())
    outbound = legs.filter(is_out())
    keys = ["entity_id"]
    money_in = inbound.groupBy(*keys).agg(money_sum(F.col("amount_usd")).alias("in_usd"), F.min("ts").alias("first_in"), F.max("ts").alias("last_in"))
    money_out = outbound.groupBy(*keys).agg(money_sum(F.col("amount_usd")).alias("out_usd"))

    def distinct(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.filter(F.col(column).isNotNull()).select(*keys, column).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    n_in = distinct(inbound, "other_account", "n_in")
    n_acc, n_ext = distinct(outbound, "other_account", "n_acc"), distinct(outbound, "external_counterparty", "n_ext")
    span = F.expr(f"INTERVAL {3 * rules.rapid_hours} HOURS")
    after = (outbound.join(money_in, "entity_id").filter((F.col("ts") >= F.col("first_in")) & (F.col("ts") <= F.col("last_in") + span))
             .groupBy(*keys).agg(money_sum(F.col("amount_usd")).alias("out_after")))
    young = (f.accounts.join(money_in.select(F.col("entity_id").alias("customer_id"), "first_in"), "customer_id")
             .filter(F.floor((F.unix_micros("first_in") - F.unix_micros("opened_at")) / 86400e6) < rules.new_account_days)
             .select(F.col("customer_id").alias("entity_id"), F.lit(True).alias("young")).distinct())
    live_points = contributions.filter("points > 0").groupBy("entity_id").agg(
        F.max(F.col("detector") == "DORMANT_REACTIVATION").alias("dormant"), F.max(F.col("detector") == "SHARED_IDENTIFIER").alias("identifier"),
        F.max(F.col("detector") == "CIRCULAR_FLOW").alias("circular"))
    device = g.usage_edges(f.txn, f.accounts)[0]
    shared = g.shared_devices(device).select(F.col("customer_id").alias("entity_id"), F.lit(True).alias("device")).distinct()
    edges = g.transfer_edges(f.txn, 0)
    open_now = monitoring.filter(F.col("status").isin(*UNRESOLVED)).select("customer_id").distinct()
    hubs = g.degrees(g.live(edges, start)).filter(F.col("degree") > g.HUB_DEGREE).select(F.col("id").alias("account_id"))
    near = g.customer_counterparties(edges, f.accounts, 2, start, hubs).select(F.col("customer_id").alias("entity_id"), "account_id")
    flagged = (near.join(f.accounts.select("account_id", "customer_id"), "account_id").filter("customer_id <> entity_id")
               .select("entity_id", "customer_id").distinct().join(open_now, "customer_id", "left_semi")
               .groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_flagged")))
    chains = (onward_chains(edges, rules.min_usd * 0.5, start).join(f.accounts.select("account_id", "customer_id"), "account_id")
              .select(F.col("customer_id").alias("entity_id"), F.lit(True).alias("chain")).distinct())
    j = f.accounts.select(F.col("customer_id").alias("entity_id")).distinct()
    parts = [money_in, money_out, n_in, n_acc, n_ext, after, young, live_points, shared, flagged, chains]
    if rapid:
        parts.append(fifo_dwell(legs, keys, rules.rapid_hours))
    for p in parts:
        j = j.join(p, "entity_id", "left")
    if not rapid:
        j = j.withColumn("matched_usd", F.lit(0.0)).withColumn("median_dwell_hours", F.lit(None).cast("double"))
    j = j.fillna(0, ["in_usd", "out_usd", "n_in", "n_acc", "n_ext", "out_after", "n_flagged", "matched_usd"]).fillna(
        False, ["young", "dormant", "identifier", "circular", "device", "chain"])
    n_out = F.col("n_acc") + F.col("n_ext")
    share = F.when(F.col("in_usd") > 0, F.col("matched_usd") / F.col("in_usd")).otherwise(0.0)
    retained = F.when(F.col("in_usd") > 0, (F.col("in_usd") - F.col("out_after")) / F.col("in_usd"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - rules.rapid_share) / max(1.0 - rules.rapid_share, 1e-9)))

    def capped(n: Column, full: float, most: float) -> Column:
        return F.least(n / full, F.lit(1.0)) * most

    points = {
        "fan_in": F.when(F.col("n_in") >= rules.fan_in_min, capped(F.col("n_in"), 2.0 * rules.fan_in_min, 20.0)),
        "fan_out": F.when(n_out >= rules.fan_out_min, capped(n_out, 2.0 * rules.fan_out_min, 15.0)),
        "rapid_movement": F.when((F.col("in_usd") >= rules.min_usd) & (share >= rules.rapid_share), (scaled * 0.5 + 0.5) * 20.0),
        "low_retention": F.when((F.col("in_usd") >= rules.min_usd) & (F.col("out_after") > 0) & (retained <= rules.retention_max), 10.0),
        "new_or_dormant_account": F.when(F.col("young") | F.col("dormant"), 10.0),
        "shared_device_identity": F.when(F.col("device"), 6.0).otherwise(0.0) + F.when(F.col("identifier"), 4.0).otherwise(0.0),
        "flagged_network": F.when(F.col("n_flagged") > 0, capped(F.col("n_flagged"), 3.0, 10.0)),
        "layering_chain": F.when(F.col("chain") | F.col("circular"), 5.0),
    }
    j = j.withColumns({k: rnd(F.coalesce(v, F.lit(0.0))) for k, v in points.items()})
    total = sum((F.col(k) for k in INDICATORS[1:]), F.col(INDICATORS[0]))
    j = j.withColumn("score", rnd(total, 1)).withColumn("band", ladder(F.col("score"), rules.bands, "NONE"))
    fired = F.array_compact(F.array(*[F.when(F.col(k) > 0, k) for k in INDICATORS]))
    kind = f.customers.select(F.col("customer_id").alias("entity_id"), "customer_type")
    busy = (F.col("customer_type") != "individual") & ((F.col("n_in") >= rules.fan_in_min) | (n_out >= rules.fan_out_min))
    context = F.array_compact(F.array(F.when(busy, "business account: many counterparties are common"),
                                      F.when((F.col("in_usd") == 0) & (F.col("out_usd") == 0), "no completed transactions in the window")))
    return j.join(kind, "entity_id", "left").select(
        "entity_id", *INDICATORS, "score", "band", fired.alias("fired"), rnd(F.col("in_usd")).alias("in_usd"), rnd(F.col("out_usd")).alias("out_usd"),
        rnd(retained, 3).alias("retained"), "median_dwell_hours", context.alias("context"))


def suspects(scored: DataFrame, monitoring: DataFrame, min_band: str = "LOW", limit: int = 25) -> DataFrame:
    """Customers with an unresolved fund-flow alert, by indicator score."""
    flow = monitoring.filter(F.col("status").isin(*UNRESOLVED) & F.col("detector_id").isin(*FLOW_DETECTORS)).select(
        F.col("customer_id").alias("entity_id")).distinct()
    at_least = ["LOW", "MEDIUM", "HIGH"][["LOW", "MEDIUM", "HIGH"].index(min_band):]
    return (scored.join(flow, "entity_id", "left_semi").filter(F.col("band").isin(*at_least))
            .orderBy(F.col("score").desc(), "entity_id").limit(limit))

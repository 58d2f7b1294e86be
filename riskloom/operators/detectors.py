"""Risk rules. Each one is a single pass over all entities and returns one row per entity that has something to judge:

    entity_id, detector, state, observed, threshold, baseline, strength, mark

`state` is fired, below_threshold or not_evaluated. `mark` is the second (or amount) from which evidence is taken.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import PHYSICAL_CHANNELS, Period, RiskRules
from riskloom.functions.geo import haversine_km
from riskloom.functions.numeric import money_sum, rnd, strength
from riskloom.operators.cycles import verified_cycles
from riskloom.operators.fifo import pass_through
from riskloom.operators.orient import device_users
from riskloom.operators.profile import (KEYS, amount_stats, counterparties, daily_stats, done, is_in, is_out,
                                        mix_counts, mix_divergence, peer_amounts)
from riskloom.operators.windows import rolling_band, rolling_max, with_previous
from riskloom.session import stage

RESULT = ["entity_id", "detector", "state", "observed", "threshold", "baseline", "strength", "mark"]


@dataclass(frozen=True)
class Frames:
    """Inputs of the rules. `legs` are the oriented rows of the baseline and the window."""
    legs: DataFrame
    txn: DataFrame
    customers: DataFrame
    accounts: DataFrame
    merchants: DataFrame
    identifiers: DataFrame
    alerts: DataFrame
    investigations: DataFrame
    period: Period
    rules: RiskRules
    grain: str = "customer"

    def owner(self) -> DataFrame:
        """(entity_id, customer_id): the customer behind every entity."""
        if self.grain == "customer":
            return self.customers.select(F.col("customer_id").alias("entity_id"), "customer_id")
        return self.accounts.select(F.col("account_id").alias("entity_id"), "customer_id")

    @cached_property
    def cycles(self) -> DataFrame:
        """Verified cycles of the window, staged: the rule and its evidence share them."""
        return stage(verified_cycles(self.txn, self.period.window_start, self.period.end, self.rules), "cycles")


def result(df: DataFrame, detector: str, observed: Column, threshold: Column, baseline: Column, fired: Column,
           ramp: float, not_evaluated: Column | None = None, score: Column | None = None,
           mark: Column | None = None) -> DataFrame:
    state = F.when(fired, "fired").otherwise("below_threshold")
    if not_evaluated is not None:
        state = F.when(not_evaluated, "not_evaluated").otherwise(state)
    s = score if score is not None else strength(observed, threshold, ramp)
    return df.select(
        "entity_id", F.lit(detector).alias("detector"), state.alias("state"), observed.cast("double").alias("observed"),
        threshold.cast("double").alias("threshold"), baseline.cast("double").alias("baseline"),
        F.when(state == "fired", s.cast("double")).alias("strength"),
        (mark if mark is not None else F.lit(None)).cast("double").alias("mark"))


def pivot(df: DataFrame, columns: dict[str, str], default: float | None = 0) -> DataFrame:
    """(entity, period) rows to one row per entity; `columns` maps a source column to a stem: base_x and win_x."""
    aggs = []
    for period in ("base", "win"):
        for source, stem in columns.items():
            v = F.max(F.when(F.col("period") == period, F.col(source)))
            aggs.append((v if default is None else F.coalesce(v, F.lit(default))).alias(f"{period}_{stem}"))
    return df.groupBy("entity_id").agg(*aggs)


def baseline_activity(legs: DataFrame) -> DataFrame:
    """Outbound rows in the baseline, and rows in the window, per entity."""
    return legs.groupBy("entity_id").agg(
        F.count(F.when(is_out() & (F.col("period") == "base"), 1)).alias("n_base_out"),
        F.count(F.when((is_out() | is_in()) & (F.col("period") == "win"), 1)).alias("n_win"))


def burst(f: Frames) -> DataFrame:
    r = f.rules
    m = rolling_max(f.legs.filter(is_out()), KEYS, r.burst_minutes * 60)
    p = pivot(m, {"max_count": "n", "start_sec": "at"}).filter("win_n > 0")
    thr = F.greatest(F.lit(float(r.burst_min)), F.col("base_n") * r.burst_multiplier)
    return result(p, "TRANSACTION_BURST", F.col("win_n"), thr, F.col("base_n"), F.col("win_n") >= thr, r.ramp,
                  mark=F.col("win_at"))


def velocity(f: Frames) -> DataFrame:
    r = f.rules
    p = pivot(daily_stats(f.legs.filter(is_out()), f.period), {"daily_mean": "mean", "daily_std": "std", "daily_max": "max"})
    thr = F.greatest(F.lit(float(r.velocity_min)), F.col("base_mean") + r.velocity_std * F.col("base_std"))
    return result(p.filter("win_max > 0"), "VELOCITY_SPIKE", F.col("win_max"), thr, F.col("base_mean"),
                  F.col("win_max") >= thr, r.ramp)


def largest_completed(legs: DataFrame) -> DataFrame:
    return (legs.filter(is_out() & done() & (F.col("period") == "win")).groupBy("entity_id")
            .agg(F.max("amount_usd").alias("largest")))


def amount(f: Frames) -> DataFrame:
    r = f.rules
    base = amount_stats(f.legs.filter(is_out() & done() & (F.col("period") == "base")), ["entity_id"])
    j = largest_completed(f.legs).join(base.select("entity_id", "n", "median", "mad_sigma", "p99"), "entity_id", "left")
    thin = F.coalesce(F.col("n"), F.lit(0)) < r.amount_min_baseline
    thr = F.when(thin, F.lit(0.0)).otherwise(F.greatest(
        F.lit(float(r.amount_min_usd)), F.col("median") + r.amount_mad * F.col("mad_sigma"), F.col("p99") * r.amount_p99))
    return result(j, "AMOUNT_DEVIATION", F.col("largest"), thr, F.when(~thin, F.col("median")), F.col("largest") >= thr,
                  r.ramp, not_evaluated=thin, mark=thr)


def peer_amount(f: Frames) -> DataFrame:
    r = f.rules
    peers = peer_amounts(f.txn, f.accounts, f.customers, f.period.baseline_start, f.period.window_start)
    seg = f.owner().join(f.customers.select("customer_id", "segment"), "customer_id")
    # one row per segment: a fixed small vocabulary
    j = largest_completed(f.legs).join(seg, "entity_id").join(peers.select("segment", "p99_usd"), "segment")
    thr = F.col("p99_usd") * r.peer_p99
    return result(j, "PEER_AMOUNT_DEVIATION", F.col("largest"), thr, F.col("p99_usd"), F.col("largest") >= thr, r.ramp,
                  mark=thr)


def rapid_pass_through(f: Frames) -> DataFrame:
    r = f.rules
    m = pass_through(f.legs, KEYS, r.pass_hours, r.pass_types, pairs=0)
    p = pivot(m, {"ratio": "ratio", "inbound_usd": "usd", "n_inbound": "n"}).filter("win_n > 0")
    fired = (F.col("win_usd") >= r.pass_min_usd) & (F.col("win_n") >= r.pass_min_count) & (F.col("win_ratio") >= r.pass_min_ratio)
    return result(p, "RAPID_PASS_THROUGH", F.col("win_ratio"), F.lit(float(r.pass_min_ratio)), F.col("base_ratio"), fired,
                  r.pass_ramp)


def _fan(f: Frames, detector: str, direction: str, types: tuple[str, ...], minimum: float, multiplier: float) -> DataFrame:
    n = counterparties(f.legs, direction, types).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    p = pivot(n, {"n": "n"}).filter("win_n > 0")
    base_days = float(max(f.period.baseline_days, 1))
    rate = rnd(F.col("base_n") * 30.0 / base_days) * float(max(f.period.lookback_days, 1)) / 30
    thr = F.greatest(F.lit(float(minimum)), rate * multiplier)
    return result(p, detector, F.col("win_n"), thr, rate, F.col("win_n") >= thr, f.rules.ramp)


def fan_in(f: Frames) -> DataFrame:
    return _fan(f, "FAN_IN", "in", (), f.rules.fan_in_min, f.rules.fan_in_multiplier)


def fan_out(f: Frames) -> DataFrame:
    return _fan(f, "FAN_OUT", "out", f.rules.fan_out_types, f.rules.fan_out_min, f.rules.fan_out_multiplier)


def band_rows(f: Frames) -> DataFrame:
    """Completed rows just below the reporting threshold: outbound ones and inbound ones without a sender."""
    r = f.rules
    side = is_out() | (is_in() & F.col("other_account").isNull())
    return f.legs.filter(side & done() & F.col("transaction_type").isin(*r.band_types)
                         & (F.col("amount_usd") >= r.band_usd * r.band_lower) & (F.col("amount_usd") < r.band_usd))


def structuring(f: Frames) -> DataFrame:
    r = f.rules
    m = rolling_band(band_rows(f), KEYS, r.band_hours * 3600, "amount_usd")
    p = pivot(m, {"max_count": "n", "total_usd": "usd", "start_sec": "at"}).filter("win_n > 0")
    thr = F.greatest(F.lit(float(r.band_min)), F.col("base_n") * r.band_multiplier)
    fired = (F.col("win_n") >= thr) & (F.col("win_usd") >= r.band_usd * r.band_total)
    return result(p, "STRUCTURING", F.col("win_n"), thr, F.col("base_n"), fired, r.ramp, mark=F.col("win_at"))


def new_country_rows(f: Frames) -> DataFrame:
    """Window rows whose country is neither the home country nor one seen in the baseline."""
    seen = (f.legs.filter((is_out() | is_in()) & (F.col("period") == "base") & F.col("country").isNotNull())
            .select("entity_id", "country").distinct())
    home = f.owner().join(f.customers.select("customer_id", "country"), "customer_id").select("entity_id", "country")
    known = seen.unionByName(home).distinct()
    return (f.legs.filter((F.col("period") == "win") & F.col("country").isNotNull())
            .join(known, ["entity_id", "country"], "left_anti"))


def new_country(f: Frames) -> DataFrame:
    r = f.rules
    new = new_country_rows(f).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("country").isin(*r.high_risk_countries) if r.high_risk_countries
                                            else F.lit(False)).alias("high_risk"))
    j = baseline_activity(f.legs).filter("n_win > 0 OR n_base_out > 0").join(new, "entity_id", "left").fillna(0, ["n"])
    thr = F.lit(float(r.country_min))
    s = strength(F.col("n"), thr, r.ramp * 2)
    s = F.when(F.coalesce(F.col("high_risk"), F.lit(False)), F.greatest(s, F.lit(0.9))).otherwise(s)
    return result(j, "GEO_NEW_COUNTRY", F.col("n"), thr, F.lit(None), F.col("n") >= thr, r.ramp,
                  not_evaluated=F.col("n_base_out") == 0, score=s)


def travel_pairs(rows: DataFrame, keys: list[str], rules: RiskRules, physical_only: bool = True) -> DataFrame:
    """Consecutive located rows with the distance, hours (at least one minute) and speed between them."""
    geo = rows.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if physical_only:
        geo = geo.filter(F.col("channel").isin(*PHYSICAL_CHANNELS))
    geo = geo.select(*keys, "transaction_id", "ts", "sec", "latitude", "longitude")
    p = with_previous(geo, keys, ["ts", "transaction_id"], ["transaction_id", "sec", "latitude", "longitude"],
                      F.floor(F.col("sec") / 86400))
    km = haversine_km(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"))
    hours = F.greatest((F.col("sec") - F.col("prev_sec")) / 3600.0, F.lit(1 / 60))
    out = (p.filter("prev_transaction_id IS NOT NULL").withColumn("km", km).withColumn("hours", hours)
           .withColumn("kmh", F.col("km") / F.col("hours")))
    return out.filter((F.col("kmh") > rules.travel_kmh) & (F.col("km") >= rules.travel_km))


def impossible_travel(f: Frames) -> DataFrame:
    r = f.rules
    win = f.legs.filter(is_out() & (F.col("period") == "win"))
    v = travel_pairs(win, ["entity_id"], r).groupBy("entity_id").agg(rnd(F.max("kmh"), 0).alias("kmh"), F.count(F.lit(1)).alias("n"))
    thr = F.lit(float(r.travel_kmh))
    return result(v, "IMPOSSIBLE_TRAVEL", F.col("kmh"), thr, F.lit(None), F.col("n") > 0, r.ramp)


def device_use(f: Frames) -> DataFrame:
    """Per (entity, device): first use in the baseline or not, window rows and completed window value."""
    rows = f.legs.filter(is_out() & F.col("device_id").isNotNull())
    win = F.col("period") == "win"
    return rows.groupBy("entity_id", "device_id").agg(
        F.count(F.when(~win, 1)).alias("n_base"), F.count(F.when(win, 1)).alias("n_win"),
        F.coalesce(F.sum(F.when(win & done(), F.col("amount_usd").cast("decimal(18,2)"))), F.lit(0).cast("decimal(18,2)")).alias("usd"))


def new_device(f: Frames) -> DataFrame:
    r = f.rules
    new = F.col("n_base") == 0
    a = device_use(f).groupBy("entity_id").agg(
        F.sum("n_win").alias("n_win"), F.sum(F.when(new, F.col("n_win")).otherwise(0)).alias("n_new"),
        F.sum(F.when(new, F.col("usd"))).cast("double").alias("new_usd"), F.sum("usd").cast("double").alias("usd"),
        F.count(F.when(~new, 1)).alias("base_devices")).filter("n_win > 0")
    share = F.when(F.col("usd") > 0, F.coalesce(F.col("new_usd"), F.lit(0.0)) / F.col("usd")).otherwise(F.lit(0.0))
    thr = F.lit(float(r.device_share))
    fired = (F.col("n_new") > 0) & ((share >= thr) | (F.col("n_new") >= r.device_min))
    return result(a, "NEW_DEVICE", rnd(share, 4), thr, F.col("base_devices"), fired, r.ramp,
                  score=strength(F.greatest(share, thr), thr, r.ramp))


def device_sharing(f: Frames) -> DataFrame:
    """Most customers on any device the entity used; one count per device is joined back, never pairs of users."""
    r = f.rules
    start = f.period.end - timedelta(days=r.sharing_days)
    per_device = device_users(f.txn, f.accounts, start, f.period.end).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("customers"))
    mine = (f.legs.filter(is_out() & (F.col("period") == "win") & F.col("device_id").isNotNull())
            .select("entity_id", "device_id").distinct())
    m = mine.join(per_device, "device_id").groupBy("entity_id").agg(F.max("customers").alias("n"))
    thr = F.lit(float(r.sharing_customers))
    return result(m, "DEVICE_SHARING", F.col("n"), thr, F.lit(None), F.col("n") >= thr, r.ramp)


def identifier_groups(identifiers: DataFrame) -> DataFrame:
    """Customers per identifier, joined back to each of them: counts only, no pairs."""
    keys = ["identifier_type", "value_hash"]
    one = identifiers.select("customer_id", *keys).distinct()
    sizes = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("customers")).filter("customers > 1")
    return one.join(sizes, keys)


def shared_identifier(f: Frames) -> DataFrame:
    r = f.rules
    g = identifier_groups(f.identifiers).groupBy("customer_id").agg(
        F.max("customers").alias("n"),
        F.max((F.col("customers") >= r.identifier_customers) | F.col("identifier_type").isin(*r.identifier_always)).alias("hit"))
    m = f.owner().join(g, "customer_id")
    thr = F.lit(float(r.identifier_customers))
    return result(m, "SHARED_IDENTIFIER", F.col("n"), thr, F.lit(None), F.col("hit"), r.ramp,
                  score=strength(F.greatest(F.col("n").cast("double"), thr), thr, r.ramp))


def circular(f: Frames) -> DataFrame:
    r = f.rules
    c = f.cycles
    if f.grain == "customer":
        own = f.accounts.select(F.col("customer_id").alias("entity_id"), "account_id")
    else:
        own = f.accounts.select(F.col("account_id").alias("entity_id"), "account_id")
    members = c.select("cycle", "start_usd", F.explode("cycle").alias("account_id"))
    m = members.join(own, "account_id").groupBy("entity_id").agg(
        F.max("start_usd").alias("usd"), F.count_distinct(F.col("cycle")).alias("n"))
    thr = F.lit(float(r.cycle_min_usd))
    return result(m, "CIRCULAR_FLOW", rnd(F.col("usd")), thr, F.lit(None), F.col("usd") >= thr, r.ramp)


def account_rows(txn: DataFrame, *extra: str) -> DataFrame:
    """Transactions once for each of their accounts."""
    sides = F.array_distinct(F.filter(F.array("sender_account_id", "receiver_account_id"), lambda x: x.isNotNull()))
    return txn.select(F.explode(sides).alias("account_id"), "ts", "amount_usd", "status", *extra)


def dormant_accounts(f: Frames) -> DataFrame:
    """(entity_id, account_id, gap, usd, hit) of accounts active in the window, silent in the baseline and open before it; the
    gap is measured from the last earlier transaction or the opening date. One aggregation over (time, amount) of the whole history."""
    r = f.rules
    p = f.period
    rows = account_rows(f.txn.filter(F.col("ts") <= F.lit(p.end)))
    win = F.col("ts") >= F.lit(p.window_start)
    base = (F.col("ts") >= F.lit(p.baseline_start)) & ~win
    older = F.col("ts") <= F.lit(p.baseline_start)
    a = rows.groupBy("account_id").agg(
        F.min(F.when(win, F.col("ts"))).alias("first_win"), F.count(F.when(base, 1)).alias("n_base"),
        F.max(F.when(older, F.col("ts"))).alias("last_old"),
        F.coalesce(money_sum(F.when(win & done(), F.col("amount_usd"))), F.lit(0.0)).alias("usd")
    ).filter("first_win IS NOT NULL AND n_base = 0")
    j = a.join(f.accounts.select("account_id", "customer_id", "opened_at"), "account_id").filter(
        F.col("opened_at") <= F.lit(p.baseline_start))
    entity = "customer_id" if f.grain == "customer" else "account_id"
    last = F.coalesce(F.col("last_old"), F.col("opened_at"))
    gap = (F.unix_micros("first_win") - F.unix_micros(last)) / 86400e6
    hit = (gap >= r.dormant_days) & (F.col("usd") >= r.dormant_usd)
    return j.withColumn("gap", gap).select(F.col(entity).alias("entity_id"), "account_id", "gap", "usd", hit.alias("hit"))


def dormant(f: Frames) -> DataFrame:
    r = f.rules
    g = (dormant_accounts(f).groupBy("entity_id").agg(
        F.max("gap").alias("best"), F.max(F.when(F.col("hit"), F.struct("usd", "gap", "account_id"))).alias("h")))
    obs = F.when(F.col("h").isNotNull(), rnd(F.col("h.gap"), 1)).otherwise(F.col("best"))
    return result(g, "DORMANT_REACTIVATION", obs, F.lit(float(r.dormant_days)), F.lit(None), F.col("h").isNotNull(), r.ramp)


def high_risk_payments(f: Frames) -> DataFrame:
    """Completed outbound rows to merchants rated high."""
    risky = f.merchants.filter("risk_profile = 'high'").select("merchant_id")
    return f.legs.filter(is_out() & done() & F.col("merchant_id").isNotNull()).join(risky, "merchant_id", "left_semi")


def high_risk_merchant(f: Frames) -> DataFrame:
    r = f.rules
    p = pivot(high_risk_payments(f).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), money_sum(F.col("amount_usd")).alias("usd")),
              {"n": "n", "usd": "usd"}).filter("win_n > 0")
    rate = F.col("base_usd") * float(max(f.period.lookback_days, 1)) / float(max(f.period.baseline_days, 1))
    thr = F.greatest(F.lit(float(r.merchant_usd)), rate * r.merchant_multiplier)
    fired = (F.col("win_n") >= r.merchant_min) & (F.col("win_usd") >= thr)
    return result(p, "HIGH_RISK_MERCHANT", F.col("win_usd"), thr, rate, fired, r.ramp)


def behavioural_shift(f: Frames) -> DataFrame:
    r = f.rules
    d = mix_divergence(mix_counts(f.legs, ["transaction_type", "channel"])).filter(F.col("n_win") >= r.shift_min)
    thr = F.lit(float(r.shift_jsd))
    return result(d, "BEHAVIOURAL_SHIFT", rnd(F.col("jsd"), 4), thr, F.lit(None), F.col("jsd") >= thr, r.ramp,
                  score=strength(F.col("jsd"), thr, r.ramp))


def flagged_customers(alerts: DataFrame, investigations: DataFrame) -> DataFrame:
    """Customers with an open alert or a confirmed case."""
    opened = alerts.filter("status = 'open' AND entity_type = 'customer'").select(F.col("entity_id").alias("customer_id"))
    confirmed = investigations.filter("conclusion = 'confirmed_suspicious'").select(F.col("subject_id").alias("customer_id"))
    return opened.union(confirmed).distinct()


def exposure_pairs(f: Frames) -> DataFrame:
    """Distinct (entity, other owner) over completed window transfers between two known accounts."""
    rows = f.legs.filter((is_out() | is_in()) & done() & (F.col("period") == "win") & F.col("other_account").isNotNull())
    pairs = rows.select("entity_id", "other_account").distinct().join(
        f.accounts.select(F.col("account_id").alias("other_account"), F.col("customer_id").alias("other")), "other_account")
    return pairs.join(f.owner(), "entity_id").filter("other <> customer_id").select("entity_id", "other").distinct()


def network_exposure(f: Frames) -> DataFrame:
    r = f.rules
    flags = flagged_customers(f.alerts, f.investigations).withColumn("flag", F.lit(1))
    m = exposure_pairs(f).join(flags, F.col("other") == F.col("customer_id"), "left").groupBy("entity_id").agg(
        F.count("flag").alias("n"), F.count(F.lit(1)).alias("owners"))
    thr = F.lit(float(r.exposure_min))
    return result(m, "NETWORK_EXPOSURE", F.col("n"), thr, F.col("owners"), F.col("n") >= thr, r.ramp * 2)


def historical_alerts(f: Frames) -> DataFrame:
    r = f.rules
    h = (f.alerts.filter(F.col("created_at") < F.lit(f.period.window_start)).groupBy(F.col("entity_id").alias("customer_id"))
         .agg(F.count(F.lit(1)).alias("n")))
    m = f.owner().join(h, "customer_id")
    return result(m, "HISTORICAL_ALERTS", F.col("n"), F.lit(1.0), F.lit(None), F.col("n") > 0, r.ramp,
                  score=rnd(F.least(F.lit(1.0), F.col("n") / float(r.history_full)), 4))


RULES = {
    "TRANSACTION_BURST": burst, "VELOCITY_SPIKE": velocity, "AMOUNT_DEVIATION": amount,
    "PEER_AMOUNT_DEVIATION": peer_amount, "RAPID_PASS_THROUGH": rapid_pass_through, "FAN_IN": fan_in, "FAN_OUT": fan_out,
    "STRUCTURING": structuring, "GEO_NEW_COUNTRY": new_country, "IMPOSSIBLE_TRAVEL": impossible_travel,
    "NEW_DEVICE": new_device, "DEVICE_SHARING": device_sharing, "SHARED_IDENTIFIER": shared_identifier,
    "CIRCULAR_FLOW": circular, "DORMANT_REACTIVATION": dormant, "HIGH_RISK_MERCHANT": high_risk_merchant,
    "BEHAVIOURAL_SHIFT": behavioural_shift, "NETWORK_EXPOSURE": network_exposure, "HISTORICAL_ALERTS": historical_alerts,
}


def all_results(f: Frames, names: tuple[str, ...] | None = None) -> DataFrame:
    """Union of the rules' rows."""
    out = None
    for name in names or tuple(RULES):
        part = RULES[name](f)
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------------------- transaction-level anomalies
def amount_outliers(f: Frames, z_threshold: float) -> DataFrame:
    """Window rows whose amount is far from the entity's baseline median, in robust standard deviations."""
    from riskloom.operators.quantiles import deviations, exact_quantiles, value_counts
    keys = ["entity_id"]
    counts = value_counts(f.legs.filter(is_out() & done() & (F.col("period") == "base")), keys, "amount_usd")
    med = exact_quantiles(counts, keys, {"median": 0.5}).filter("total >= 5")
    mad = exact_quantiles(deviations(counts, keys, med), keys, {"mad": 0.5}).select("entity_id", "mad")
    sigma = F.when(F.col("mad") * 1.4826 > 0, F.col("mad") * 1.4826).otherwise(F.greatest(F.col("median") * 0.1, F.lit(1.0)))
    win = f.legs.filter(is_out() & done() & (F.col("period") == "win"))
    j = win.join(med.join(mad, "entity_id"), "entity_id").withColumn("z", (F.col("amount_usd") - F.col("median")) / sigma)
    return j.filter(F.col("z") >= z_threshold).select("entity_id", "transaction_id", "amount_usd",
                                                     rnd(F.col("median")).alias("reference"), rnd(F.col("z"), 4).alias("z"))


def distance_outliers(f: Frames, min_km: float = 300.0, quantile: float = 0.99, factor: float = 1.5) -> DataFrame:
    """Window rows farther from home than the entity's own baseline distances."""
    from riskloom.operators.quantiles import exact_quantiles, value_counts
    homes = f.owner().join(f.customers.select("customer_id", "home_latitude", "home_longitude"), "customer_id")
    geo = f.legs.filter(is_out() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).join(homes, "entity_id")
    d = geo.withColumn("km", haversine_km(F.col("home_latitude"), F.col("home_longitude"), F.col("latitude"), F.col("longitude")))
    base = exact_quantiles(value_counts(d.filter("period = 'base'"), ["entity_id"], "km"), ["entity_id"], {"q": quantile})
    limit = F.when(F.col("total") >= 10, F.greatest(F.lit(min_km), F.col("q") * factor)).otherwise(F.lit(min_km))
    return (d.filter("period = 'win'").join(base, "entity_id", "left").withColumn("limit_km", limit)
            .withColumn("distance_km", rnd(F.col("km"), 1)).filter("distance_km > limit_km")
            .select("entity_id", "transaction_id", "distance_km", rnd(F.col("limit_km"), 3).alias("limit_km")))


def near_location(txn: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Located rows within a radius; a latitude band, which the scan can use, comes before the exact distance."""
    degrees = radius_km / 111.0
    rows = txn.filter((F.col("latitude") >= lat - degrees) & (F.col("latitude") <= lat + degrees) & F.col("longitude").isNotNull())
    d = haversine_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    return rows.withColumn("distance_km", d).filter(F.col("distance_km") <= radius_km).orderBy("distance_km", "transaction_id")

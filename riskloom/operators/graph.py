"""Transfer-graph questions as joins over aggregated edges. Every operator answers for all seeds at once."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.numeric import join_optional, money_sum, top_k
from riskloom.operators.cycles import rotate_to_smallest, verified_cycles
from riskloom.session import stage

HUB_DEGREE = 60


# ------------------------------------------------------------------------------------------------------------- edges
def transfer_edges(txn: DataFrame, samples: int = 5) -> DataFrame:
    """One edge per (sender, receiver): count, value, first and last time, first `samples` transaction ids by time."""
    keys = ["source", "target"]
    t = txn.filter((F.col("status") == "completed") & F.col("sender_account_id").isNotNull() & F.col("receiver_account_id").isNotNull()
                   ).select(F.col("sender_account_id").alias("source"), F.col("receiver_account_id").alias("target"), "ts",
                            "transaction_id", "amount_usd")
    sums = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), money_sum(F.col("amount_usd")).alias("total_usd"),
                                F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    if not samples:
        return sums
    first = top_k(t, keys, [F.col("ts"), F.col("transaction_id")], samples)
    ids = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "transaction_id"))).alias("x")).select(
        *keys, F.transform("x", lambda v: v["transaction_id"]).alias("sample_txn_ids"))
    return sums.join(ids, keys)


def live(edges: DataFrame, since: datetime | None) -> DataFrame:
    return edges if since is None else edges.filter(F.col("last_ts") >= F.lit(since))


def usage_edges(txn: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Device use and IP use per customer, merchant payments per account; completed rows only.

    Rows are summed per account before the owner is joined on.
    """
    done = txn.filter((F.col("status") == "completed") & F.col("sender_account_id").isNotNull()).withColumnRenamed("sender_account_id", "account_id")
    own = accounts.select("account_id", "customer_id")

    def per_owner(column: str) -> DataFrame:
        rows = done.filter(F.col(column).isNotNull() & F.col("device_id").isNotNull())
        part = rows.groupBy("account_id", column).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        return part.join(own, "account_id").groupBy("customer_id", column).agg(
            F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

    merchants = done.filter("merchant_id IS NOT NULL").groupBy("account_id", "merchant_id").agg(
        F.count(F.lit(1)).alias("n"), money_sum(F.col("amount_usd")).alias("total_usd"))
    return per_owner("device_id"), per_owner("ip_address"), merchants


def node(kind: str, c: Column) -> Column:
    return F.concat(F.lit(kind + ":"), c.cast("string"))


def projection(txn: DataFrame, customers: DataFrame, accounts: DataFrame, merchants: DataFrame, identifiers: DataFrame,
               alerts: DataFrame, staged: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, open_alert) and typed edges (source, target, rel, n) of the whole bank; edges are staged for more than one reader."""
    device, ip, paid = usage_edges(txn, accounts)
    tr = transfer_edges(txn, samples=0)
    one = F.lit(1).cast("long").alias("n")
    edges = (accounts.select(node("customer", F.col("customer_id")).alias("source"), node("account", F.col("account_id")).alias("target"),
                             F.lit("OWNS").alias("rel"), one)
             .unionByName(tr.select(node("account", F.col("source")).alias("source"), node("account", F.col("target")).alias("target"),
                                    F.lit("TRANSFERRED_TO").alias("rel"), "n"))
             .unionByName(device.select(node("customer", F.col("customer_id")).alias("source"), node("device", F.col("device_id")).alias("target"),
                                        F.lit("USES_DEVICE").alias("rel"), "n"))
             .unionByName(ip.select(node("customer", F.col("customer_id")).alias("source"), node("ip", F.col("ip_address")).alias("target"),
                                    F.lit("USES_IP").alias("rel"), "n"))
             .unionByName(paid.select(node("account", F.col("account_id")).alias("source"), node("merchant", F.col("merchant_id")).alias("target"),
                                      F.lit("PAID").alias("rel"), "n"))
             .unionByName(identifiers.select(
                 node("customer", F.col("customer_id")).alias("source"),
                 F.concat(F.col("identifier_type"), F.lit(":"), F.substring("value_hash", 1, 16)).alias("target"),
                 F.lit("HAS_IDENTIFIER").alias("rel"), one).distinct()))
    edges = stage(edges, "projection-edges") if staged else edges
    flagged = open_alert_customers(alerts).select(node("customer", F.col("customer_id")).alias("id"), F.lit(True).alias("open_alert"))
    ids = (edges.select(F.col("source").alias("id")).union(edges.select("target"))
           .union(customers.select(node("customer", F.col("customer_id")))).union(merchants.select(node("merchant", F.col("merchant_id")))).distinct())
    nodes = ids.withColumn("kind", F.substring_index("id", ":", 1)).join(flagged, "id", "left").withColumn(
        "open_alert", F.coalesce("open_alert", F.lit(False)))
    return nodes, edges


def open_alert_customers(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'open' AND entity_type = 'customer'").select(F.col("entity_id").alias("customer_id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Incident edges per node."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "name", "n")
    e = edges.groupBy(F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge"), "name", "n")
    return n.union(e)


def relation_degrees(edges: DataFrame) -> DataFrame:
    """Incident edges of every node by relation (a self-transfer counts once)."""
    ends = F.array_distinct(F.array("source", "target"))
    return edges.select(F.explode(ends).alias("id"), "rel").groupBy("id", "rel").agg(F.count(F.lit(1)).alias("degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, next) for either direction, distinct."""
    pairs = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("next")),
                                           F.struct(F.col("target").alias("id"), F.col("source").alias("next")))).alias("p"))
    return pairs.select("p.id", "p.next").filter("id <> next").distinct()


# ------------------------------------------------------------------------------------------------------- neighbourhoods
def weighed_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct undirected edges (x, y), x < y, with the kind and the incident edges of either end, staged: every level of a search reads them."""
    facts = degrees(edges).join(nodes.select("id", "kind"), "id", "left")
    of = lambda c: facts.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind"), F.col("degree").alias(f"{c}_degree"))
    pairs = edges.select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).filter("x <> y").distinct()
    return stage(pairs.join(of("x"), "x").join(of("y"), "y"), "weighed-pairs")


def related(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = 150,
            kinds: tuple[str, ...] | None = None, hub_kinds: tuple[str, ...] = ("merchant", "ip"), spare_customers: bool = True,
            pairs: DataFrame | None = None) -> DataFrame:
    """Undirected breadth-first neighbourhood (seed, id, hops) of every seed; hubs are reached but not expanded.

    One join per level against the adjacency without hubs. With `limit`, the nearest nodes in (hops, id) order are kept
    and `truncated` says whether more were reached. `pairs` are the `weighed_pairs` of the graph, if they are at hand.
    """
    pairs = weighed_pairs(nodes, edges) if pairs is None else pairs
    busy = F.col("id_degree") > HUB_DEGREE
    hub = F.col("id_kind").isin(*hub_kinds) | (busy & (F.col("id_kind") != "customer") if spare_customers else busy)
    end = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("next"), F.col(f"{a}_kind").alias("id_kind"),
                                F.col(f"{a}_degree").alias("id_degree"), F.col(f"{b}_kind").alias("next_kind"))
    adj = pairs.select(F.explode(F.array(end("x", "y"), end("y", "x"))).alias("e")).select("e.*")
    if kinds is not None:
        adj = adj.filter(F.col("next_kind").isin(*kinds))
    open_adj = stage(adj.filter(F.col("id_kind").isNull() | ~hub).select("id", "next"), "open-adjacency")
    seen = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops"))
    frontier = seen
    for d in range(1, depth + 1):
        reach = (frontier.join(adj.select("id", "next") if d == 1 else open_adj, "id").select("seed", F.col("next").alias("id")).distinct()
                 .join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(d)))
        frontier = stage(reach.select("seed", "id", "hops"), f"frontier{d}")
        seen = seen.unionByName(frontier)
    if limit is None:
        return seen.withColumn("truncated", F.lit(False))
    size = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("reached"))
    return (top_k(seen, ["seed"], [F.col("hops"), F.col("id")], limit).drop("rank").join(size, "seed")
            .withColumn("truncated", F.col("reached") > limit).drop("reached"))


def shared_devices(device_use: DataFrame, min_customers: int = 2) -> DataFrame:
    """(customer, device, customers on it) where enough customers share the device: counts, no pairs."""
    size = device_use.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_customers")).filter(F.col("n_customers") >= min_customers)
    return device_use.select("customer_id", "device_id").join(size, "device_id")


#: Neighbours held in one row, and first steps that are tried before all others.
LISTED, FIRST_STEPS = 512, 8


def neighbour_lists(steps: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, `name`): the neighbours of every account in order, at most `LISTED` in a row, so that an account with many has many rows."""
    place = F.row_number().over(W.partitionBy(key).orderBy(value))
    return (steps.select(key, value).withColumn("piece", F.floor((place - 1) / LISTED)).groupBy(key, "piece")
            .agg(F.array_sort(F.collect_list(value)).alias(name)).drop("piece"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """Fewest directed transfers from source to target, with the smallest such path, for all pairs at once.

    A pair is open until it is met. For an open pair any walk of the next length is a shortest path, so no account needs to be remembered as seen, and
    no level is built per account: two hops are looked up among the edges from the end with fewer neighbours; three hops meet where the list of a
    neighbour's neighbours holds one of the accounts that pay the target; longer walks make a first step, smallest first, and ask the same of the rest.
    Most pairs are met by one of their first steps, and the others are asked only then.
    """
    steps = stage(edges.select(F.col("source").alias("at"), F.col("target").alias("next")).filter("at <> next").distinct(), "transfer-steps")
    place = F.row_number().over(W.partitionBy("at").orderBy("next"))
    n_out = steps.groupBy(F.col("at").alias("source")).agg(F.count(F.lit(1)).alias("n_out"))
    n_in = steps.groupBy(F.col("next").alias("target")).agg(F.count(F.lit(1)).alias("n_in"))
    payers = stage(neighbour_lists(steps, "next", "at", "payers").withColumnRenamed("next", "target"), "payers")
    ranked = beyond = None
    if max_hops > 2:
        lists = neighbour_lists(steps, "at", "next", "paid").withColumnRenamed("at", "via")
        beyond = stage(steps.select(F.col("at").alias("source"), F.col("next").alias("via")).join(lists, "via").select("source", "via", "paid"), "steps-beyond")
    if max_hops > 3:
        ranked = stage(steps.select(F.col("at").alias("source"), F.col("next").alias("first"), place.alias("place")), "first-steps")

    def one(open_: DataFrame) -> DataFrame:
        return open_.join(steps.select(F.col("at").alias("source"), F.col("next").alias("target")), ["source", "target"], "left_semi").select(
            "source", "target", F.array("source", "target").alias("path"))

    def two(open_: DataFrame) -> DataFrame:
        sized = open_.join(n_out, "source").join(n_in, "target")
        ahead = sized.filter("n_out <= n_in").join(steps, F.col("source") == F.col("at")).select("source", "target", F.col("next").alias("via"), F.col("next").alias("a"), F.col("target").alias("b"))
        behind = sized.filter("n_out > n_in").join(steps, F.col("target") == F.col("next")).select("source", "target", F.col("at").alias("via"), F.col("source").alias("a"), F.col("at").alias("b"))
        return (ahead.unionByName(behind).join(steps, (F.col("a") == F.col("at")) & (F.col("b") == F.col("next")), "left_semi")
                .groupBy("source", "target").agg(F.min("via").alias("via")).select("source", "target", F.array("source", "via", "target").alias("path")))

    def three(open_: DataFrame) -> DataFrame:
        last = F.array_min(F.array_intersect("paid", "payers"))
        return (open_.join(payers, "target").join(beyond, "source").select("source", "target", "via", last.alias("last")).filter("last IS NOT NULL")
                .groupBy("source", "target").agg(F.min(F.struct("via", "last")).alias("m")).select("source", "target", F.array("source", "m.via", "m.last", "target").alias("path")))

    def walks(open_: DataFrame, hops: int) -> DataFrame:
        """The smallest walk of `hops` steps of every pair that has one; no pair has a shorter one."""
        if hops <= 3:
            return stage((one, two, three)[hops - 1](open_), f"walks{hops}")
        met, rest = None, open_
        for which in (F.col("place") <= FIRST_STEPS, F.col("place") > FIRST_STEPS):
            tried = rest.join(ranked.filter(which), "source").select("source", "target", "first")
            further = walks(stage(tried.select(F.col("first").alias("source"), "target").distinct(), f"tried{hops}"), hops - 1)
            ways = tried.join(further.select(F.col("source").alias("first"), "target", "path"), ["first", "target"])
            part = stage(ways.groupBy("source", "target").agg(F.min("path").alias("path")).select("source", "target", F.array_prepend("path", F.col("source")).alias("path")), f"walks{hops}")
            met = part if met is None else met.unionByName(part)
            rest = stage(rest.join(part, ["source", "target"], "left_anti"), f"rest{hops}")
            if rest.isEmpty():
                break
        return met

    ends = pairs.filter("source <> target").select("source", "target").distinct()
    # without a step out of the one and into the other there is no path
    open_ = stage(ends.join(n_out, "source", "left_semi").join(n_in, "target", "left_semi").select("source", "target"), "open-pairs")
    found = None
    for hops in range(1, max_hops + 1):
        met = walks(open_, hops).select("source", "target", "path", F.lit(hops).alias("hops"))
        found = met if found is None else found.unionByName(met)
        if hops == max_hops:
            break
        open_ = stage(open_.join(met, ["source", "target"], "left_anti"), "open-pairs")
        if open_.isEmpty():
            break
    return found


def connected_accounts(edges: DataFrame, accounts: DataFrame, device_use: DataFrame, seeds: DataFrame, max_hops: int = 2,
                       limit: int = 100) -> DataFrame:
    """Accounts of the same owner (0), of customers on a shared device (1), or within `max_hops` transfers."""
    own = accounts.select("account_id", "customer_id").distinct()
    s = seeds.select(F.col("account_id").alias("seed")).distinct().join(own, F.col("seed") == F.col("account_id")).select("seed", F.col("customer_id").alias("owner"))
    # the result keeps `limit` accounts by (hops, id), so the first `limit` + 1 accounts of an owner or a device are enough:
    # those of the seed's own owner among them take places of their own at distance 0
    by_owner = top_k(own, ["customer_id"], [F.col("account_id")], limit + 1).drop("rank")
    columns = ("seed", "account_id", "hops", "via", "priority", "device_id")
    dev = stage(device_use.select("customer_id", "device_id").distinct(), "device-owners")
    no_device = F.lit(None).cast(dict(dev.dtypes)["device_id"]).alias("device_id")
    same = s.join(by_owner, s.owner == by_owner.customer_id).filter("account_id <> seed").select(
        "seed", "account_id", F.lit(0).alias("hops"), F.lit("same_owner").alias("via"), F.lit(0).alias("priority"), no_device)
    by_device = stage(top_k(dev.join(by_owner, "customer_id"), ["device_id"], [F.col("account_id")], limit + 1).drop("rank"), "device-accounts")
    # once an owner, not once a seed, and laid out by owner, so that repeats over its devices go where they arise. An account that is kept is in the lists
    # of all devices it shares, so the smallest device of the lists is the smallest shared one
    mine = dev.join(s.select(F.col("owner").alias("customer_id")).distinct(), "customer_id", "left_semi").withColumnRenamed("customer_id", "owner").repartition("owner")
    on_device = (mine.join(by_device, "device_id").filter("customer_id <> owner").groupBy("owner", "account_id").agg(F.min("device_id").alias("device_id")))
    on_device = stage(top_k(on_device, ["owner"], [F.col("account_id")], limit + 1).drop("rank"), "shared-devices")
    via_dev = s.join(on_device, "owner").select("seed", "account_id", F.lit(1).alias("hops"), F.lit("shared_device").alias("via"), F.lit(1).alias("priority"), "device_id")
    adj = stage(both_ways(edges), "adjacency")
    found, frontier = stage(same.unionByName(via_dev).select(*columns), "near0"), s.select("seed", F.col("seed").alias("id")).distinct()
    seen = frontier
    for d in range(1, max_hops + 1):
        # a seed with `limit` nearer accounts is closed. An account of the last level is kept only if fewer than `limit` others precede it, and all smaller
        # neighbours of the one it is reached from do, so the first `limit` + 1 neighbours are enough there
        full = found.filter(F.col("hops") < d).select("seed", "account_id").distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).select("seed")
        steps = top_k(adj, ["id"], [F.col("next")], limit + 1).drop("rank") if d == max_hops else adj
        nxt = frontier.join(full, "seed", "left_anti").join(steps, "id").select("seed", F.col("next").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti")
        frontier = stage(nxt, f"near{d}")
        seen = seen.unionByName(frontier)
        found = found.unionByName(frontier.select("seed", F.col("id").alias("account_id"), F.lit(d).alias("hops"), F.lit("transfers").alias("via"), F.lit(2).alias("priority"), no_device))
    best = found.groupBy("seed", "account_id").agg(F.min(F.struct("priority", "hops", "device_id", "via")).alias("b")).select(
        "seed", "account_id", "b.hops", "b.via", "b.device_id")
    via = F.when(F.col("via") == "shared_device", F.concat(F.lit("shared_device:"), F.col("device_id").cast("string"))).otherwise(F.col("via"))
    return top_k(best, ["seed"], [F.col("hops"), F.col("account_id")], limit).select("seed", "account_id", "hops", via.alias("via"), "rank")


def peeled(edges: DataFrame) -> DataFrame:
    """(source, target) without accounts that lack an edge in or out: they are dropped until none is left."""
    e = stage(edges.filter("source <> target").select("source", "target").distinct(), "cycle-edges")
    n = e.count()
    while n:
        both = e.select(F.col("source").alias("a")).distinct().join(e.select(F.col("target").alias("a")).distinct(), "a", "left_semi")
        e = stage(e.join(both, e.source == both.a, "left_semi").join(both, e.target == both.a, "left_semi"), "cycle-edges")
        before, n = n, e.count()
        if n == before:
            break
    return e


def candidate_cycles(edges: DataFrame, max_len: int, since: datetime | None) -> DataFrame:
    """Simple directed cycles of 2..max_len accounts, rotated to the smallest account, each once.

    Accounts that can be on no cycle are peeled off first. A cycle is two half paths from its smallest account, one along the transfers and one against
    them, that meet on both end points; so paths of half the length are all that is built without a closing edge.
    """
    e = peeled(live(edges, since))

    def halves(step: DataFrame, hops: int, name: str) -> list[DataFrame]:
        """Simple paths of 1..hops edges from accounts smaller than all others on the path: (start, last, path without start)."""
        paths = [step.filter(F.col("next") > F.col("at")).select(F.col("at").alias("start"), F.col("next").alias("last"), F.array("next").alias("path"))]
        for d in range(2, hops + 1):
            further = paths[-1].join(step, F.col("last") == F.col("at")).filter((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next")))
            paths.append(stage(further.select("start", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path")), f"{name}{d}"))
        return paths

    ahead = halves(e.select(F.col("source").alias("at"), F.col("target").alias("next")), (max_len + 1) // 2, "ahead")
    behind = halves(e.select(F.col("target").alias("at"), F.col("source").alias("next")), max_len // 2, "behind")
    found = None
    for length in range(2, max_len + 1):
        there, back = ahead[(length + 1) // 2 - 1], behind[length // 2 - 1].withColumnRenamed("path", "way_back")
        rest = F.slice(F.reverse("way_back"), 2, max_len)
        closed = (there.join(back, ["start", "last"]).filter(~F.arrays_overlap("path", rest))
                  .select(F.concat(F.array("start"), "path", rest).alias("cycle"), F.lit(length).alias("length")))
        found = closed if found is None else found.unionByName(closed)
    return found


def listed_cycles(edges: DataFrame, txn: DataFrame, start: datetime, end: datetime, rules) -> DataFrame:
    """Candidate cycles with whether a time-ordered chain of transfers follows them."""
    cand = candidate_cycles(edges, rules.cycle_length, start)
    chains = verified_cycles(txn, start, end, rules).select("cycle", F.col("ids").alias("transactions"), "start_usd")
    return cand.join(chains, "cycle", "left").withColumn("time_ordered", F.col("transactions").isNotNull())


def trace_funds(edges: DataFrame, seeds: DataFrame, direction: str = "out", max_hops: int = 3, since: datetime | None = None,
                limit: int = 50) -> DataFrame:
    """Onward (or backward) simple paths from every seed, all prefixes included, each hop active after the one before
    it began. The first `limit` by (hops desc, smallest edge desc, path) per seed."""
    e = live(edges, since)
    a, b = ("source", "target") if direction == "out" else ("target", "source")
    e = e.select(F.col(a).alias("at"), F.col(b).alias("next"), "total_usd", "first_ts", "last_ts")
    paths = seeds.select(F.col("account_id").alias("seed"), F.col("account_id").alias("at"), F.array("account_id").alias("path"),
                         F.lit(None).cast("double").alias("first_usd"), F.lit(None).cast("double").alias("min_usd"),
                         F.lit(None).cast("timestamp").alias("start_ts"), F.lit(None).cast("timestamp").alias("prev_first"))
    flows = None
    for hop in range(1, max_hops + 1):
        ok = ~F.array_contains("path", F.col("next")) & (F.col("prev_first").isNull() | (F.col("last_ts") >= F.col("prev_first")))
        paths = paths.join(e, "at").filter(ok).select(
            "seed", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"),
            F.coalesce("first_usd", "total_usd").alias("first_usd"), F.least(F.coalesce("min_usd", "total_usd"), "total_usd").alias("min_usd"),
            F.coalesce("start_ts", "first_ts").alias("start_ts"), F.col("first_ts").alias("prev_first"), "last_ts")
        part = paths.select("seed", "path", F.lit(hop).alias("hops"), "first_usd", "min_usd", "start_ts", "last_ts")
        flows = part if flows is None else flows.unionByName(part)
        paths = paths.drop("last_ts")
    return top_k(flows, ["seed"], [F.col("hops").desc(), F.col("min_usd").desc(), F.col("path")], limit)


# --------------------------------------------------------------------------------------------------- counterparties
def counterparties(edges: DataFrame, accounts: DataFrame, since: datetime | None) -> DataFrame:
    """Distinct accounts each customer's accounts exchanged transfers with, its own accounts excluded."""
    e = live(edges, since)
    own = accounts.select("account_id", "customer_id")
    pairs = e.select("source", "target").join(own, F.col("source") == F.col("account_id")).select("customer_id", F.col("target").alias("other")).union(
        e.select("source", "target").join(own, F.col("target") == F.col("account_id")).select("customer_id", F.col("source").alias("other"))).distinct()
    mine = own.select("customer_id", F.col("account_id").alias("other"))
    return pairs.join(mine, ["customer_id", "other"], "left_anti")


def _touching(edges: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """Edges at `own` accounts seen from them: (key, account_id, other, direction, n, total_usd)."""
    cols = ["n", "total_usd"]
    out = edges.join(own, F.col("source") == F.col("account_id")).select(key, "account_id", F.col("target").alias("other"), F.lit("out").alias("direction"), *cols)
    inn = edges.join(own, F.col("target") == F.col("account_id")).select(key, "account_id", F.col("source").alias("other"), F.lit("in").alias("direction"), *cols)
    return out.unionByName(inn)


def _direction() -> Column:
    return F.when(F.min("direction") != F.max("direction"), "both").otherwise(F.min("direction")).alias("direction")


def customer_counterparties(edges: DataFrame, accounts: DataFrame, degree: int, since: datetime | None, hubs: DataFrame | None = None,
                            customers: DataFrame | None = None) -> DataFrame:
    """Accounts at distance 1 or 2 of every customer, with direction, count, value and the account they go through.

    A second-degree account keeps one edge only, the first by (via account, 'out' before 'in').
    """
    e = stage(live(edges, since).select("source", "target", "n", "total_usd"), "live-edges")
    own = accounts.select("account_id", "customer_id")
    chosen = own if customers is None else own.join(customers, "customer_id", "left_semi")
    mine = own.select("customer_id", F.col("account_id").alias("other"))
    t1 = _touching(e, chosen, "customer_id").join(mine, ["customer_id", "other"], "left_anti")
    first = t1.groupBy("customer_id", "other").agg(_direction(), F.sum("n").alias("n"), F.round(F.sum("total_usd"), 2).alias("total_usd"))
    first = first.select("customer_id", F.col("other").alias("account_id"), F.lit(1).alias("degree"), "direction", "n", "total_usd",
                         F.lit(None).cast(dict(accounts.dtypes)["account_id"]).alias("via_account"))
    if degree < 2:
        return first
    first = stage(first, "first-degree")
    via = first.select("customer_id", "account_id")
    if hubs is not None:
        via = via.join(hubs, "account_id", "left_anti")
    t2 = _touching(e, via, "customer_id").join(mine, ["customer_id", "other"], "left_anti").join(
        first.select("customer_id", F.col("account_id").alias("other")), ["customer_id", "other"], "left_anti")
    rank = F.when(F.col("direction") == "out", 0).otherwise(1)
    one = t2.groupBy("customer_id", "other").agg(F.min(F.struct("account_id", rank.alias("r"), "direction", "n", "total_usd")).alias("b"))
    second = one.select("customer_id", F.col("other").alias("account_id"), F.lit(2).alias("degree"), "b.direction", "b.n", "b.total_usd",
                        F.col("b.account_id").alias("via_account"))
    return first.unionByName(second)


def shared_beneficiaries(edges: DataFrame, accounts: DataFrame, since: datetime | None, min_other: int = 1) -> DataFrame:
    """Beneficiaries of each account that other customers pay too, with how many. Payers are counted per beneficiary
    and the own customer taken off, so no pairs of payers are formed."""
    e = live(edges, since).select("source", "target")
    own = accounts.select("account_id", "customer_id")
    payers = (join_optional(e, own.withColumnRenamed("account_id", "__a"), "source", "__a", "source")
              .withColumn("payer", F.coalesce(F.col("customer_id").cast("string"), F.concat(F.lit("account:"), F.col("source").cast("string")))))
    to_self = payers.join(own.select(F.col("account_id").alias("target"), F.col("customer_id").alias("target_owner")), "target", "left")
    distinct = to_self.filter("customer_id IS NOT NULL AND (target_owner IS NULL OR target_owner <> customer_id)")
    per_target = payers.select("target", "payer").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("payers"))
    mine = distinct.select("customer_id", F.col("source").alias("paid_from"), "target", "target_owner")
    j = mine.join(per_target, "target").withColumn("n_other_customers", F.col("payers") - 1)
    return j.filter(F.col("n_other_customers") >= min_other).select(
        "customer_id", "paid_from", F.col("target").alias("beneficiary_account"), F.col("target_owner").alias("beneficiary_owner"), "n_other_customers")


def common_recipients(edges: DataFrame, accounts: DataFrame, sources: DataFrame, min_sources: int = 2, since: datetime | None = None,
                      group: str | None = None) -> DataFrame:
    """Accounts outside the given set that at least `min_sources` of the set pay; `group` keeps several sets apart."""
    g = [group] if group else []
    src = sources.select(*g, F.col("account_id").alias("source")).distinct()
    e = live(edges, since).select("source", "target", "n", "total_usd")
    paid = e.join(src, "source").join(src.select(*g, F.col("source").alias("target")), [*g, "target"], "left_anti")
    rows = paid.groupBy(*g, "target").agg(F.count(F.lit(1)).alias("n_sources"), F.round(F.sum("total_usd"), 2).alias("total_usd"),
                                         F.sum("n").alias("n_transactions")).filter(F.col("n_sources") >= min_sources)
    own = accounts.select(F.col("account_id").alias("target"), F.col("customer_id").alias("owner_customer_id"))
    return rows.join(own, "target", "left").withColumnRenamed("target", "account_id")


def fan_patterns(edges: DataFrame, accounts: DataFrame, alerts: DataFrame, since: datetime | None, min_degree: int = 5) -> DataFrame:
    """Accounts with many distinct senders or receivers."""
    e = live(edges, since)
    # both sides of an edge in one pass and one shuffle
    ends = e.select(F.explode(F.array(F.struct(F.col("target").alias("account_id"), F.lit(1).alias("i"), F.lit(0).alias("o"), "total_usd"),
                                      F.struct(F.col("source").alias("account_id"), F.lit(0).alias("i"), F.lit(1).alias("o"), "total_usd"))).alias("x")).select("x.*")
    usd = F.col("total_usd").cast("decimal(18,2)")
    a = ends.groupBy("account_id").agg(
        F.sum("i").alias("distinct_senders"), F.sum("o").alias("distinct_receivers"),
        F.coalesce(F.sum(F.when(F.col("i") == 1, usd)).cast("double"), F.lit(0.0)).alias("in_usd"),
        F.coalesce(F.sum(F.when(F.col("o") == 1, usd)).cast("double"), F.lit(0.0)).alias("out_usd"))
    many_in, many_out = F.col("distinct_senders") >= min_degree, F.col("distinct_receivers") >= min_degree
    flags = open_alert_customers(alerts).withColumn("flagged", F.lit(True))
    return (a.filter(many_in | many_out)
            .withColumn("pattern", F.when(many_in & many_out, "fan_in+fan_out").when(many_in, "fan_in").otherwise("fan_out"))
            .join(accounts.select("account_id", "customer_id"), "account_id", "left").join(flags, "customer_id", "left")
            .select("account_id", F.col("customer_id").alias("owner_customer_id"), "pattern", "distinct_senders", "distinct_receivers",
                    "in_usd", "out_usd", F.coalesce("flagged", F.lit(False)).alias("flagged")))


def account_owners(accounts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Owner of every account and whether the owner has an open alert."""
    flags = open_alert_customers(alerts).withColumn("flagged", F.lit(True))
    return accounts.select("account_id", "customer_id").join(flags, "customer_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def flow_subgraph(edges: DataFrame, accounts: DataFrame, alerts: DataFrame, seeds: DataFrame, depth: int, since: datetime | None,
                  max_nodes: int = 60, max_edges: int = 250) -> tuple[DataFrame, DataFrame]:
    """Transfer neighbourhood of each seed customer: nodes (depth, role, degrees, flag) and edges. Hubs are not expanded.

    Within a depth nodes are taken by (depth, account) and edges by (depth, value, ids); `truncated` tells of more.
    """
    e = stage(live(edges, since).select("source", "target", "n", "total_usd", "first_ts", "last_ts"), "flow-edges")
    own = accounts.select("account_id", "customer_id")
    deg = degrees(e)
    hubs = deg.filter(F.col("degree") > HUB_DEGREE).select("id")
    adj = e.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("next"), F.lit("downstream").alias("role"), "source", "target", "n", "total_usd"),
        F.struct(F.col("target").alias("id"), F.col("source").alias("next"), F.lit("upstream").alias("role"), "source", "target", "n", "total_usd"))).alias("x")).select("x.*")
    start = own.join(seeds, "customer_id", "left_semi").select(F.col("customer_id").alias("seed"), F.col("account_id").alias("id"), F.lit(0).alias("depth"), F.lit("subject").alias("roles"))
    seen, frontier, touched = start, start, None
    for d in range(1, depth + 1):
        grow = frontier if d == 1 else frontier.join(hubs, "id", "left_anti")
        step = stage(grow.select("seed", "id").join(adj, "id").withColumn("depth", F.lit(d)), f"flow{d}")
        part = step.select("seed", "source", "target", "n", "total_usd", "depth")
        touched = part if touched is None else touched.unionByName(part)
        frontier = (step.select("seed", F.col("next").alias("id"), "role").distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
                    .groupBy("seed", "id").agg(F.array_join(F.array_sort(F.collect_list("role")), "+").alias("roles"))
                    .withColumn("depth", F.lit(d)).select("seed", "id", "depth", "roles"))
        seen = seen.unionByName(frontier)
    sizes = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("reached"))
    nodes = top_k(seen, ["seed"], [F.col("depth"), F.col("id")], max_nodes).drop("rank").join(sizes, "seed").withColumn(
        "truncated", F.col("reached") > max_nodes).drop("reached")
    indeg = e.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    outdeg = e.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    owners = account_owners(accounts, alerts).withColumnRenamed("account_id", "id")
    nodes = (nodes.join(indeg, "id", "left").join(outdeg, "id", "left").fillna(0, ["in_degree", "out_degree"]).join(owners, "id", "left")
             .join(hubs.withColumn("is_hub", F.lit(True)), "id", "left").withColumn("is_hub", F.coalesce("is_hub", F.lit(False)))
             .withColumn("flagged", F.coalesce("flagged", F.lit(False)))
             .withColumnRenamed("id", "account_id").withColumnRenamed("customer_id", "owner_customer_id"))
    first = touched.groupBy("seed", "source", "target").agg(F.min("depth").alias("depth"), F.first("n").alias("n"), F.first("total_usd").alias("total_usd"))
    kept = nodes.select("seed", "account_id")
    inside = first.join(kept.withColumnRenamed("account_id", "source"), ["seed", "source"], "left_semi").join(
        kept.withColumnRenamed("account_id", "target"), ["seed", "target"], "left_semi")
    return nodes, top_k(inside, ["seed"], [F.col("depth"), F.col("total_usd").desc(), F.col("source"), F.col("target")], max_edges)


# --------------------------------------------------------------------------------------------------------- clusters
CLUSTER_KINDS = ("customer", "account", "device", "phone", "email", "address")


def suspicious_clusters(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_hops: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbourhood of 2 x hops over six node kinds: all members, induced edges, and the summary per seed customer.

    Sizes, flags and density are those of whole neighbourhoods; lists for display are cut by whoever shows them. Induced edges start at the end with
    fewer edges, so that a busy member is not expanded.
    """
    s = seeds.select(node("customer", F.col("customer_id")).alias("seed"))
    nodes = stage(nodes, "nodes")
    pairs = weighed_pairs(nodes, edges)
    members = stage(related(nodes, edges, s, 2 * max_hops, None, CLUSTER_KINDS, hub_kinds=(), spare_customers=False, pairs=pairs).drop("truncated")
                    .join(nodes.select("id", "kind", "open_alert"), "id"), "members")
    low = F.when(F.col("x_degree") <= F.col("y_degree"), F.struct(F.col("x").alias("low"), F.col("y").alias("high"))).otherwise(
        F.struct(F.col("y").alias("low"), F.col("x").alias("high")))
    oriented = pairs.filter(F.col("x_kind").isin(*CLUSTER_KINDS) & F.col("y_kind").isin(*CLUSTER_KINDS)).select(low.alias("e")).select("e.low", "e.high")
    ids = members.select("seed", "id")
    inner = (ids.withColumnRenamed("id", "low").join(oriented, "low").join(ids.withColumnRenamed("id", "high"), ["seed", "high"], "left_semi")
             .select("seed", F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b")))
    inner = stage(inner, "cluster-edges")
    m = inner.groupBy("seed").agg(F.count(F.lit(1)).alias("m"))
    summary = members.groupBy("seed").agg(
        F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("kind") == "customer", 1)).alias("customers"),
        F.count(F.when(F.col("kind") == "account", 1)).alias("accounts"), F.count(F.when(F.col("kind") == "device", 1)).alias("devices"),
        F.count(F.when(F.col("open_alert"), 1)).alias("flagged"))
    n = F.col("size")
    summary = summary.join(m, "seed", "left").withColumn(
        "density", F.when(n > 1, F.round(2.0 * F.coalesce("m", F.lit(0)) / (n * (n - 1)), 4)).otherwise(0.0)).drop("m")
    return members, inner, summary


def degree_centrality(members: DataFrame, inner: DataFrame, k: int = 5) -> DataFrame:
    """Largest shares of other members a member touches."""
    d = inner.select("seed", F.explode(F.array("a", "b")).alias("id")).groupBy("seed", "id").agg(F.count(F.lit(1)).alias("deg"))
    size = members.groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
    c = members.select("seed", "id").join(d, ["seed", "id"], "left").join(size, "seed").filter("size > 1").select(
        "seed", "id", F.round(F.coalesce("deg", F.lit(0)) / (F.col("size") - 1), 4).alias("centrality"))
    return top_k(c, ["seed"], [F.col("centrality").desc(), F.col("id")], k)


#: Members of a cluster whose shortest paths one call counts; those of larger clusters are counted by groups of sources.
BETWEENNESS_MEMBERS = 400
#: Steps along edges that a group of sources takes, more for clusters of over `SOURCE_GROUPS` groups, and steps that are held at a time.
GROUP_STEPS, SOURCE_GROUPS, HELD_STEPS = 1 << 28, 512, 1 << 20


def betweenness(inner: DataFrame, summary: DataFrame, k: int = 5, limit: int | None = BETWEENNESS_MEMBERS) -> DataFrame:
    """Normalised shortest-path betweenness inside each cluster of at most `limit` members, or inside each cluster, five largest.

    Path counting is not a join; Python does it with Brandes' method. The edges of a cluster of at most `BETWEENNESS_MEMBERS` members come as one row.
    Larger ones are counted exactly too, by groups of sources that are dealt to tasks and summed.
    """
    counted = summary if limit is None else summary.filter(F.col("size") <= limit)
    large = stage(inner.join(counted.filter(F.col("size") > BETWEENNESS_MEMBERS).select("seed"), "seed", "left_semi"), "large-clusters")
    inner = inner.join(counted.filter(F.col("size") <= BETWEENNESS_MEMBERS).select("seed"), "seed", "left_semi")

    def central(batches):
        import pyarrow as pa
        for batch in batches:
            edges = batch.column("edges")
            ends = edges.flatten()
            a, b, at = ends.field("a").to_pylist(), ends.field("b").to_pylist(), edges.offsets.to_pylist()
            at = [i - at[0] for i in at]
            rows = [(seed, i, c, rank + 1) for seed, lo, hi in zip(batch.column("seed").to_pylist(), at, at[1:])
                    for rank, (c, i) in enumerate(_central(a[lo:hi], b[lo:hi], k))]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int32()))],
                                             names=["seed", "id", "centrality", "rank"])

    rows = inner.groupBy("seed").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    small = rows.mapInArrow(central, "seed string, id string, centrality double, rank int")
    return small if large.isEmpty() else small.unionByName(large_betweenness(large, k))


def large_betweenness(inner: DataFrame, k: int) -> DataFrame:
    """The `k` largest betweennesses of each cluster. Members are numbered, a group of sources is a row with the edges of its cluster, and each row is a task's."""
    ends = inner.select("seed", F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = stage(ends.withColumn("at", F.row_number().over(W.partitionBy("seed").orderBy("id")) - 1), "cluster-ids")
    end = lambda c, x: ids.select("seed", F.col("id").alias(c), F.col("at").alias(x))
    size = ids.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    edges = inner.join(end("a", "x"), ["seed", "a"]).join(end("b", "y"), ["seed", "b"]).groupBy("seed").agg(F.collect_list(F.struct("x", "y")).alias("edges"))
    groups = F.least(F.ceil(F.col("n") * F.size("edges") * 2 / GROUP_STEPS), F.lit(SOURCE_GROUPS), F.col("n")).cast("long")
    whole = stage(edges.join(size, "seed").withColumn("groups", groups), "numbered-clusters")
    dealt = whole.agg(F.sum("groups").alias("n")).first().n
    first = lambda g: F.floor(F.col("n") * g / F.col("groups")).cast("long")
    tasks = whole.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select(
        "seed", "n", first(F.col("g")).alias("lo"), first(F.col("g") + 1).alias("hi"), "edges").repartition(int(min(dealt, 10_000)))

    def shares(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for r in range(len(batch)):
                seed, n, lo, hi = (batch.column(c)[r].as_py() for c in ("seed", "n", "lo", "hi"))
                ends = batch.column("edges")[r].values
                score = _shares(ends.field("x").to_numpy(), ends.field("y").to_numpy(), n, lo, hi)
                at = np.flatnonzero(score)
                for i in range(0, len(at), 1 << 16):
                    part = at[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([seed] * len(part), pa.string()), pa.array(part.astype(np.int32)), pa.array(score[part])], names=["seed", "at", "share"])

    summed = tasks.mapInArrow(shares, "seed string, at int, share double").groupBy("seed", "at").agg(F.sum("share").alias("share"))
    scale = (F.col("n") - 1) * (F.col("n") - 2)
    found = ids.join(summed, ["seed", "at"], "left").join(size, "seed").select(
        "seed", "id", F.when(F.col("n") > 2, F.round(F.coalesce("share", F.lit(0.0)) / scale, 4)).otherwise(0.0).alias("centrality"))
    return top_k(found, ["seed"], [F.col("centrality").desc(), F.col("id")], k).select("seed", "id", "centrality", "rank")


def _shares(x, y, n: int, lo: int, hi: int):
    """What sources `lo` to `hi` add to the betweenness of each of the `n` nodes of the graph with edges x[i] - y[i], some sources at a time."""
    import numpy as np
    source, target = np.concatenate([x, y]).astype(np.int64), np.concatenate([y, x]).astype(np.int64)
    near, begin = target[np.argsort(source, kind="stable")], np.append(0, np.cumsum(np.bincount(source, minlength=n)))
    score, at_once = np.zeros(n), max(1, HELD_STEPS // (len(near) + n))
    for first in range(lo, hi, at_once):
        sources = np.arange(first, min(first + at_once, hi))
        cells = len(sources) * n  # one for every source and node
        seen, paths, mark, share = np.zeros(cells, dtype=bool), np.zeros(cells), np.zeros(cells, dtype=np.int64), np.zeros(cells)
        at = np.arange(len(sources)) * n + sources
        seen[at], paths[at], steps = True, 1.0, []
        while len(at):  # a level: nodes at one distance from their source
            v = at % n
            degree = begin[v + 1] - begin[v]
            of = np.repeat(at, degree)
            to = of - np.repeat(v, degree) + near[np.arange(len(of)) - np.repeat(np.cumsum(degree) - degree - begin[v], degree)]
            of, to = of[~seen[to]], to[~seen[to]]
            np.add.at(paths, to, paths[of])
            seen[to] = True
            mark[to] = np.arange(len(to))
            steps.append((of, to))
            at = to[mark[to] == np.arange(len(to))]
        for of, to in reversed(steps):
            np.add.at(share, of, paths[of] / paths[to] * (1 + share[to]))
        share[np.arange(len(sources)) * n + sources] = 0
        score += share.reshape(-1, n).sum(axis=0)
    return score


def _central(a: list, b: list, k: int) -> list[tuple[float, str]]:
    """The `k` largest (betweenness, id) of the graph with edges a[i] - b[i]."""
    ids = list(dict.fromkeys(a + b))
    place = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    adj: list[list[int]] = [[] for _ in ids]
    for x, y in zip(a, b):
        adj[place[x]].append(place[y])
        adj[place[y]].append(place[x])
    score = [0.0] * n
    for s in range(n):
        dist, paths, share = [-1] * n, [0.0] * n, [0.0] * n
        preds: list[list[int]] = [[] for _ in ids]
        dist[s], paths[s], order = 0, 1.0, [s]
        for v in order:  # grows while it is read: nodes by distance
            after, ways = dist[v] + 1, paths[v]
            for w in adj[v]:
                if dist[w] < 0:
                    dist[w] = after
                    order.append(w)
                if dist[w] == after:
                    paths[w] += ways
                    preds[w].append(v)
        for w in reversed(order):
            for v in preds[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return [(-c, i) for c, i in sorted((-round(v * scale, 4), i) for i, v in zip(ids, score))[:k]]

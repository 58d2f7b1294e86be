"""Paths, cycles and clusters over whole graphs with a hub, against plain searches."""
from __future__ import annotations

import random
from datetime import datetime

import pytest

from riskloom.operators import graph as g

D = datetime(2026, 9, 1)


@pytest.fixture(scope="module")
def links() -> set[tuple[int, int]]:
    """A sparse random graph, and one hub that half of all accounts pay and that pays the other half."""
    rnd = random.Random(3)
    out = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(110)}
    return out | {(i, 99) for i in range(0, 60, 2)} | {(99, i) for i in range(1, 60, 2)} | {(200, 201), (201, 202), (5, 5)}


@pytest.fixture(scope="module")
def edges(spark, links):
    return spark.createDataFrame([(a, b, 1, 10.0, D, D) for a, b in links], "source long, target long, n long, total_usd double, first_ts timestamp, last_ts timestamp")


def plain_paths(links, source, max_hops):
    """Smallest shortest path to every account within reach."""
    best, level = {source: [source]}, {source: [source]}
    for _ in range(max_hops):
        after: dict[int, list[int]] = {}
        for at, path in level.items():
            for a, b in links:
                if a == at and b not in best and (b not in after or path + [b] < after[b]):
                    after[b] = path + [b]
        best |= after
        level = after
    return best


@pytest.mark.parametrize("max_hops", [1, 2, 5, 6])
def test_shortest_paths_meet_in_the_middle(spark, edges, links, max_hops):
    pairs = [(a, b) for a in (0, 3, 7, 10, 99, 200, 999) for b in (1, 2, 9, 33, 99, 202, 0)]
    want = {(a, b): plain_paths(links, a, max_hops)[b] for a, b in pairs if a != b and b in plain_paths(links, a, max_hops)}
    got = g.shortest_paths(edges, spark.createDataFrame(pairs + pairs[:3], "source long, target long"), max_hops).collect()
    assert {(r.source, r.target): r.path for r in got} == want and len(got) == len(want)
    assert all(r.hops == len(r.path) - 1 for r in got)


def plain_cycles(links, max_len):
    out = set()

    def walk(path):
        for a, b in links:
            if a == path[-1]:
                if b == path[0] and len(path) >= 2:
                    out.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < max_len:
                    walk([*path, b])

    for s in {a for a, _ in links}:
        walk([s])
    return out


@pytest.mark.parametrize("max_len", [2, 3, 4, 5])
def test_cycles_from_half_paths(edges, links, max_len):
    got = [tuple(r.cycle) for r in g.candidate_cycles(edges, max_len, None).collect()]
    assert set(got) == plain_cycles(links, max_len) and len(got) == len(set(got))


def test_peeling_leaves_accounts_with_edges_in_and_out(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(10, 11), (11, 10), (11, 12), (9, 10)], "source long, target long")
    assert {(r.source, r.target) for r in g.peeled(chain).collect()} == {(10, 11), (11, 10)}
    assert g.peeled(chain.limit(0)).count() == 0


def test_cluster_counts_are_those_of_the_whole_neighbourhood(spark):
    """A customer with 500 accounts: nothing is cut before sizes, flags and density."""
    nodes = spark.createDataFrame([("customer:1", "customer", True), ("customer:2", "customer", True)] + [(f"account:{i}", "account", False) for i in range(500)],
                                  "id string, kind string, open_alert boolean")
    edges = spark.createDataFrame([("customer:1", f"account:{i}", "OWNS", 1) for i in range(499)] + [("customer:2", "account:499", "OWNS", 1)]
                                  + [("account:0", "account:499", "TRANSFERRED_TO", 1), ("account:499", "account:0", "TRANSFERRED_TO", 2), ("account:1", "account:2", "TRANSFERRED_TO", 1)],
                                  "source string, target string, rel string, n long")
    seeds = spark.createDataFrame([(1,), (2,)], "customer_id long")
    members, inner, summary = g.suspicious_clusters(nodes, edges, seeds)
    rows = {r.seed: r for r in summary.collect()}
    one = rows["customer:1"]
    assert (one["size"], one.customers, one.accounts, one.flagged) == (502, 2, 500, 2)
    assert one.density == round(2 * 502 / (502 * 501), 4)
    assert inner.filter("seed = 'customer:1'").count() == 502 and inner.distinct().count() == inner.count()
    # the second customer reaches the first through the accounts, whose owner is too busy to be expanded
    assert rows["customer:2"]["size"] == 4
    assert {r.seed for r in g.betweenness(inner, summary).collect()} == {"customer:2"}

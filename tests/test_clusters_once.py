"""Clusters: the projection is worked out once, pairs carry the facts of their ends, and a cluster's edges reach Python as one row."""
from __future__ import annotations

import random
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest

from riskloom.operators import graph as g
from riskloom.plans import network
from riskloom.plans.registry import QUERIES, load_all


def test_projection_is_read_from_one_staged_table(spark):
    """Nodes, degrees and pairs all start at the edges; from rows, each of them would join and sum the transactions again."""
    txn = spark.createDataFrame([(1, datetime(2026, 1, 1), 1, 2, 3, 5, "10.0.0.1", 9.0, "completed"), (2, datetime(2026, 1, 2), 2, None, None, None, None, 4.0, "completed")],
                                "transaction_id long, ts timestamp, sender_account_id long, receiver_account_id long, merchant_id long, device_id long, ip_address string, amount_usd double, status string")
    accounts = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, None)], "account_id long, customer_id long")
    customers, merchants = spark.createDataFrame([(1,), (4,)], "customer_id long"), spark.createDataFrame([(3,), (8,)], "merchant_id long")
    identifiers = spark.createDataFrame([(1, "phone", "a" * 20), (2, "phone", "a" * 20)], "customer_id long, identifier_type string, value_hash string")
    alerts = spark.createDataFrame([(1, "customer", "open")], "entity_id long, entity_type string, status string")
    given = (txn, customers, accounts, merchants, identifiers, alerts)
    nodes, edges = g.projection(*given)
    assert edges.inputFiles() and set(edges.inputFiles()) == set(nodes.select("id").distinct().inputFiles()) and "projection-edges" in edges.inputFiles()[0]
    plain_nodes, plain_edges = g.projection(*given, staged=False)
    assert sorted(map(str, edges.collect())) == sorted(map(str, plain_edges.collect()))
    assert sorted(map(str, nodes.collect())) == sorted(map(str, plain_nodes.collect()))


def test_pairs_carry_kind_and_incident_edges_of_both_ends(spark):
    nodes = spark.createDataFrame([("a", "customer", False), ("b", "account", False)], "id string, kind string, open_alert boolean")
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "a"), ("a", "z"), (None, "a")], "source string, target string")
    assert {tuple(r) for r in g.weighed_pairs(nodes, edges).select("x", "y", "x_kind", "y_kind", "x_degree", "y_degree").collect()} == {
        ("a", "b", "customer", "account", 6, 2), ("a", "z", "customer", None, 6, 1)}


def plain_betweenness(links):
    ids = sorted({v for e in links for v in e})
    near = {v: {b for a, b in links if a == v} | {a for a, b in links if b == v} for v in ids}

    def paths(s, t):
        level = [[s]]
        while level and not any(p[-1] == t for p in level):
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in p]
        return [p for p in level if p[-1] == t]

    score = dict.fromkeys(ids, 0.0)
    for s, t in combinations(ids, 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                score[v] += 2 / len(found)
    n = len(ids)
    return [i for _, i in sorted((-round(v / ((n - 1) * (n - 2)), 4), i) for i, v in score.items())[:5]], {i: v / ((n - 1) * (n - 2)) for i, v in score.items()}


def test_betweenness_of_many_clusters_needs_no_call_each(spark):
    rnd = random.Random(5)
    clusters = {f"s{c}": {tuple(sorted(rnd.sample("abcdefgh", 2))) for _ in range(9)} for c in range(12)}
    inner = spark.createDataFrame([(s, a, b) for s, links in clusters.items() for a, b in links], "seed string, a string, b string").repartition(3)
    summary = spark.createDataFrame([(s, 8) for s in clusters], "seed string, size long")
    out = g.betweenness(inner, summary)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = out.orderBy("seed", "rank").collect()
    for s, links in clusters.items():
        mine, (_, score) = [r for r in got if r.seed == s], plain_betweenness(links)
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and [r.centrality for r in mine] == sorted((r.centrality for r in mine), reverse=True)
        assert [r.centrality for r in mine] == pytest.approx(sorted(score.values(), reverse=True)[:5], abs=1e-4)
        assert all(r.centrality == pytest.approx(score[r.id], abs=1e-4) for r in mine)
    assert g.betweenness(inner.limit(0), summary).count() == 0


def test_betweenness_of_clusters_of_any_size(spark, monkeypatch):
    """A cluster beyond `BETWEENNESS_MEMBERS` beside a small one: all sources are counted, whatever the groups they are dealt in."""
    rnd, n = random.Random(8), g.BETWEENNESS_MEMBERS + 20
    links = {(rnd.randrange(i), i) for i in range(1, n)} | {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(60)}
    ways, far, level, steps = np.eye(n), np.where(np.eye(n) > 0, 0, -1), np.eye(n), 0
    near = np.zeros((n, n))
    for a, b in links:
        near[a, b] = near[b, a] = 1
    while (level := (level @ near) * (far < 0)).any():
        steps += 1
        far[level > 0], ways = steps, ways + level
    score = []
    for v in range(n):  # pairs of others, each way, and the share of their shortest paths that pass the node
        passed = (far[:, [v]] + far[[v], :] == far) * (ways[:, [v]] * ways[[v], :] / ways)
        passed[v, :] = passed[:, v] = 0
        score.append(passed.sum() / ((n - 1) * (n - 2)))
    inner = spark.createDataFrame([("big", f"m{a:04}", f"m{b:04}") for a, b in links] + [("small", "a", "b"), ("small", "b", "c")], "seed string, a string, b string").repartition(3)
    summary = spark.createDataFrame([("big", n), ("small", 3)], "seed string, size long")
    monkeypatch.setattr(g, "GROUP_STEPS", 100_000)
    found = g.betweenness(inner, summary, limit=None).orderBy("seed", "rank").collect()
    assert [(r.id, r.centrality) for r in found if r.seed == "small"] == [("b", 1.0), ("a", 0.0), ("c", 0.0)]
    big = [r for r in found if r.seed == "big"]
    assert [r["rank"] for r in big] == [1, 2, 3, 4, 5] and [r.centrality for r in big] == pytest.approx(sorted(score, reverse=True)[:5], abs=1e-4)
    assert all(r.centrality == pytest.approx(score[int(r.id[1:])], abs=1e-4) for r in big)
    assert {r.seed for r in g.betweenness(inner, summary).collect()} == {"small"}


def test_the_query_ranks_large_clusters_too(spark, monkeypatch):
    inner = spark.createDataFrame([("customer:1", "customer:1", f"account:{i}") for i in range(450)], "seed string, a string, b string")
    monkeypatch.setattr(network, "clusters", lambda b: (None, inner, spark.createDataFrame([("customer:1", 451)], "seed string, size long")))
    load_all()
    found = QUERIES["gr09_betweenness"](spark, "").orderBy("rank").collect()
    assert [(r.id, r.centrality) for r in found] == [("customer:1", 1.0), ("account:0", 0.0), ("account:1", 0.0), ("account:10", 0.0), ("account:100", 0.0)]

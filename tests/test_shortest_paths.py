"""Shortest paths without a level per account: what is staged, and results when lists are cut into many rows."""
from __future__ import annotations

import random
from datetime import datetime

import pytest

from riskloom.operators import graph as g
from tests.test_graph_whole import plain_paths

D = datetime(2026, 9, 1)


def test_nothing_staged_outgrows_edges_and_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    links = sorted({(a, rnd.randrange(300)) for a in range(300) for _ in range(5)})
    edges = spark.createDataFrame([(a, b, D) for a, b in links], "source long, target long, last_ts timestamp")
    pairs = [(a, rnd.randrange(300)) for a in range(300)]
    rows, real = {}, g.stage

    def counted(df, name):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(g, "stage", counted)
    got = {(r.source, r.target): r.path for r in g.shortest_paths(edges, spark.createDataFrame(pairs, "source long, target long"), 6).collect()}
    assert got == {(a, b): plain_paths(links, a, 6)[b] for a, b in pairs if a != b and b in plain_paths(links, a, 6)}
    assert max(rows.values()) <= len(links) + len(pairs), rows


@pytest.mark.parametrize("listed, first", [(2, 1), (512, 8)])
def test_lists_in_many_rows_and_few_first_steps(spark, monkeypatch, listed, first):
    monkeypatch.setattr(g, "LISTED", listed)
    monkeypatch.setattr(g, "FIRST_STEPS", first)
    rnd = random.Random(6)
    links = {(rnd.randrange(50), rnd.randrange(50)) for _ in range(90)} | {(i, 60) for i in range(0, 50, 3)} | {(60, 70), (70, 71), (71, 72), (72, 73)}
    edges = spark.createDataFrame([(a, b, D) for a, b in links], "source long, target long, last_ts timestamp")
    pairs = [(a, b) for a in range(0, 50, 4) for b in (1, 5, 60, 70, 71, 72, 73, 99)]
    got = {(r.source, r.target): (r.path, r.hops) for r in g.shortest_paths(edges, spark.createDataFrame(pairs, "source long, target long"), 5).collect()}
    assert got == {(a, b): (p, len(p) - 1) for a, b in pairs if a != b and (p := plain_paths(links, a, 5).get(b))}

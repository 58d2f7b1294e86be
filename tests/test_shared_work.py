"""Work that is done once: texts of keyword search, verified cycles, and FIFO evidence of fired entities only."""
from __future__ import annotations

from dataclasses import fields
from datetime import datetime

import pytest

from riskloom.config import TRIAL_RULES, Period
from riskloom.operators import detectors as det
from riskloom.operators import retrieval as ret
from riskloom.operators import scoring as sc


@pytest.mark.parametrize("sent", [500_000, 0])
def test_keyword_search_reads_texts_once(spark, monkeypatch, sent):
    docs = spark.createDataFrame([(1, "red fox runs"), (1, "red fox runs"), (2, "blue whale"), (3, None), (4, ""), (5, "fox fox whale and a very long tail of words")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "fox whale"), (8, "unicorn")], "query_id long, text string")
    calls, real = [], ret.words
    monkeypatch.setattr(ret, "SENT_TERMS", sent)
    monkeypatch.setattr(ret, "words", lambda c: (calls.append(1), real(c))[1])
    got = {(r.query_id, r.doc_id): r.score for r in ret.bm25(docs, queries, 10).collect()}
    assert len(calls) == 1
    assert set(got) == {(7, 1), (7, 2), (7, 5)}
    # the totals count every document, also those without text, and lengths of all words
    n = docs.select(ret.F.size(real(ret.F.col("text"))).alias("n")).agg(ret.F.count("*").alias("c"), ret.F.sum("n").alias("s")).first()
    terms = {d: {r.term: (r.tf, r.len) for r in ret.postings(docs).filter(ret.F.col("doc_id") == d).collect()} for d in (1, 2, 5)}
    import math
    df = {t: sum(t in v for v in terms.values()) for t in ("fox", "whale")}

    def part(t, tf, length):
        idf = math.log(1 + (n.c - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf * (ret.K1 + 1) / (tf + ret.K1 * (1 - ret.B + ret.B * length / (n.s / n.c)))

    for d in (1, 2, 5):
        assert got[7, d] == pytest.approx(sum(part(t, *terms[d][t]) for t in ("fox", "whale") if t in terms[d]), abs=1e-6)


def frames(**given) -> det.Frames:
    return det.Frames(**{f.name: given.get(f.name) for f in fields(det.Frames) if f.name != "grain"})


def test_rule_and_evidence_share_the_verified_cycles(spark, monkeypatch):
    found = spark.createDataFrame([([1, 2], [10, 11], 50.0)], "cycle array<long>, ids array<long>, start_usd double")
    calls = []
    monkeypatch.setattr(det, "verified_cycles", lambda *a: (calls.append(1), found)[1])
    f = frames(accounts=spark.createDataFrame([(1, 1), (2, 2)], "account_id long, customer_id long"), rules=TRIAL_RULES,
               period=Period(datetime(2026, 1, 31), lookback_days=10, baseline_days=20))
    assert {r.entity_id for r in det.circular(f).collect()} == {1, 2}
    rows = sc._cycle(f, spark.createDataFrame([(1, None)], "entity_id long, mark double"))[0].collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.pos)] == ["1 -> 2 -> 1", "10", "11"] and len(calls) == 1


def test_fifo_evidence_works_on_fired_entities_only(spark, monkeypatch):
    legs = spark.createDataFrame([(e, "win", e * 10) for e in range(1, 6)], "entity_id long, period string, transaction_id long")
    seen = []

    def fake(rows, *_):
        seen.extend(r.entity_id for r in rows.collect())
        return rows.selectExpr("entity_id", "array('a', 'b') AS pairs")

    monkeypatch.setattr(sc, "pass_through", fake)
    f = frames(legs=legs, rules=TRIAL_RULES)
    rows = sc._pass_through(f, spark.createDataFrame([(2, None), (4, None)], "entity_id long, mark double"))[0].collect()
    assert sorted(seen) == [2, 4] and sorted((r.entity_id, r.pos, r.id) for r in rows) == [(2, 1, "a"), (2, 2, "b"), (4, 1, "a"), (4, 2, "b")]

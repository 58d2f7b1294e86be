"""Products with sparse rows, in runs, against dense ones."""
from __future__ import annotations

import inspect

import numpy as np

from riskloom.operators import retrieval as ret
from riskloom.plans import library
from riskloom.plans.registry import QUERIES, load_all
from riskloom.session import stage


def test_products_in_runs_equal_dense_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    dense = rng.random((40, 30)) * (rng.random((40, 30)) < 0.2)
    dense[[0, 7, 39]] = 0
    rows = [(k, [int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for k, r in enumerate(dense)]
    weights = spark.createDataFrame(rows, "doc_id long, idx array<int>, w array<double>")
    basis = rng.standard_normal((30, 4))
    assert np.allclose(ret._accumulate(weights, basis), dense.T @ dense @ basis)
    monkeypatch.setattr(ret, "RUN", 40)  # ten terms at a time
    batches = weights.select("idx", "w", "doc_id").toArrow().combine_chunks().to_batches()
    runs = list(ret._runs([batches[0].slice(3)], basis))
    assert len(runs) > 10 and np.allclose(np.concatenate([r[-1] for r in runs]), dense[3:] @ basis)


def test_weights_have_unit_length_and_are_not_computed_in_a_lambda(spark):
    docs = spark.createDataFrame([(1, "money moves money fast"), (2, "money rests"), (3, None), (4, "")], "doc_id long, text string")
    made = ret.term_weights(docs, 64)
    rows = {r.doc_id: r for r in made.collect()}
    assert set(rows) == {1, 2} and all(abs(sum(x * x for x in r.w) - 1) < 1e-12 and list(r.idx) == sorted(set(r.idx)) for r in rows.values())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # the length of a document, within a lambda over its terms, is computed for each term


def test_terms_are_counted_where_they_are_read(spark, monkeypatch):
    """Terms brought together by document and slot, and weights kept beside them, took several times the texts on disk."""
    plans = []

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().toString()))
        return stage(df, name)

    monkeypatch.setattr(ret, "stage", spy)
    texts = ["money moves money fast", "money rests", None, "the of", "fast money moves"]
    assert len(ret.lsa(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 64).collect()) == 5
    assert [name for name, _ in plans] == ["repeated-ids", "term-counts"] and "Exchange" not in plans[1][1] and ": double" not in plans[1][1]


def test_rows_of_one_doc_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "money moves money"), (2, "money rests"), (1, "money rests"), (None, "money sleeps"), (None, "money sleeps"), (3, None)], "doc_id long, text string")
    plain = {r.doc_id: dict(zip(r.idx, r.tf)) for r in ret.term_counts(spark.createDataFrame([(1, "money moves money"), (2, "money rests"), (4, "money sleeps")], "doc_id long, text string"), 4096)[0].collect()}
    both = {i: plain[1].get(i, 0) + plain[2].get(i, 0) for i in plain[1] | plain[2]}
    rows, documents = (sorted(((r.doc_id or 0, list(zip(r.idx, r.tf))) for r in x.collect())) for x in ret.term_counts(docs, 4096))
    assert rows == [(0, []), (0, []), (1, sorted(both.items())), (1, sorted(both.items())), (2, sorted(plain[2].items())), (3, [])]
    assert [(k, dict(x)) for k, x in documents] == [(0, {i: 2 * n for i, n in plain[4].items()}), (1, both), (2, plain[2]), (3, {})]
    found = [(r.doc_id, r.embedding) for r in ret.lsa(docs, 2, 64).collect()]
    assert [any(v) for k, v in found if k in (None, 3)] == [False] * 3 and len({tuple(v) for k, v in found if k == 1}) == 1 and len(found) == 6


def test_a_product_leaves_no_shuffled_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    weights = spark.createDataFrame([(k, [k % 7, 9], [0.6, 0.8]) for k in range(40)], "doc_id long, idx array<int>, w array<double>").repartition(3)
    before = files()
    ret._accumulate(weights, np.eye(300, 4))
    assert not files() - before


def test_the_query_asks_for_the_whole_decomposition(spark, monkeypatch):
    asked = {}

    def seen(*args, **named):
        asked.update(bound := inspect.signature(whole).bind(*args, **named).arguments)
        return whole(bound["docs"], 2, 64)

    whole = ret.lsa
    monkeypatch.setattr(ret, "lsa", seen)
    monkeypatch.setattr(library, "table", lambda *_: spark.createDataFrame([(1, "money moves", "en", "a"), (2, "money rests", "en", "a")], "doc_id long, text string, lang string, source string"))
    load_all()
    assert {len(r.magnitudes) for r in QUERIES["r09_latent_vectors"](spark, "").collect()} == {2}
    assert set(asked) == {"docs"}  # 128 dimensions over 65,536 slots, as the operator has them by default
    assert [inspect.signature(whole).parameters[p].default for p in ("dim", "features", "rounds")] == [128, 1 << 16, 3]


def test_products_of_some_columns_at_a_time_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    dense = rng.random((20, 30)) * (rng.random((20, 30)) < 0.3)
    weights = spark.createDataFrame([(k, [int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for k, r in enumerate(dense)], "doc_id long, idx array<int>, w array<double>")
    basis = rng.standard_normal((30, 5))
    monkeypatch.setattr(ret, "COLUMNS", 2)
    monkeypatch.setattr(ret, "BLOCK", 7)
    assert np.allclose(ret._accumulate(weights.repartition(2), basis), dense.T @ dense @ basis)
    for rows in (4, 7, 30, 64):
        q = ret._orthonormal(basis.copy(), rows)
        assert np.allclose(q.T @ q, np.eye(5)) and np.allclose(q @ (q.T @ basis), basis)

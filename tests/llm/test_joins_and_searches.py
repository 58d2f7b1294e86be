"""Near-duplicates, repeated substrings, searches and the pipeline against brute force."""
from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, components, exact_search, jaccard, repeats
from riskloom.llm.queries import TOKENIZERS
from tests.llm.conftest import WORD, rows_of, sentence


# ------------------------------------------------------------------------------------------------------ near-duplicates
def shingles(text: str | None, n: int) -> frozenset:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked_groups(rows: list[tuple], rule: jaccard.Rule) -> list[tuple]:
    sets = [shingles(t, rule.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and rule.den * both >= rule.num * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = d if least[find(i)] is None else min(d, least[find(i)])
    return sorted(((d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("rule", "small"), [(jaccard.Rule(), 24), (jaccard.Rule(), 2), (jaccard.Rule(3, 60, 100), 2)])
def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch, rule, small):
    monkeypatch.setattr(jaccard, "SMALL_REGION", small)
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for g in range(8):  # groups of drifting copies, whose ends are not linked themselves
        words = sentence(g, 60 + 10 * g).split()
        for k in range(12):
            rows.append((1000 + 100 * g + k, " ".join(words)))
            words[int(rng.integers(len(words)))] = f"w{g}x{k}"
    passage = sentence(11, 40)
    rows += [(3000 + k, f"{passage} " + " ".join(f"u{k}v{j}" for j in range(10 + k))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.near_duplicates(docs, rule)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == linked_groups(rows, rule)
    by_component = defaultdict(set)
    for r in got.filter("component IS NOT NULL").collect():
        by_component[r.component].add(r.component_id)
    assert all(len(v) == 1 for v in by_component.values())


def test_order_of_shingles_changes_no_link(spark, documents, no_documents, monkeypatch):
    want = rows_of(jaccard.near_duplicates(documents), "doc_id", "n_shingles", "component_id")
    monkeypatch.setattr(jaccard, "common_shingles", lambda scanned: (np.zeros(0, np.uint64), np.zeros(0, np.int8)))
    assert rows_of(jaccard.near_duplicates(documents), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "common_shingles", lambda scanned: (jaccard_hashes(documents), np.full(len(jaccard_hashes(documents)), 16, np.int8)))
    assert rows_of(jaccard.near_duplicates(documents), "doc_id", "n_shingles", "component_id") == want
    assert jaccard.near_duplicates(no_documents).count() == 0


def jaccard_hashes(documents) -> np.ndarray:
    import pyarrow as pa
    return np.unique(np.concatenate(list(jaccard.sets(pa.array([r.text for r in documents.collect()]), 5))))[::2]


def test_passages_shared_by_unlike_documents_make_few_regions(spark):
    """Though no task sees the passage twice, and also where a short document's window reaches into it."""
    passage = sentence(21, 60)
    rows = [(k, f"{passage} " + " ".join(f"u{k}v{j}" for j in range(70))) for k in range(16)]
    rows += [(100 + k, f"{passage} " + " ".join(f"s{k}v{j}" for j in range(12))) for k in range(16)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    rule = jaccard.Rule()
    common = jaccard.common_shingles(jaccard.scan(docs, rule))
    assert len(common[0]) and (common[1] >= 5).all()
    assert jaccard.shared_regions(jaccard.replicate(docs, rule, common)).count() <= 2 * len(rows)
    assert rows_of(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == linked_groups(rows, rule)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 2 ** 63, 400, np.uint64)
        x, y = (np.unique(rng.choice(pool, int(rng.integers(1, 300)))) for _ in range(2))
        bits = np.bitwise_count((jaccard.sketch(x) ^ jaccard.sketch(y)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(x, y))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 300: 300, 301: 300}


# --------------------------------------------------------------------------------------------------- repeated substrings
def without_repeats(rows: list[tuple]) -> list[tuple]:
    raws = [(d, (t or "").encode()) for d, t in rows]
    n, seen = repeats.LENGTH, Counter()
    for _, r in raws:
        seen.update(r[p:p + n] for p in range(len(r) - n + 1))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for p in range(len(r) - n + 1):
            if seen[r[p:p + n]] > 1:
                gone[p + 1:p + 1 + n] = True
        inner = gone[1:len(r) + 1]
        kept = np.frombuffer(r, np.uint8)[~inner].tobytes()
        out.append((d, len(r), int(inner.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("merged", "small", "block"), [(2000, 200_000, 4_000_000), (3, 0, 700)])
def test_repeats_equal_brute_force(spark, documents, no_documents, monkeypatch, merged, small, block):
    """Also with narrow bundles for crowded cores, shuffled joins and texts scanned in small blocks."""
    monkeypatch.setattr(repeats, "MERGED_HULLS", merged)
    monkeypatch.setattr(repeats, "SMALL_ROWS", small)
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "MERGE_BYTES", 3000)
    rng = np.random.default_rng(6)
    passage = "".join(chr(97 + c) for c in rng.integers(0, 26, 900))
    rows = [(r.doc_id, r.text) for r in documents.collect() if r.doc_id != 11]
    for k in range(14):
        a, b = sorted(rng.integers(0, 900, 2).tolist())
        own = "".join(chr(65 + c) for c in rng.integers(0, 26, int(rng.integers(300))))
        rows.append((500 + k, own + passage[a:b] + own[::-1]))
    rows += [(600, passage[:400]), (601, passage[:399]), (602, "q" + passage[:400] + "r" + passage[:400]), (603, "é" + passage[100:700] + "ü" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_repeats(rows)
    assert repeats.remove_repeats(no_documents).count() == 0


def test_interleave_finds_shared_suffixes():
    rng = np.random.default_rng(7)
    strings = [bytes(rng.integers(0, 2, int(n), np.uint8)) for n in rng.integers(0, 900, 8)]
    strings += [strings[0][3:] + b"x", strings[1]]
    ends = np.cumsum([len(s) for s in strings])
    begins = ends - np.array([len(s) for s in strings])
    data = b"".join(strings)
    live, intervals = repeats.interleave(np.frombuffer(data, np.uint8), begins, ends)
    want = defaultdict(set)
    for b, e in zip(begins, ends, strict=True):
        for p in range(b, e - repeats.LENGTH + 1):
            want[data[p:p + repeats.LENGTH]].add(p)
    got = defaultdict(set)
    for p, i in zip(live.tolist(), intervals.tolist(), strict=True):
        got[i].add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


# -------------------------------------------------------------------------------------------------------------- searches
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[40][1]) for i in range(50)]  # ties
    rows += [(2100, None), (2120, [0.0] * 16), (2140, [float("nan")] * 16), (2160, [float("inf")] * 16), (2180, [None] * 16), (2200, []), (None, rows[0][1]),
             (2220, [1.0, 2.0]), (2240, [3.0, -1.0]), (40, rows[40][1]), (2260, [x * 5 for x in rows[3][1]])]
    return spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double").repartition(3)


def best(vectors, every: int, k: int, score, zero: bool) -> dict:
    rows = {}
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            rows[r.vec_id] = min(rows.get(r.vec_id, v), v)
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            found = sorted((-score(v, w), i) for i, w in rows.items() if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def listed(df) -> dict:
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


def integer_score(v, w):
    return sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(v, w, strict=True))


@pytest.mark.parametrize("sizes", [(8192, 2048, 16), (100, 7, 3)])
def test_exact_search_equals_brute_force(vectors, monkeypatch, sizes):
    from riskloom.llm import tiles
    for name, value in zip(("SHARD_ROWS", "BLOCK_ROWS", "FAN_IN"), sizes, strict=True):
        monkeypatch.setattr(tiles, name, value)
    got = listed(exact_search.top_k(vectors, F.col("vec_id") % 20 == 0, 10))
    assert got == {q: v for q, v in best(vectors, 20, 10, integer_score, True).items() if v}
    assert exact_search.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0, 10).count() == 0


def test_large_integers_stay_exact():
    a, b = np.array([[2.0 ** 40 + 1, 3.0]]), np.array([[2.0 ** 20 + 1, 5.0], [2.0 ** 50, 0]])
    assert exact_search.products(a, b).tolist() == [[(2 ** 40 + 1) * (2 ** 20 + 1) + 15, 2 ** 63 - 1]]


def test_approximate_search_finds_nearly_all(vectors):
    got = listed(ann.nearest(vectors, F.col("vec_id") % 20 == 0, 20))
    want = best(vectors, 20, 20, lambda v, w: float(np.dot(v, w)), False)
    assert set(got) == {q for q, v in want.items() if v}
    assert all(len(got[q]) == len(want[q]) for q in got)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in got]) >= 0.9
    for q, rows in got.items():
        scores = [s for _, s in rows]
        assert scores == sorted(scores, reverse=True) and q not in [i for i, _ in rows]
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_probes_reach_every_code_within_the_radius():
    rng = np.random.default_rng(9)
    own, codes = rng.integers(0, 256, (20, 4), np.uint8), rng.integers(0, 256, (300, 4), np.uint8)
    off = ann.POPCOUNT8[own[:, None] ^ codes[None]].sum(2)
    for radius in (0, 3, 7, 9, 12):
        hit = np.unpackbits(ann.probed(own, codes, radius), axis=1, count=300).astype(bool)
        assert hit[off <= radius].all()


# -------------------------------------------------------------------------------------------------------------- pipeline
@pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")
def test_pipeline_stages_take_effect(spark, documents, no_documents):
    import corpus_pipeline as pipe
    from riskloom.llm import bpe, langid, mixing, pii
    from riskloom.session import stage
    clashing = {c: F.lit(i).cast("int") for i, c in enumerate(("n", "i", "t", "stays", "copy", "size", "copies", "held_out", "lang_pred", "text_key", "part", "last", "a.b"))}
    docs, none = documents.withColumns(clashing), no_documents.withColumns(clashing)
    columns, schema = docs.columns, docs.schema
    for name, step in pipe.STAGES:
        before = docs.collect()
        docs = stage(step(spark, docs, ""), "test")
        after = docs.collect()
        assert step(spark, none, "").count() == 0
        if name != "BPE encoding":
            assert docs.columns == columns
            assert {tuple(r[c] for c in clashing) for r in after} == {tuple(range(len(clashing)))} and {r["class"] for r in after} == {"x"}
        if name == "language ID":
            assert Counter(r.text for r in after) == Counter(r.text for r in before if langid.words_of(r.text or ""))
        elif name == "n-gram Jaccard join":
            groups = defaultdict(list)
            for d, _, c in linked_groups([(r.doc_id, r.text) for r in before], jaccard.Rule()):
                groups[c].append(d)
            assert sorted((r.doc_id for r in after), key=str) == sorted(groups, key=str)
        elif name == "PII surrogates":
            assert [r.doc_id for r in after].__len__() == len(before)
            old = {c for r in before for _, _, _, c in pii.entities(r.text)}
            assert old and not old & {c for r in after for _, _, _, c in pii.entities(r.text)}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mixing to target weights":
            want = {(r.doc_id, r.text): r.copies for r in mixing.mix(spark.createDataFrame(before, schema).select("doc_id", "source", "text")).collect()}
            assert Counter((r.doc_id, r.text) for r in after) == Counter({k: v for k, v in want.items() if v})
        else:
            automaton = bpe.compile_merges(f"{TOKENIZERS}/byte_bpe_50k.json")
            assert sorted(automaton.decode(r.token_ids) for r in after) == sorted(r.text for r in before)


def test_one_row_stays_of_rows_that_repeat(spark, documents):
    import corpus_pipeline as pipe
    docs = documents.drop("score", "class")
    doubled = docs.unionByName(docs.filter("text IS NOT NULL"))
    got = pipe.near_duplicates(spark, doubled, "")
    once = pipe.near_duplicates(spark, docs, "")
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    assert rows_of(got.filter(words), "doc_id", "text") == rows_of(once.filter(words), "doc_id", "text")
    assert got.filter(~words).count() == 2 * once.filter(~words).count()

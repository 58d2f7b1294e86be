"""Fingerprints, spelling variants and lexical search against plain computations."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import imatch, lexical, variants
from tests.llm.conftest import rows_of, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- fingerprints

def plain_order(documents) -> list[tuple[int | None, str]]:
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    return sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1].encode())) + sorted((r for r in rows if r[0] is None), key=lambda r: r[1].encode())


@pytest.mark.parametrize("bucket_rows", [50, 1])
def test_edited_texts_and_equal_fingerprints(documents, no_documents, bucket_rows, monkeypatch):
    rows = plain_order(documents)
    want = []
    for i, (doc_id, text) in enumerate(rows):
        third = len(text) // 3
        new = text[:len(text) - third] + rows[(i + 1) % len(rows)][1][:third]
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest()))
    monkeypatch.setattr(imatch, "MIN_BUCKET_ROWS", bucket_rows)
    got = imatch.fingerprint_documents(documents)
    assert rows_of(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=str)
    by_text: dict[str, set] = {}
    found = {(r.doc_id, r.edited_sha256): r for r in got.collect()}
    texts = Counter((d, t) for d, t in rows)
    for (doc_id, text), _ in texts.items():
        by_text.setdefault(text, set()).update(r.fingerprint for (d, _), r in found.items() if d == doc_id and r.n_chars == len(text) and texts[(d, text)] and
                                               sum(1 for x, y in rows if x == d) == texts[(d, text)])
    assert all(len(prints) <= 1 for prints in by_text.values())
    assert all(0.0 <= r.near_edited <= 1.0 and 0.0 <= r.near_next <= 1.0 for r in found.values())
    assert imatch.fingerprint_documents(no_documents).count() == 0


def test_likeness_of_edits_and_of_others(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary, int(rng.integers(20, 3000))))) for i in range(120)], "doc_id long, text string")
    rows = imatch.fingerprint_documents(docs).collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 115 and np.mean([r.near_edited for r in rows]) > 0.3


def test_neighbours_over_many_buckets(spark):
    ids = [3, 9, 9, 9, 2 ** 60 + 1, 2 ** 60 + 2, -5, None, None, *range(100, 160)]
    docs = spark.createDataFrame([(x, f"text {i % 7} {x}") for i, x in enumerate(ids)], "doc_id long, text string").repartition(3)
    rows = plain_order(docs)
    want = sorted(((d, t, rows[(i + 1) % len(rows)][1]) for i, (d, t) in enumerate(rows)), key=str)
    assert rows_of(imatch.neighbours(docs, ["text"], bucket_rows=1).filter("guest = 0"), "doc_id", "text", "next_text") == want
    one = docs.filter("doc_id = 3")
    assert rows_of(imatch.neighbours(one, ["text"]).filter("guest = 0"), "next_text") == [("text 0 3",)]


# ---- spelling variants

def plain_variants(documents) -> list[tuple]:
    n: Counter = Counter()
    for r in documents.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    vocabulary = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = sorted({c for w in vocabulary for c in w})
    near = {}
    for w in vocabulary:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1) if i + k <= len(w)}
        near[w] = sorted((e for e in edits - {w} if e in vocabulary), key=lambda e: (-vocabulary[e], e))
    form = {w: near[w][0] if near[w] and vocabulary[near[w][0]] >= 2 * vocabulary[w] else None for w in vocabulary}

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), c, len(near[w]), vocabulary[form[w]] if form[w] else None) for w, c in vocabulary.items()), key=str)


@pytest.fixture(scope="module")
def misspelt(spark):
    rng = np.random.default_rng(11)
    stems = ["".join(rng.choice(list("abcdéö"), int(rng.integers(4, 12)))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "bababab"]
    rows = []
    for i in range(300):
        out = []
        for w in rng.choice(stems, 40):
            if rng.random() < 0.3:
                at = int(rng.integers(0, len(w)))
                w = [w[:at] + w[at + 1:], w[:at] + "c" + w[at:], w[:at] + "e" + w[at + 1:]][int(rng.integers(0, 3))]
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i if i % 50 else None, " ".join(out), "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, word string")


@pytest.mark.parametrize("key_words", [100_000, 5])
def test_variants_equal_brute_force(documents, misspelt, no_documents, key_words, monkeypatch):
    monkeypatch.setattr(variants, "KEY_WORDS", key_words)
    monkeypatch.setattr(variants, "SIDE_BY_SIDE", 50)
    for docs in (documents, misspelt):
        got = rows_of(variants.group_variants(docs), "word", "form", "root", "n", "n_near", "form_n")
        assert got == plain_variants(docs) and got
    assert variants.group_variants(no_documents).count() == 0


# ---- lexical search

def plain_ranking(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    counts = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        wanted = Counter(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c)
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item_id, i + 1, d, s) for i, (s, d) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [lexical.ITEM_BYTES, 60])
def test_ranking_equals_scoring_all(spark, documents, no_documents, block_bytes, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 7)
    texts = [(1, sentence(1, 12)), (2, sentence(5, 30) + " ÜNÏCÖDÉ ünïcödé"), (2, "only four words"), (3, None), (4, ""), (None, "text without an id"), (5, "nothing of that kind"),
             (6, "only ONLY only four"), (6, "only ONLY only four"), (7, sentence(3, 50))]
    items = spark.createDataFrame([(*t, 1) for t in texts], "item_id long, text string, doc_id int").coalesce(1)
    got = lexical.top_documents(documents, items, 5, block_bytes)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == plain_ranking([(r.doc_id, r.text) for r in documents.collect()], texts, 5)
    assert lexical.top_documents(no_documents, items).count() == 0 and lexical.top_documents(documents, items.limit(0)).count() == 0


def test_very_long_texts_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa
    text = ("é" * 70 + " ab AB,b " * 40 + "x" * 300) * 3
    vocabulary = np.unique(lexical._parsed([type("R", (), {"text": "ab b " + "é" * 70, "item_id": 1})()])[0])

    def all_counts() -> list:
        return [[x.tolist() if hasattr(x, "tolist") else x for x in part] for part in lexical.term_counts(pa.array([text, None, "b"]), vocabulary)]

    whole = all_counts()
    monkeypatch.setattr(lexical, "SLICE", 100)
    monkeypatch.setattr("riskloom.llm.hashing.SLICE", 100)
    pieces = [p for p in all_counts()]
    assert [p[2] for p in pieces][0][0] == whole[0][2][0] == len(TERM.findall(text))
    assert sum((p[5] for p in pieces), []) == whole[0][5]

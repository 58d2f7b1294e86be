"""Encoding, language, personal data, toxicity, resampling and mixing against plain computations."""
from __future__ import annotations

import hashlib
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import bpe, langid, mixing, pii, resampling, toxicity
from riskloom.llm.queries import TOKENIZERS
from tests.llm.conftest import WORD, rows_of, sentence

BYTE_BPE, PIECES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no vocabulary files")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoding_equals_the_library(documents, no_documents):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BYTE_BPE)
    want = []
    for r in documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), tuple(ids)))
    got = bpe.encode_documents(documents, BYTE_BPE, keep_ids=True, keep_text=True)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.token_ids)) for r in got.collect()), key=str) == sorted(want, key=str)
    assert {r.decoded for r in got.collect()} == {r.text or "" for r in documents.collect()}
    assert bpe.encode_documents(no_documents, BYTE_BPE).count() == 0


def test_automaton_on_small_vocabularies_equals_merging_by_rank(tmp_path):
    """Every string over a small alphabet; merges of equal halves and of overlapping pairs among them."""
    import itertools
    import json
    merges = [("a", "b"), ("a", "a"), ("aa", "b"), ("b", "c"), ("ab", "ab"), ("c", "c"), ("aa", "aa"), ("cc", "a")]
    names = [chr(b) for b in range(0x21, 0x7F)]
    byte_names = {v: k for k, v in bpe.printable_bytes().items()}
    vocab = {byte_names[b]: b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": [" ".join(m) for m in merges]}}))
    automaton = bpe.compile_merges(str(path))
    rank = {m: i for i, m in enumerate(merges)}

    def by_rank(word: str) -> list[int]:
        parts = list(word)
        while True:
            best = min((p for p in zip(parts, parts[1:], strict=False) if p in rank), key=rank.get, default=None)
            if best is None:
                return [vocab[p] for p in parts]
            at, out = 0, []
            while at < len(parts):
                hit = tuple(parts[at:at + 2]) == best
                out.append("".join(best) if hit else parts[at])
                at += 1 + hit
            parts = out

    words = ["".join(w) for n in range(1, 8) for w in itertools.product("abc", repeat=n)]
    assert names and [automaton.encode_word(w.encode()) for w in words] == [by_rank(w) for w in words]
    assert automaton.encode_words([w.encode() for w in words]) == [by_rank(w) for w in words]


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["", "▁", "a", "b", "ab", "▁a", "bab", "ba"])
    probs = np.random.default_rng(1).dirichlet(np.ones(8), 2).T

    def brute(text: str, lang: int) -> float:
        if not text:
            return 1.0
        known = [i for i, p in enumerate(pieces.names) if p and text.startswith(p)]
        total = sum(probs[i, lang] * brute(text[len(pieces.names[i]):], lang) for i in known)
        return total if any(len(pieces.names[i]) == 1 for i in known) else total + probs[0, lang] * brute(text[1:], lang)

    parts = ["▁abab", "▁a", "▁xab", "b", "▁babbab"]
    logs = langid.forward(pieces.lattice(parts), probs)
    assert np.allclose(np.exp(logs), [[brute(p, g) for g in range(2)] for p in parts])
    # expected counts: each string uses its pieces as its segmentations' shares say; lengths add up
    langs, counts = np.array([0, 1, 0, 1, 0]), np.array([1.0, 2, 3, 1, 5])
    used = langid.expected_counts(pieces.lattice(parts), langs, counts, probs)
    sizes = np.array([1, *map(len, pieces.names[1:])])
    assert np.isclose((used * sizes[:, None]).sum(), sum(len(p) * c for p, c in zip(parts, counts, strict=True)))


def test_language_is_learned_from_the_other_folds_only(spark, documents, no_documents):
    english = "the rain falls on the old town and nobody minds it much".split()
    german = "der regen fällt auf die alte stadt und niemanden stört das sehr".split()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(english if i % 2 else german, 12)), "en" if i % 2 else "de", "s") for i in range(400)]
    rows += [(1000, None, "en", "s"), (1001, "123 !!", "en", "s"), (1002, "", None, "s"), (None, "der alte regen", None, "s"), (1003, "the rain " * 9000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.doc_id, r.text): r for r in langid.identify(docs, PIECES).collect()}
    assert len(got) == len(rows)
    import zlib
    for (i, text), r in got.items():
        assert r.held_out == (zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2) and 0 <= r.score <= 1
        if i is not None and i < 400:
            assert r.lang_pred == r.lang
    assert [got[i, t].lang_pred for i, t in ((1000, None), (1001, "123 !!"), (1002, ""), (None, "der alte regen"))] == ["und", "und", "und", "de"]
    assert got[1003, "the rain " * 9000].lang_pred == "en"
    flipped = docs.withColumn("lang", __import__("pyspark").sql.functions.when(langid.held_out(docs.doc_id), "zz").otherwise(docs.lang))
    again = langid.identify(flipped, PIECES)
    assert rows_of(again, "doc_id", "lang_pred", "score") == rows_of(langid.identify(docs, PIECES), "doc_id", "lang_pred", "score")
    assert langid.identify(no_documents, PIECES).count() == 0
    assert langid.identify(documents, PIECES).count() == documents.count()


def test_every_language_is_learned_in_any_blocks(spark, monkeypatch):
    letters = "abcdefghijklmnopqr"
    words = {f"l{i:03d}": f"{letters[i // 18] * 3}{letters[i % 18] * 4}" for i in range(300)}
    rows = [(100 * i + k, lang, f"{word} {word} {word} {word}") for i, (lang, word) in enumerate(words.items()) for k in range(8 if i < 290 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    monkeypatch.setattr(langid, "ROUNDS", 1)
    labelled = docs.filter(~langid.held_out(docs.doc_id))
    got = {}
    for block, cells in ((128, 300), (1000, langid.CELLS)):  # a text in parts of two words, and all at once
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "CELLS", cells)
        model = langid.learn(labelled, PIECES)
        assert [x for b in model for x in b.langs] == sorted(words)
        got[block] = list(langid.Scorer(langid.read_pieces(PIECES).names, model).predict([f"{w} {w} {w} {w}" for w in words.values()] + [None, "12"]))
    assert [x for x, _ in got[128]] == [*words, "und", "und"] == [x for x, _ in got[1000]]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[128], got[1000], strict=True))


def test_surrogates_are_distinct_consistent_and_formatted(spark, documents, no_documents):
    rows = [(i, f"Call +1 ({200 + i}) 555-01{i:02d} or u{i}@mail.example.com, card 4111 1111 1111 1111.") for i in range(40)]
    rows += [(100, "Ms Ann Lee wrote. Later Lee left; Herr Braun saw LEE@X.EXAMPLE.COM!! and lee@x.example.com."), (101, "Госпожа Иванова пришла"),
             (102, 'token = "5AAD00685ACCEFDD91653537B82AD0DAB34E35E3" ip 10.20.30.40 ssn 123-45-6789'), (103, None), (104, "nothing"), (104, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id): r for r in pii.replace(docs).collect()}
    phones, mails = set(), set()
    for i in range(40):
        found = pii.entities(got[i].text)
        assert [k for _, _, k, _ in found] == ["phone", "email", "card"] and got[i].n_replaced == 3
        assert not {c for _, _, _, c in found} & {c for _, _, _, c in pii.entities(rows[i][1])}
        phones.add(found[0][3])
        mails.add(found[1][3])
        assert pii.luhn(found[2][3]) == 0 and found[2][3] == pii.entities(got[0].text)[2][3]  # one card, one surrogate
    assert len(phones) == len(mails) == 40
    a = got[100].text
    first, last = a.split()[1], a.split()[2]
    assert first != "Ann" and last != "Lee" and f"Later {last} left" in a and first[-1] == "a"
    mail = [c for _, _, k, c in pii.entities(a) if k == "email"]
    assert mail[0] == mail[1] and mail[0].upper() in a and mail[0] in a
    assert "Иванова" not in got[101].text and pii.script(got[101].text.split()[1]) == "cyrillic"
    assert got[102].text.isascii() and "5AAD" not in got[102].text and got[102].text[9:49] == got[102].text[9:49].upper()
    assert got[103].text is None and got[104].text == "nothing"
    assert pii.replace(docs.filter("doc_id < 0")).count() == 0
    assert rows_of(pii.replace(documents), "doc_id").__len__() == documents.count() and pii.replace(no_documents).count() == 0


def test_entities_are_found_whole_in_every_spelling(spark):
    long = "aB3xQ7" * 40
    cases = [
        (f"token={long} end", {"aB3xQ7"}), ("Call +٩٦٦ ٥٠١ ٢٣٤ ٥٦٧ now", {"٥٠١ ٢٣٤"}), ("access_token=abcdef123456", {"abcdef123456"}),
        ("client_secret: 'qwertyuiopas'", {"qwertyuiopas"}), ("DB_PASSWORD=zxcvbnmasdfgh", {"zxcvbnmasdfgh"}), ("appToken=abcdefabcdef", {"abcdefabcdef"}),
        ("AWS_SECRET_ACCESS_KEY=abcdabcdabcd", {"abcdabcdabcd"}), ("host dead:beef::cafe up", {"dead", "beef", "cafe"}), ("addr:2001:DB8::ff/64: no", {"DB8"}),
        ("see ::ffff:192.0.2.177", {"192", "177"}), ("Ms Ann Maria Lee Smith came; Smith and Maria left", {"Ann", "Maria", "Lee", "Smith"}),
        ("Mr McDonald met Frau Anne-Marie-Luise O’Brien", {"Donald", "Anne", "Luise", "Brien"}), (f"{'verylong' * 20}@mail.com wrote", {"verylong"}),
        ("mail k@aa.bb.cc.dd.ee.ff.gg.hh.ii", {"hh", "ii"}), ("token=abcdefghijkl.foo@bar.com", {"abcdefghijkl", "foo", "bar"}),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(docs).collect()}
    for i, (text, private) in enumerate(cases):
        assert got[i].n_replaced and not [w for w in private if w in got[i].text], (text, got[i].text)
    assert got[0].text[6:-4].isalnum() and len(got[0].text) == len(cases[0][0]) and got[0].text.endswith(" end")
    assert [k for *_, k, _ in pii.entities(got[1].text)] == ["phone"] and got[1].text[5:].strip("+ now").replace(" ", "").isdecimal() and not any(c in got[1].text for c in "0123456789")
    plain = "std::vector at 12:30:45, x :: y, 1:2:3:4:5:6:7:8:9"
    assert pii.entities(plain) == []
    spellings = ["2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:0db8:0000:0000:0000:0000:0000:0001"]
    assert len({pii.entities(t)[0][2:] for t in spellings}) == 1
    for attempt in (0, 5, 17):
        new = pii.surrogate("ipv6", "2001:db8::1", attempt, b"k")
        assert {pii.entities(pii.lay("ipv6", new, t))[0][3] for t in spellings} == {new}


def test_colliding_draws_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda kind, canon, attempt, key: str(int(canon) // 2 + attempt))
    found = spark.createDataFrame([("ssn", str(i)) for i in range(10, 16)], "kind string, canon string")
    got = {r.canon: r.surrogate for r in pii.assign(found.coalesce(1), "k").collect()}
    assert len(set(got.values())) == 6 and not set(got.values()) & set(got)


def test_toxicity_chain_follows_planted_words(spark, documents, no_documents):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        rude, low = rng.random() < 0.2, rng.random() < 0.3
        text = sentence(int(rng.integers(50)), 30) + (" scoundrel rascal" if rude else "") + (" zzz" if low else "")
        rows.append((i, text, 5))
        if i < 500:
            labels.append((i, int(low), int(rude)))
    rows += [(1000, None, 1), (1001, "", 1), (None, "rascal scoundrel", 1), (599, rows[599][1], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("toxic")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], "doc_id long, low int, rude int")
    chain = toxicity.learn(docs, marks, ["low", "rude"])
    got = chain.predict(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.toxic == ("rascal" in (r.text or "")) and 0 <= r.p_low <= 1
    assert len(chain.links[1].weights) == len(chain.links[0].weights) + 1  # the chain's extra input
    assert chain.predict(docs.limit(0)).count() == 0
    empty = toxicity.learn(no_documents, marks.limit(0), ["low", "rude"])
    assert {(r.p_rude, r.toxic) for r in empty.predict(documents).collect()} == {(0.0, False)}


def test_resampling_prefers_the_target_and_keeps_exactly_k(spark, documents, no_documents):
    rows = [(i, sentence(i % 9, 40) if i % 4 else "QQ!! ZZ!! " * 20, "a") for i in range(400)] + [(None, None, "b"), (1000, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    target = docs.filter("doc_id % 8 IN (1, 2, 3)").select("doc_id")
    got = resampling.resample(docs, target, 0.7).collect()
    kept = [r for r in got if r.kept]
    assert len(got) == len(rows) and len(kept) == round(0.7 * len(rows)) and not any(r.doc_id and r.doc_id < 400 and r.doc_id % 4 == 0 for r in kept)
    low = min(r.gumbel_key for r in kept)
    assert all(r.gumbel_key <= low for r in got if not r.kept)
    for r in got:
        if not rows_text(rows, r.doc_id):
            assert r.log_weight == 0 and r.n_grams == 0
    assert resampling.resample(no_documents, target, 0.5).count() == 0
    assert resampling.resample(documents, target.limit(0), 0.5).filter("log_weight <> 0").count() == 0


def rows_text(rows, doc_id):
    return next(t for i, t, _ in rows if i == doc_id)


def test_mix_meets_its_targets_and_the_sql(spark, documents, no_documents, tmp_path):
    import duckdb
    many = documents.unionByName(documents.sparkSession.createDataFrame(
        [(5000 + i, sentence(i % 17, 3 + i * i % 90), "en", f"s{i % 5}" if i % 7 else None, 1, 1.0, "x") for i in range(900)], documents.schema))
    got = mixing.mix(many)
    path = str(tmp_path / "d.parquet")
    many.write.parquet(path)
    want = duckdb.sql(f"WITH {mixing.mix_sql(chr(34) + 'd' + chr(34)).strip()} SELECT doc_id, size, source_size, round(target, 6), taken FROM mixed".replace(
        '"d"', f"'{path}/*.parquet'")).fetchall()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect()), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got.collect():
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        by[r.source].append(r)
    total = sum(v[0].source_size for v in by.values())
    assert math.isclose(sum(v[0].target for v in by.values()), total)
    for v in by.values():
        near = min((r["size"] for r in v if r["size"]), default=0)
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(near, 0.05 * v[0].target, 120)
    assert mixing.mix(no_documents).count() == 0
    assert Counter(rows_of(got, "doc_id", "taken")) == Counter(rows_of(mixing.mix(many.repartition(7)), "doc_id", "taken"))


def test_repeated_rows_are_mixed_by_number(spark, tmp_path):
    """Rows that agree in id, size and source fill a target one by one; texts may differ or not."""
    import duckdb
    rows = [(None, f"{'same' if i % 3 else i} b c", "s1") for i in range(1000)] + [(7, "x y z", "s2")] * 500 + [(i, "w " * (i % 9 + 1), "s3") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == 1800 and all(abs(taken[r.source] - r.target) <= 3 for r in got if r.source != "s3")
    path = str(tmp_path / "d.parquet")
    docs.write.parquet(path)
    want = duckdb.sql(f"WITH {mixing.mix_sql(chr(34) + 'd' + chr(34)).strip()} SELECT doc_id, size, source_size, round(target, 6), taken FROM mixed".replace('"d"', f"'{path}/*.parquet'")).fetchall()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == Counter(want)


def test_surrogates_of_a_small_space_stay_distinct(spark):
    """676 addresses of one letter each side, at two hosts each: more entities than such addresses."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = spark.createDataFrame([("email", f"{x}@{y}.{end}") for x in letters for y in letters for end in ("com", "net")] + [("phone", f"{i:05d}") for i in range(300)], "kind string, canon string")
    got = pii.assign(found, "key").collect()
    assert len(got) == 1652 and len({(r.kind, r.surrogate) for r in got}) == 1652
    assert not {r.surrogate for r in got} & {r.canon for r in got}
    assert pii.lay("phone", "123456", "12-345") == "12-3456" and pii.lay("secret", "abcdX", "ABcd") == "ABcdX"


def test_targets_share_by_weight_up_to_three_sizes(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 40), (None, 500), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    want, size = {s: 0.0 for s in ("a", "b", "c", "z", None)}, {"a": 10, "b": 1000, "c": 40, "z": 0, None: 500}
    weight = {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}
    left, open_ = float(sum(size.values())), set(want)
    while left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            want[s] += share * weight[s]
            if want[s] >= 3 * size[s]:
                left += want[s] - 3 * size[s]
                want[s] = 3.0 * size[s]
                open_.discard(s)
    assert got == pytest.approx(want)

from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = "ab cd ef gh ij kl mn op qr st uv wx yz ba dc fe hg ji lk nm po rq ts vu xw zy".split()


def sentence(start: int, n: int) -> str:
    return " ".join(TEXT[(start + k * (1 + start % 3)) % len(TEXT)] + str((start + k) % 7) for k in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in each column, empty and very long texts, copies, near copies, repeated rows and a clashing extra column."""
    base = sentence(1, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " one more", "en", "b"), (4, "x " + base, "de", None), (5, base.upper(), "en", "b"),
        (6, None, None, "a"), (7, "", "en", "c"), (8, " \t\n", "fr", "c"), (9, "only four words here", "en", "a"), (10, "only four words here", "en", "a"),
        (10, "only four words here", "en", "a"), (None, base, "en", "a"), (None, "a text without an id at all but of seven words", None, None),
        (11, sentence(5, 6000), "de", "z"), (12, "é" * 900 + " ünïcödé 日本語 🙂 " * 30, "xx", "日本"), (13, sentence(2, 90) + " " + base[:420], "en", "b"),
        (14, "12345 !!! ???", "en", "c"), (15, sentence(7, 119), "fr", "a"), (16, " ".join(sentence(7, 119).split()[:-4]), "fr", "a"),
        (17, "aaaa" * 400, "en", "c"), (18, "<|endoftext|> it's <|endoftext|>", "en", "c"), (19, "Mail Ann.Lee@mail3.example.com or +1 (234) 555-0199", "en", "b"),
    ]
    rows += [(100 + i, sentence(3, 100 + i % 4), "en", "hot") for i in range(24)]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1.0, "x") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, class string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)

"""Byte-pair encoding by a deterministic automaton over tokens.

`compile_merges` builds the automaton that accepts exactly the right token sequences. It starts with one state that reads every byte. Each
merge (u, v) -> w, in order, inserts a gadget: wherever u and then v could be read, w can be read as well and leads to where v led; and u now
leads to a copy of its state in which v can't be read. All arcs of a token lead to one state, and tokens read from the same states share a
column, so the automaton is a bit table: a row for each state, a column for each class of tokens.

A pre-split word is encoded by following token arcs from every reached byte position; since every string has exactly one right sequence, every
position is reached at most once. Decoding concatenates the arcs' labels and reads them as UTF-8.

Words repeat, so each task keeps the sequences of up to `CACHE` short words; the new short words of a slice of texts are encoded together, one
array step for each (start, length). Memory is bounded by an Arrow batch, a slice and the cache.

Defined results: a null text counts as empty: no tokens, the digest of the empty string twice. Repeated rows are encoded each; an empty
table gives an empty table; further columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.memory import release, tidy
from riskloom.llm.tries import Trie

CACHE = 150_000
#: Words up to this many bytes are kept in the cache.
SHORT = 32
#: Texts are encoded in slices of about this many characters.
SLICE = 500_000
#: How the vocabulary file splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that the splitting library does not count as letters or as numbers, since its Unicode version is older.
NOT_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2
1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F""".split()
NOT_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6".split()


def split_pattern(exact: bool) -> regex.Pattern:
    """The splitting pattern; `exact` leaves the newer letters and numbers out, which text in Latin-1 cannot hold."""
    if not exact:
        return regex.compile(SPLIT)
    less = {c: f"[\\p{{{c}}}--[" + "".join("-".join(f"\\U{x:0>8}" for x in r.split("-")) for r in out) + "]]"
            for c, out in (("L", NOT_LETTERS), ("N", NOT_NUMBERS))}
    letters, numbers = less["L"], less["N"]
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")


def printable_bytes() -> dict[str, int]:
    """The vocabulary file writes bytes as characters: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Automaton:
    labels: list[bytes]
    special: dict[str, int]
    row: np.ndarray      #: state that a token's arcs lead to
    column: np.ndarray   #: class of a token
    table: np.ndarray    #: packed bits, states by classes; state 0 is the start

    @cached_property
    def _rows(self) -> list[bytes]:
        return [r.tobytes() for r in self.table]

    @cached_property
    def _arcs(self) -> tuple[list[int], list[int], list[int]]:
        """State, byte of the table's row and bit in it, by token."""
        return self.row.tolist(), (self.column >> 3).tolist(), (128 >> (self.column & 7)).tolist()

    @cached_property
    def _trie(self) -> dict:
        """Nested tables by byte; at -1 the token that ends there."""
        root: dict = {}
        for token, label in enumerate(self.labels):
            if token in self._merged:
                node = root
                for b in label:
                    node = node.setdefault(b, {})
                node[-1] = token
        return root

    @cached_property
    def _merged(self) -> set[int]:
        return set(range(len(self.labels))) - set(self.special.values())

    def encode_word(self, word: bytes) -> list[int]:
        rows, (to, at, bit), trie, n = self._rows, self._arcs, self._trie, len(word)
        state, arc = [-1] * (n + 1), [0] * (n + 1)
        state[0] = 0
        for i in range(n):
            if state[i] < 0:
                continue
            allowed, node = rows[state[i]], trie
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and allowed[at[token]] & bit[token]:
                    state[j + 1], arc[j + 1] = to[token], token
        out = []
        while n:
            out.append(arc[n])
            n -= len(self.labels[arc[n]])
        return out[::-1]

    @cached_property
    def _many(self) -> Trie:
        return Trie((label, token) for token, label in enumerate(self.labels) if token in self._merged)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """As `encode_word`, for many short words at once."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = int(n.max(initial=0))
        chars = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)
        state, arc = np.full((len(words), width + 1), -1, np.int32), np.zeros((len(words), width + 1), np.int32)
        state[:, 0] = 0
        for i in range(width):
            for end, w, token in self._many.matches(chars, n, i, np.flatnonzero(state[:, i] >= 0)):
                c = self.column[token]
                ok = (self.table[state[w, i], c >> 3] >> (7 - (c & 7))) & 1 == 1
                state[w[ok], end], arc[w[ok], end] = self.row[token[ok]], token[ok]
        out, sizes = [], self._sizes
        for end, back in zip(n.tolist(), arc.tolist(), strict=True):
            ids = []
            while end:
                ids.append(back[end])
                end -= sizes[back[end]]
            out.append(ids[::-1])
        return out

    @cached_property
    def _sizes(self) -> list[int]:
        return list(map(len, self.labels))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


def compile_merges(path: str) -> Automaton:
    """Automaton of a byte-level vocabulary file (JSON with vocabulary, merges and added tokens)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = printable_bytes()
    vocab: dict[str, int] = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = max([*vocab.values(), *special.values()]) + 1
    labels = [b""] * n
    for text, token in vocab.items():
        labels[token] = bytes(to_byte[c] for c in text) if text not in special else text.encode()
    for text, token in special.items():
        labels[token] = text.encode()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]

    allowed = np.zeros((4096, 512), np.uint8)
    row, column = np.zeros(n, np.int64), np.ones(n, np.int64)  # class 1: tokens that are never read
    for c, b in to_byte.items():
        column[vocab[c]] = 0
    row_users, column_users = [257], [256, n]  # the start uses row 0 too
    allowed[0, 0] = 1
    for u, v, w in pairs:
        if not allowed[row[u], column[v]]:
            continue
        row[w] = row[v]
        row_users[row[v]] += 1
        if u != v:
            column[w] = column[u]
            column_users[column[u]] += 1
        more = [step if len(users) == size else 0 for users, size, step in zip((row_users, column_users), allowed.shape, (4096, 512), strict=True)]
        if any(more):
            allowed = np.pad(allowed, [(0, m) for m in more])
        if row_users[row[u]] > 1:
            row_users[row[u]] -= 1
            row_users.append(1)
            allowed[len(row_users) - 1] = allowed[row[u]]
            row[u] = len(row_users) - 1
        if column_users[column[v]] > 1:
            column_users[column[v]] -= 1
            column_users.append(1)
            allowed[:, len(column_users) - 1] = allowed[:, column[v]]
            column[v] = len(column_users) - 1
        allowed[row[u], column[v]] = 0
        if u == v:  # of three in a row the first two merge: w after u is no right sequence, u after w is
            column[w] = column[u]
            column_users[column[u]] += 1
    return Automaton(labels, special, row, column, np.packbits(allowed[:len(row_users), :len(column_users)], axis=1))


@lru_cache(maxsize=2)
def compiled(path: str, version: int) -> Automaton:
    """The automaton of a file as of `version`: compiled once a process, whose leftovers go back to the system."""
    automaton = compile_merges(path)
    release()
    return automaton


class Encoder:
    """Whole texts: special tokens, splitting into words, and the cache of words."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.split, self.exact_split = split_pattern(False), split_pattern(True)
        names = sorted(automaton.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cache: dict[str, list[int]] = {}

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.split.findall(text)
        except UnicodeEncodeError:
            return self.exact_split.findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens."""
        if self.specials is None or not self.specials.search(text):
            return self.words(text)
        special, out = self.automaton.special, []
        for part in self.specials.split(text):
            if part in special:
                out.append(special[part])
            else:
                out += self.words(part)
        return out

    def learn(self, words: set[str]) -> dict[str, list[int]]:
        """Sequences of all these words; short ones stay in the cache."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = [w for w in words if w not in cache]
        as_bytes = [w.encode() for w in new]
        rest: dict[str, list[int]] = {}
        by_size = sorted(range(len(new)), key=lambda i: len(as_bytes[i]))
        short = [i for i in by_size if len(as_bytes[i]) <= SHORT]
        for k in range(0, len(short), 8192):
            part = short[k:k + 8192]
            for i, ids in zip(part, self.automaton.encode_words([as_bytes[i] for i in part]), strict=True):
                cache[new[i]] = ids
        for i in by_size[len(short):]:
            rest[new[i]] = self.automaton.encode_word(as_bytes[i])
        return rest

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            split = [self.pieces(t) for t in texts[at:end]]
            rest = self.learn({w for ws in split for w in ws if w.__class__ is str})
            get = self.cache.get
            for words in split:
                out: list[int] = []
                for w in words:
                    ids = get(w)
                    out += ids if ids is not None else [w] if w.__class__ is int else rest[w]
                yield out
            at = end


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256; on demand the token ids and the decoded text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(compiled(path, os.stat(path).st_mtime_ns))  # fixed by the vocabulary: a few MB
    schema = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
              + ", token_ids array<int>" * keep_ids + ", decoded string" * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        names = [str(i) for i in range(len(encoder.automaton.labels))]
        for batch in batches:
            rows = []
            for ids in encoder.encode([t or "" for t in batch.column("text").to_pylist()]):
                decoded = encoder.automaton.decode(ids)
                rows.append((len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(),
                             hashlib.sha256(decoded.encode()).hexdigest(), ids if keep_ids else None, decoded if keep_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            out = [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            if keep_ids:
                out.append(pa.array(cols[3], pa.list_(pa.int32())))
            if keep_text:
                out.append(pa.array(cols[4], pa.string()))
            yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)

"""Surrogates for personal data: each detected entity gets a keyed replacement of its own type, gender, script and format.

1. Detect: patterns find e-mail and network addresses, phone, card, account and social-security numbers, secrets, and names after a title.
   Each has a canonical form, so that its spellings in all documents corefer. A name's parts, however many, are entities of their own:
   "Ms Ann Lee" and a later "Lee" agree. Secrets, e-mail addresses and names are matched to their end at any length.
2. Assign: distinct entities draw surrogates from a keyed digest of (kind, canonical form, attempt). A draw is accepted if it is no detected
   entity, no surrogate accepted earlier and, of equal draws, the first entity's; the others draw again. So surrogates are distinct.
3. Rewrite: the surrogate is laid into each occurrence's format (separators, letter case, digits by position).

Draws are shuffled as rows (kind, canonical form), never texts. The surrogates of a text's entities are joined by a hash of the text: broadcast
when their counted size is small, shuffled otherwise.

Defined results: null texts stay null, texts without entities stay as they are, repeated rows get equal texts, an empty table gives an empty
table. Further columns pass through.
"""
from __future__ import annotations

import hashlib
import hmac
import ipaddress
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from riskloom.llm.memory import tidy
from riskloom.session import stage

#: Measured size up to which the joined surrogates may be broadcast; entities may have any length.
BROADCAST_BYTES = 16 << 20
#: Between the groups of a phone number, documents may hold table bars or runs of marks.
GAP = r"[\s|*#$%&!]{0,6}"
TITLES = {  # title -> gender
    "mr": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "madame": "f", "mme": "f", "госпожа": "f", "dr": "n", "prof": "n",
}
NAME = r"\p{Lu}[\p{Ll}\p{M}'’][\p{L}\p{M}'’]*(?:-\p{Lu}[\p{L}\p{M}'’]+)*"
HEX = r"[0-9A-Fa-f]{1,4}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
DOTTED = rf"(?:{OCTET}\.){{3}}{OCTET}"
#: An e-mail address starts where its run of characters does, or after the entity before it: long runs are read once. A secret's keyword may have
#: a prefix (access_token, dbPassword).
PATTERN = regex.compile(rf"""
 (?P<email>(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]++(?:\.[\w-]++)+)
|(?P<secret>(?i:(?:token|api[_-]?key|secret(?:[_-](?:access[_-]?)?key)?|password|passwd)\b){GAP}[:=]{GAP}["']?(?P<value>[A-Za-z0-9+/_-]{{12,}}))
|(?P<ipv6>(?<!\w)(?<![0-9A-Fa-f:]:)(?:(?:{HEX}:){{6}}(?:{DOTTED}|{HEX}:{HEX})|(?:{HEX}(?::{HEX})*+)?+::(?:(?:{HEX}:)*{DOTTED}|(?:{HEX}(?::{HEX})*)?))(?!\w|:[\w:]|\.\d))
|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
|(?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
|(?P<phone>(?<![\w+])(?:\+\d{{1,3}}{GAP})?\(\d{{2,4}}\){GAP}\d{{3,4}}[ .-]?\d{{3,4}}\b
   |(?<![\w+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,5}}\b
   |(?<![\w+.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}\b)
|(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
|(?P<card>(?<![\w-])\d(?:[ -]?\d){{12,18}}(?!\w))
|(?P<name>\b(?P<title>(?i:{"|".join(TITLES)}))\b\.?[ ](?P<first>{NAME})(?:[ ](?P<last>{NAME}))*)
""", regex.VERBOSE)
#: A text without any of these holds no entity but a name.
HINT = regex.compile(r"[\d@]|::|(?:[A-Fa-f]{1,4}:){7}|(?i:token|api.?key|secret|passw)")
TITLE = regex.compile(rf"\b(?i:{'|'.join(TITLES)})\b\.? \p{{Lu}}")


def script(word: str) -> str:
    return "cyrillic" if regex.search(r"\p{Cyrillic}", word) else "greek" if regex.search(r"\p{Greek}", word) else "latin"


SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бо ва ве да де ди до за зе ка ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се со та те то".split(),
    "greek": "βα βο γα γε δα δε δι δο θα θε κα κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε τα τε το".split(),
}
ENDINGS = {
    "latin": {"m": ["rt", "n", "ld", "s"], "f": ["na", "lia", "ra", "sa"], "n": ["n", "l", "r"], "last": ["son", "mann", "ier", "ez", "er", "rd"]},
    "cyrillic": {"m": ["н", "р", "л", "с"], "f": ["на", "ра", "лия"], "n": ["н", "л"], "last": ["ов", "ев", "ин", "ко"]},
    "greek": {"m": ["ς", "ων"], "f": ["να", "ια"], "n": ["ν", "ς"], "last": ["ου", "ης", "ας"]},
}


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity, in order, without overlaps."""
    if not HINT.search(text) and not TITLE.search(text):
        return []
    out, names = [], {}
    for m in PATTERN.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("value", "title", "first", "last") else None
        kind = kind or ("secret" if m["secret"] else "name")
        if kind == "name":
            gender = TITLES[m["title"].lower()]
            for i, (start, end) in enumerate([m.span("first"), *m.spans("last")]):
                part = text[start:end]
                label = f"name:{gender if i == 0 and m['last'] else 'last'}:{script(part)}"
                out.append((start, end, label, part.casefold()))
                names[part] = (label, part.casefold())
        elif kind == "secret":
            out.append((*m.span("value"), kind, m["value"].lower()))
        elif kind in ("phone", "card", "ssn"):
            out.append((*m.span(), kind, "".join(str(unicodedata.decimal(c)) for c in m[0] if c.isdecimal())))
        elif kind == "ipv6":
            try:
                address = ipaddress.IPv6Address(m[0])
            except ValueError:  # too many groups
                continue
            if int(address):
                out.append((*m.span(), kind, address.compressed))
        else:
            out.append((*m.span(), kind, m[0].replace(" ", "").lower()))
    if names:  # later mentions of a titled name
        taken = [(s, e) for s, e, _, _ in out]
        for m in regex.finditer(r"\b(?:" + "|".join(map(regex.escape, sorted(names, key=len, reverse=True))) + r")\b", text):
            if not any(s < m.end() and m.start() < e for s, e in taken):
                out.append((*m.span(), *names[m[0]]))
    return sorted(out)


class Draw:
    """A stream of numbers from a keyed digest."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.pool = key, "\x1f".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + b"\x1f" + str(self.n).encode(), hashlib.sha256).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def groups_of(address: str) -> list[int]:
    number = int(ipaddress.IPv6Address(address))
    return [number >> shift & 0xFFFF for shift in range(112, -1, -16)]


def same_shape(text: str, draw: Draw, hexadecimal: bool = False) -> str:
    """Digits for digits, letters for letters, all else as it is."""
    letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
    return "".join("0123456789"[draw.below(10)] if c.isdigit() else letters[draw.below(len(letters))] if c.isalpha() else c for c in text)


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """The canonical form of the replacement that an entity draws at an attempt."""
    draw = Draw(key, kind, canon, str(attempt))
    longer = max(0, attempt - 8) // 4  # a shape that keeps colliding grows, so that there is always room
    if kind == "email":
        local, _, domain = canon.partition("@")
        local += "a" * longer
        host = domain.split(".")[0]
        return f"{same_shape(local, draw)}@{same_shape(host, draw)}.example.com"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "secret":
        return same_shape(canon + "a" * longer, draw, all(c in "0123456789abcdef" for c in canon))
    if kind == "ipv6":  # zero groups stay and the others keep their digits; after some collisions, neither
        new = []
        for group in groups_of(canon):
            size = min(4, len(f"{group:x}") + attempt // 4)
            low = 16 ** (size - 1)
            new.append(low + draw.below(16 ** size - low) if group or attempt >= 16 else 0)
        return ipaddress.IPv6Address(":".join(f"{x:x}" for x in new)).compressed
    if kind == "iban":
        return canon[:2] + same_shape(canon[2:], draw)
    if kind == "card":
        body = canon[0] + same_shape(canon[1:-1], draw)
        if luhn(canon):
            return body + same_shape(canon[-1], draw)
        return body + next(c for c in "0123456789" if luhn(body + c) == 0)
    if kind == "phone":
        country = len(canon) - 10 if len(canon) > 10 else 0
        return canon[:country] + same_shape(canon[country:] + "0" * longer, draw)
    if kind == "ssn":
        return same_shape(canon, draw)
    _, role, writing = kind.split(":")
    syllables, endings = SYLLABLES[writing], ENDINGS[writing][role]
    n = 2 + attempt // 4
    return "".join(syllables[draw.below(len(syllables))] for _ in range(n)) + endings[draw.below(len(endings))]


def lay_ipv6(new: list[int], old: str) -> str:
    """The groups written as in `old`: gap, zeros in front, dotted end and letter case; in full where the gap would hide one."""
    front, gap, back = old.partition("::")
    dotted = "." in old
    before = [g for g in front.split(":") if g]
    after = [g for g in back.split(":") if g]
    last = after if gap else before
    if dotted:
        last[-1:] = ["", ""]  # two groups
    if gap and any(new[len(before):8 - len(after)]):
        before, gap, after = [""] * 8, "", []
    texts = [f"{x:0{len(g) or 1}x}" for x, g in zip(new, before, strict=False)], [f"{x:0{len(g) or 1}x}" for x, g in zip(new[8 - len(after):], after, strict=True)]
    if dotted:
        end = texts[1] if gap else texts[0]
        end[-2:] = [".".join(str(b) for x in new[-2:] for b in divmod(x, 256))]
    out = ":".join(texts[0]) + gap + ":".join(texts[1])
    return out.upper() if any(c.isupper() for c in old) else out


def lay(kind: str, new: str, old: str) -> str:
    """The canonical replacement in the format of an occurrence."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new)
        return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(digits))) if c.isdecimal() else c for c in old) + "".join(digits)
    if kind == "ipv6":
        return lay_ipv6(groups_of(new), old)
    if kind == "iban":
        chars = iter(new)
        new = "".join(c if c == " " else next(chars) for c in old)
        return new.upper()
    letters = [c for c in old if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return new.upper()
    if kind.startswith("name"):
        return new.title() if old[:1].isupper() else new
    if kind == "secret" and not old.islower():
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, old, strict=False)) + new[len(old):]
    return new


def detect(docs: DataFrame) -> DataFrame:
    """(text, ...) -> text_key, kind, canon: one row for each entity of each different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(k, kind, canon) for k, t in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    for _, _, kind, canon in entities(t)}
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                                             ["text_key", "kind", "canon"])

    keyed = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(tidy(run), "text_key long, kind string, canon string").distinct()


#: Draws of an entity before the job fails; shapes grow long before.
MOST_ATTEMPTS = 400


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, ...) -> kind, canon, surrogate: distinct surrogates for distinct entities, none of them an entity itself."""
    secret = key.encode()

    def drawn(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [surrogate(k, c, attempt, secret) for k, c in zip(batch.column("kind").to_pylist(), batch.column("canon").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canon"), pa.array(new, pa.string())], ["kind", "canon", "surrogate"])
        return run

    entity = stage(found.select("kind", "canon").distinct(), "pii-entities")
    of_kind = F.element_at(F.split("kind", ":"), 1)
    taken = entity.select(of_kind.alias("t_kind"), F.col("canon").alias("t_value"))
    pending, accepted, attempt = entity, None, 0
    while True:
        draws = stage(pending.mapInArrow(drawn(attempt), "kind string, canon string, surrogate string"), "pii-draws")
        first = Window.partitionBy(of_kind, "surrogate").orderBy("canon", "kind")
        good = (draws.join(taken, (of_kind == F.col("t_kind")) & (F.col("surrogate") == F.col("t_value")), "left_anti")
                .withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place"))
        good = stage(good, "pii-accepted")
        accepted = good if accepted is None else accepted.unionByName(good)
        taken = taken.unionByName(good.select(of_kind.alias("t_kind"), F.col("surrogate").alias("t_value")))
        pending = stage(draws.join(good, ["kind", "canon"], "left_anti").select("kind", "canon"), "pii-pending")
        attempt += 1
        if pending.isEmpty():
            return accepted
        if attempt > MOST_ATTEMPTS:
            raise RuntimeError(f"no distinct surrogates after {attempt} draws for {pending.count()} entities")


def replace(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """`docs` (text, ...) with replaced texts and `n_replaced`, the number of occurrences."""
    found = stage(detect(docs), "pii-found")
    names = assign(found, key)
    entry = F.struct("kind", "canon", "surrogate")
    by_text = stage(found.join(names, ["kind", "canon"]).groupBy("text_key").agg(F.collect_list(entry).alias("new_names")), "pii-by-text")
    size = "aggregate(new_names, 64L, (n, e) -> n + 64 + octet_length(e.kind) + octet_length(e.canon) + octet_length(e.surrogate))"
    small = (by_text.agg(F.sum(F.expr(size))).first()[0] or 0) <= BROADCAST_BYTES
    fields = [c for c in docs.columns if c not in ("n_replaced", "new_names", "text_key")]
    source = docs.select(*fields).withColumn("text_key", F.xxhash64("text"))
    joined = source.join(F.broadcast(by_text) if small else by_text, "text_key", "left").drop("text_key")
    schema = StructType([*docs.select(*fields).schema.fields]).add("n_replaced", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("new_names").to_pylist(), strict=True):
                n = 0
                if text is not None and known:
                    table = {(k["kind"], k["canon"]): k["surrogate"] for k in known}
                    out, done = [], 0
                    for start, end, kind, canon in entities(text):
                        out += [text[done:start], lay(kind, table[kind, canon], text[start:end])]
                        done, n = end, n + 1
                    text = "".join(out) + text[done:]
                texts.append(text)
                counts.append(n)
            cols = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], schema.names)

    return joined.mapInArrow(tidy(run), schema)

"""64-bit hashes of the tokens of many texts at once, by array operations on the texts' bytes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is a slice of its own.
SLICE = 1_000_000
BASE = np.uint64(0x2545F4914F6CDD1D)
_rng = np.random.default_rng(0x5EED)
OF_BYTE = _rng.integers(0, 2 ** 64, 256, np.uint64)
OF_PLACE = _rng.integers(0, 2 ** 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n at least; computed anew when more are asked for."""
    if n >= len(_powers[0]):
        for k, b in enumerate((BASE, np.uint64(pow(int(BASE), -1, 2 ** 64)))):
            p = np.full(1 << max(12, n.bit_length()), b)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive slices of a string column; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def tokens(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, token counts at the texts' offsets): tokens are maximal runs of bytes of one kind other than 0 inside one text.

    `kinds` gives each byte's kind, `fold` the byte that stands for it.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = kinds[data]
    change = np.empty(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[0] = change[-1] = True
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    up, down = powers(len(data))
    values = (OF_BYTE if fold is None else OF_BYTE[fold])[data]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def windows(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, window counts at the texts' offsets) of all runs of n successive tokens inside one text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += mix(h[k:len(h) - n + 1 + k] ^ OF_PLACE[k + 8]) * OF_PLACE[k]
    inside = np.ones(len(total), bool)
    sizes = np.diff(counts)
    for end, size in zip(counts[1:].tolist(), sizes.tolist(), strict=True):
        if size:  # windows that begin in the last n - 1 tokens of a text run over its end
            inside[max(end - n + 1, end - size):end] = False
    kept = np.r_[0, np.cumsum(inside)]
    return mix(total[inside]), kept[np.minimum(counts, len(inside))]

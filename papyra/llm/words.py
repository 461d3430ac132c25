"""Words and word n-grams of Arrow text columns as numpy hashes.

Works on the UTF-8 bytes of a slice of texts at once: word bounds from a byte
table, word hashes from prefix sums of a polynomial mod 2^64, n-gram hashes from
the word hashes.  No Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SLICE_BYTES = 2 << 20

IS_WHITE = np.zeros(256, bool)
IS_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

_pow: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    name = "i" if inverse else "p"
    if name not in _pow or len(_pow[name]) < n:
        r = np.full(max(n + n // 8, 1 << 18), pow(BASE, -1, 1 << 64) if inverse else BASE, U64)
        r[0] = 1
        _pow[name] = np.cumprod(r)
    return _pow[name][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def as_texts(column) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and its n + 1 offsets from 0."""
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of at most ``most`` bytes, or one longer text alone."""
    _, off = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


class Words(NamedTuple):
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # row of each word
    count: np.ndarray  # words of each row


def bounds(buf: np.ndarray, off: np.ndarray) -> Words:
    n = len(off) - 1
    if not len(buf):
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, z, np.zeros(n, np.int64))
    word = ~IS_WHITE[buf]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    first = off[:-1][off[:-1] < off[1:]]
    before[first] = False
    after[first[1:] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return Words(buf, start, end, doc, np.bincount(doc, minlength=n))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    buf, off = text_bytes(texts)
    return bounds(TO_LOWER[buf] if lower else buf, off)


def word_hashes(w: Words) -> np.ndarray:
    n = len(w.buf)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((w.buf.astype(U64) + U64(1)) * powers(n), out=sums[1:])
    h = (sums[w.end] - sums[w.start]) * powers(n + 1, True)[w.start]
    return mix64(h ^ ((w.end - w.start).astype(U64) * U64(STEP)))


def ngram_hashes(h: np.ndarray, doc: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of k words within one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = np.full(n, seed, U64)
    for j in range(k):
        acc *= U64(BASE)
        acc += h[j:j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix64(acc[at]), at


def short_hashes(h: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the whole word sequence of each row with 1 to k - 1 words."""
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    out, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for c in range(1, k):
        r = np.flatnonzero(count == c)
        acc = np.full(len(r), c, U64)
        for j in range(c):
            acc = acc * U64(BASE) + h[first[r] + j]
        out.append(mix64(acc ^ U64(STEP)))
        rows.append(r)
    return np.concatenate(out), np.concatenate(rows)

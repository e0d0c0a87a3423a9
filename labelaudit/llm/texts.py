"""Words and shingles of a batch of texts, as arrays.

A word is a run of bytes other than blank, tab, line feed and the like; A-Z count as lower case. A
shingle is five words in a row; a text of fewer words is one shingle, a text without words none."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK = 1 << 21              # bytes of text worked on together (one text at least)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype="uint8")
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a multiply and xor-shift finish)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    out = np.full(n, base, "uint64")
    out[:1] = 1
    return np.cumprod(out, dtype="uint64")


class Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, powers(base, 1), powers(base, 1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = powers(self.base, n)
            self.down = powers(np.uint64(pow(int(self.base), -1, 1 << 64)), n)
        return self.up, self.down


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "int64")[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, "uint8") if data is not None else np.zeros(0, "uint8"), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(first, last + 1) rows of pieces of a batch of about `size` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and one more) for texts that lie in
    `data` from offsets[0] to offsets[-1]."""
    part = data[offsets[0]:offsets[-1]]
    bounds = offsets - offsets[0]
    n = len(part)
    if n == 0:
        return np.zeros(0, "uint64"), np.zeros(len(offsets), "int64")
    space = IS_SPACE[part]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True                       # a text's end ends a word
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:n]
    starts = np.flatnonzero(begins)
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:n]
    stops = np.flatnonzero(ends) + 1
    up, down = table.upto(n + 1)
    total = np.zeros(n + 1, "uint64")
    np.cumsum((LOWER[part].astype("uint64") + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[stops] - total[starts]) * down[starts])
    return hashes, np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, word number) of every shingle, in order, of texts whose words begin at
    `first`."""
    total = np.zeros(max(0, len(words) - SHINGLE + 1), "uint64")
    for j in range(SHINGLE):
        total = total * STEP + words[j:j + len(total)]
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[:len(total)] == owner[SHINGLE - 1:][:len(total)] if len(total) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    hashes, texts = mix(total[at]), owner[at]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        extra = np.zeros(len(short), "uint64")
        for j in range(SHINGLE - 1):
            here = counts[short] > j
            extra[here] = extra[here] * STEP + words[first[short[here]] + j]
        hashes = np.concatenate([hashes, mix(extra ^ mix(counts[short].astype("uint64")))])
        texts, at = np.concatenate([texts, short]), np.concatenate([at, first[short]])
        order = np.argsort(texts, kind="stable")
        hashes, texts, at = hashes[order], texts[order], at[order]
    return hashes, texts, at

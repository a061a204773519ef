"""Hashes of words and of word shingles over whole Arrow batches, with numpy on the texts' bytes.

Words are [^\\x20\\x09-\\x0D]+; white space is ASCII, so UTF-8 bytes can be cut as they are. A word's hash is a polynomial over
random 64-bit codes of its bytes, from prefix sums; a shingle's hash mixes those of its words with its own odd factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
#: Bytes of text that are hashed together.
GROUP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if base not in kept or len(kept[base]) < n:
        p = np.full(max(n, GROUP), base, np.uint64)
        p[0] = 1
        kept[base] = np.multiply.accumulate(p)
    return kept[base][:n]


class Words:
    """The words of some texts: doc (index of each word's text), start and end (bytes in data), hash, and first (each text's first word, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        white = _IS_WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = ~white
        before = np.r_[False, inside[:-1]]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.r_[inside[1:], False]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = len(data) + 1
        sums = np.zeros(n, np.uint64)
        if n > 1:
            np.cumsum(_CODES[data] * _powers(_BASE, n - 1), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(_INVERSE, n)[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each word on, and whether these are k words of one text. A text with 1 to k-1 words has one shingle, of all of them."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        left = self.first[1:][self.doc] - np.arange(n)  # words from here to the text's end
        for i in range(k):
            part = np.zeros(n, np.uint64)
            part[: max(n - i, 0)] = self.hash[i:] * _FACTORS[i]
            out += np.where(left > i, part, _U(0)) if i else part
        short = np.diff(self.first) < k
        begins = np.zeros(n, bool)
        begins[self.first[:-1][short & (np.diff(self.first) > 0)]] = True
        return mix(out), (left >= k) | begins


def groups(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) for runs of texts of about GROUP bytes; a longer text is a run of its own, whole. Nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GROUP, side="right")) - 1)
        yield a, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b

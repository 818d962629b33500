"""Words and word windows of a batch of texts as 64-bit hashes, in numpy.

A batch is one run of bytes with document offsets. A word's hash is a polynomial over a
random number per byte, modulo 2**64, from prefix sums (its base is odd, so powers have
inverses), then mixed. A window's hash is a polynomial over its words' hashes, built by
doubling: that of 2k words comes from those of k. Byte arrays of 64-bit numbers are made
for SPAN bytes at a time, so a long text costs no more memory per byte than a short one.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPAN = 1 << 19
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_rnd = random.Random("words")
_BYTE = np.array([_rnd.getrandbits(64) | 1 for _ in range(256)], np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE, _STEP = _rnd.getrandbits(64) | 5, _rnd.getrandbits(64) | 5
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n."""
    got = _powers.get(base)
    if got is None or len(got) <= n:
        steps = np.full(max(n, SPAN) + 1, base % 2**64, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps)
    return got


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # of each document: its first word; one more at the end
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> np.ndarray:
        """The hash of the k words from each on (of those of one document alone: see whole())."""
        return mixed(window_sums(self.hash, k))

    def whole(self, k: int) -> np.ndarray:
        """Whether a window of k words from each on lies in one document."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))
        return left >= k


def window_sums(h: np.ndarray, k: int) -> np.ndarray:
    """sum(h[i + j] * step ** j for j < k), by doubling; zeros beyond the end."""
    powers = _power(_STEP, k)
    total, have, block, size, rest = np.zeros_like(h), 0, h, 1, k

    def plus(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
        out = a.copy()
        if at < len(b):
            out[: len(b) - at] += b[at:] * powers[at]
        return out

    while rest:
        if rest & 1:
            total, have = plus(total, block, have) if have else block.copy(), have + size
        rest >>= 1
        if rest:
            block, size = plus(block, block, size), size * 2
    return total


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of an Arrow string array (null: no words); lower: A-Z as a-z."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    word = ~_GAP[data]
    edge = np.ones(len(data) + 1, bool)  # a document's first byte begins a word, its last ends one
    edge[1:-1] = False
    edge[offsets] = True
    start = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])[: len(data)]))
    end = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]])[: len(data)])) + 1
    first = np.searchsorted(start, offsets)
    h = np.empty(len(start), np.uint64)
    values, at = _LOWER if lower else _BYTE, 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SPAN, "right")))
        lo, hi = start[at], end[to - 1]
        powers = _power(_BASE, int(hi - lo))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data[lo:hi]] * powers[: hi - lo])])
        back = _power(pow(_BASE, -1, 2**64), int(hi - lo))
        h[at:to] = (sums[end[at:to] - lo] - sums[start[at:to] - lo]) * back[start[at:to] - lo]
        at = to
    return Words(data, start, end, first, mixed(h))


def pieces(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = 1 << 20):
    """The batch in slices of about most bytes of text, one row at least."""
    texts = batch.column(column)
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to

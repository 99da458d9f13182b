"""Words and rolling hashes of whole Arrow text columns, vectorised in numpy.

Everything here works on the raw UTF-8 bytes of many documents at once; document
boundaries are kept as offsets, so no window ever crosses two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240611)
#: One random odd value per byte, and odd bases of the two polynomial hashes.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1

#: Bytes of words of the two contracts: everything but ASCII white space; and digits, letters and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTER_DIGIT = np.zeros(256, bool)
LETTER_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, self.base, U64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, inverse, U64)]))
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes each; a longer row is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of raw[:i]; see `range_hash`."""
    up, _ = BYTE_POWERS.get(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_VALUE[raw] * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers = BYTE_POWERS) -> np.ndarray:
    """Hash of each range of what `prefix` was made from, equal for equal content wherever it stands."""
    _, down = powers.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


class Words:
    """Words of documents: byte ranges, hashes and the first word of every document.

    raw, offsets: as from `text_buffers`; kind: which bytes belong to words.
    start, end: byte ranges of words; first[d]:first[d+1]: words of document d; h: 64-bit hash of each
    word, or of its first `stem` bytes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, stem: int | None = None) -> None:
        inside = kind[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.h = range_hash(prefix_hash(raw), self.start, self.end if stem is None else np.minimum(self.end, self.start + stem))
        up, _ = WORD_POWERS.get(len(self.h) + 1)
        self.sums = np.zeros(len(self.h) + 1, U64)
        np.cumsum(self.h * up[:-1], out=self.sums[1:])

    def room(self) -> np.ndarray:
        """For each word, how many words its document has from there on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.h))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; only those with room() >= n mean anything."""
        k = len(self.h)
        i = np.arange(max(0, k - n + 1))
        out = np.zeros(k, U64)
        out[: len(i)] = range_hash(self.sums, i, i + n, WORD_POWERS)
        return out


def marked(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    np.subtract.at(d, ends, 1) if len(ends) < 64 else d.__isub__(np.bincount(ends, minlength=n + 1).astype(np.int32))
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    d = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f (minimum or maximum) over each `width` consecutive values: len(a) - width + 1 of them."""
    if len(a) < width:
        return a[:0]
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:])
        have += step
    return out

"""Distinct byte ranges of a text buffer, exact, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from newsloom.llm.tokens import U64, mix

LOW = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def _blocks(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Ranges with bytes at offset k, k, and eight bytes of each from there on as a number, cut at its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))  # a view: only what is asked for is copied
    at, k = np.arange(len(start)), 0
    while len(at):
        yield at, k, eight[start[at] + k] & LOW[np.minimum(size[at] - k, 8)]
        k += 8
        at = at[size[at] > k]


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range, equal for equal content."""
    size = end - start
    h = size.astype(np.uint64)
    for at, _, block in _blocks(raw, start, size):
        h[at] = mix(h[at] * U64(0x9E3779B97F4A7C15) + block)
    return h


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse): a place among the ranges for each distinct content, and each range's index into them.

    Ranges are grouped by hash and then compared byte by byte with the first of their group; those that differ,
    as two of one hash may, are told apart by their bytes.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start
    _, first, inverse = np.unique(hashes(raw, start, end), return_index=True, return_inverse=True)
    other = first[inverse]
    same = size == size[other]
    check = np.flatnonzero(same & (other != np.arange(len(start))))
    ours, theirs = _blocks(raw, start[check], size[check]), _blocks(raw, start[other[check]], size[check])
    for (at, _, a), (_, _, b) in zip(ours, theirs, strict=True):
        same[check[at[a != b]]] = False
    own: dict[bytes, int] = {}
    odd = np.flatnonzero(~same)
    for i in odd.tolist():
        inverse[i] = own.setdefault(raw[start[i] : end[i]].tobytes(), len(first) + len(own))
    _, more = np.unique(inverse[odd], return_index=True)
    return np.concatenate([first, odd[more]]), inverse


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges one after another: starts[0], starts[0] + 1, ..."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)

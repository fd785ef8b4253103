"""NumPy kernels over Arrow string buffers: words, their hashes and shingles of whole texts.

Texts stay in Arrow's UTF-8 buffer; nothing is decoded to Python strings. A null text counts as empty. Work is done in
slices of about SLICE bytes, cut between documents or, inside a document longer than that, between words, so that
memory follows the slice and the number of words of one document rather than the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2_000_000
_M = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    x = x.astype(_M, copy=True)
    x ^= x >> _M(30)
    x *= _M(0xBF58476D1CE4E5B9)
    x ^= x >> _M(27)
    x *= _M(0x94D049BB133111EB)
    x ^= x >> _M(31)
    return x


#: A random 64-bit value for each byte, and the base of the polynomial with its inverse modulo 2**64.
_BYTE = mix(np.arange(1, 257, dtype=_M) * _M(_ODD))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, grown when a longer slice comes."""

    up = np.ones(1, _M)
    down = np.ones(1, _M)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                out = np.full(size, base, _M)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))
        return cls.up, cls.down


def byte_table(word: bytes | range | list[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    out = np.zeros(256, bool)
    out[list(word)] = True
    return out


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_table([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters and everything beyond ASCII
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def spans(data: np.ndarray, word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the starts and ends of the words of one stretch of bytes."""
    low = LOWER[data] if lower else data
    flag = np.empty(len(data) + 2, bool)
    flag[0] = flag[-1] = False
    flag[1:-1] = word[low]
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    return low, edge[0::2], edge[1::2]


def hash_spans(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: sum of byte values times powers, shifted back to the start."""
    if not len(start):
        return np.zeros(0, _M)
    up, down = _Powers.to(len(low) + 1)
    total = np.empty(len(low) + 1, _M)
    total[0] = 0
    np.cumsum(_BYTE[low] * up[: len(low)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_M) * _M(_ODD))


def _cuts(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last document + 1, first byte, last byte + 1); a long document comes in several cuts of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        while hi - lo > SLICE and j == i + 1:
            to = lo + SLICE
            while to < hi and word[LOWER[data[to]]]:
                to += 1
            if to >= hi:
                break
            yield i, j, lo, to
            lo = to
        yield i, j, lo, hi
        i = j


def words(column, word: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first, last + 1, hashes of words, number of words before each document) for runs of whole documents."""
    data, offsets = buffers(column)
    held: list[np.ndarray] = []
    at = -1
    for i, j, lo, hi in _cuts(data, offsets, word):
        part = data[lo:hi]
        low, start, end = spans(part, word)
        if j - i > 1:  # words must not run over from one document into the next
            start, end = split_at(start, end, offsets[i + 1 : j] - lo)
        hashed = hash_spans(low, start, end)
        if j - i == 1:
            if at != i:
                held, at = [], i
            held.append(hashed)
            if hi == offsets[j]:
                joined = held[0] if len(held) == 1 else np.concatenate(held)
                yield i, j, joined, np.array([0, len(joined)])
                held, at = [], -1
        else:
            yield i, j, hashed, np.searchsorted(start, offsets[i : j + 1] - lo, "left")


def split_at(start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts spans that hold one of the positions at (sorted) inside."""
    k = np.searchsorted(start, at, "right") - 1
    inside = (k >= 0) & (start[k] < at) & (at < end[k]) if len(start) else np.zeros(len(at), bool)
    cut = np.unique(at[inside])
    if not len(cut):
        return start, end
    return np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles of each document and their offsets; a document with fewer words has its whole sequence."""
    counts = np.diff(offsets)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(per)])
    if not out_offsets[-1]:
        return np.zeros(0, _M), out_offsets
    at = np.arange(out_offsets[-1]) + np.repeat(offsets[:-1] - out_offsets[:-1], per)
    short = np.repeat((counts > 0) & (counts < n), per)
    size = np.where(short, np.repeat(counts, per), n) if short.any() else None
    total = np.zeros(len(at), _M)
    factor = 1
    for k in range(n):
        factor = factor * _BASE & _MASK
        part = hashes[np.minimum(at + k, len(hashes) - 1)] * _M(factor)
        total += part if size is None else np.where(k < size, part, _M(0))
    return mix(total + (_M(n * _ODD & _MASK) if size is None else size.astype(_M) * _M(_ODD))), out_offsets

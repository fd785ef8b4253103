"""SuperMinHash signatures of many documents at once.

Every element draws, from its own seed, a random permutation of the m positions and m uniform numbers; position p[j] gets
the value j + r[j], and a signature holds the smallest value at each position. Because the integer part is the rank j in
the element's permutation, ranks are handled level by level for all documents of a batch: once every position of a
document holds a value below j, later ranks can't change it and the document drops out (early stopping).
"""

from __future__ import annotations

import numpy as np

from .kernel import mix

_M = np.uint64


def signatures(elements: np.ndarray, offsets: np.ndarray, m: int = 128) -> np.ndarray:
    """Elements: 64-bit hashes, document i's from offsets[i] to offsets[i + 1]; repeats change nothing.

    Returns uint64 (documents, m): rank in the top bits, then the uniform number. A document without elements has all ones.
    """
    n = len(offsets) - 1
    bits = 64 - max(1, (m - 1).bit_length())
    out = np.full(n * m, np.iinfo(np.uint64).max, _M)
    counts = np.diff(offsets)
    live = np.flatnonzero(counts)
    seed = elements
    owner = np.repeat(np.arange(n), counts)
    picks: list[np.ndarray] = []
    for j in range(m):
        if not len(live):
            break
        drawn = mix(seed + _M(((2 * j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        k = (((drawn & _M(0xFFFFFFFF)) * _M(m - j)) >> _M(32)).astype(np.int16 if m > 256 else np.uint8)
        k += k.dtype.type(j)
        at = k
        for t in range(j - 1, -1, -1):  # what earlier swaps left at position k
            at = np.where(at == picks[t], at.dtype.type(t), at)
        picks.append(k)
        value = (mix(drawn) >> _M(64 - bits)) | _M(j << bits)
        np.minimum.at(out, owner * m + at, value)
        still = out.reshape(n, m)[live].max(axis=1) >= _M((j + 1) << bits) if j + 1 < m else np.zeros(len(live), bool)
        if not still.all():
            live = live[still]
            keep = np.zeros(n, bool)
            keep[live] = True
            mask = keep[owner]
            seed, owner = seed[mask], owner[mask]
            picks = [p[mask] for p in picks]
    return out.reshape(n, m)

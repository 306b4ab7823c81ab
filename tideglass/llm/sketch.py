"""Fast similarity sketching: t coordinates filled by rounds of hashed bin placement.

Round i < t throws every element into the bin its hash names; round i >= t throws all
elements into bin i - t, so after 2t rounds each bin is filled for certain.  A
coordinate keeps the least (round, hash) that reached its bin and rounds stop once
a set's bins are full, so a set of n elements costs about n + t log t, and
two sets agree in a coordinate with probability equal to their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from tideglass.llm.hashing import U64, mix

_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def sketches(values: np.ndarray, bounds: np.ndarray, t: int = 128) -> np.ndarray:
    """(n_sets, t) uint64 sketches of the sets values[bounds[i]:bounds[i+1]].

    t must be a power of two up to 256.  Empty sets keep the all-ones value.
    """
    bits = t.bit_length() - 1
    if 1 << bits != t or t > 256:
        raise ValueError("t must be a power of two up to 256")
    n_sets = len(bounds) - 1
    out = np.full((n_sets, t), _EMPTY)
    sizes = np.diff(bounds)
    open_sets = np.flatnonzero(sizes > 0)
    owner = np.repeat(np.arange(n_sets), sizes)
    live, own = values, owner
    flat = out.ravel()
    for i in range(2 * t):
        if not len(open_sets):
            break
        h = mix(live + U64((i * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        at = own * t + ((h >> U64(64 - bits)).astype(np.int64) if i < t else i - t)
        np.minimum.at(flat, at, (U64(i) << U64(54)) | (h & U64((1 << 54) - 1)))
        full = (out[open_sets] != _EMPTY).all(axis=1)
        if full.any():
            keep = np.zeros(n_sets, bool)
            keep[open_sets[~full]] = True
            open_sets = open_sets[~full]
            sel = keep[own]
            live, own = live[sel], own[sel]
    return out


def band_keys(sk: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` coordinates, salted with the band's number."""
    n, t = sk.shape
    bands = t // rows
    part = sk[:, : bands * rows].reshape(n, bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for r in range(rows):
        acc = mix(acc * U64(0x9E3779B97F4A7C15) + part[:, :, r])
    return acc

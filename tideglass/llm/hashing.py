"""Vectorised word and shingle hashing shared by the text operators.

A batch of UTF-8 texts is laid out as one byte array.  Word hashes come from
prefix sums of a per-byte random table times powers of an odd base (mod 2**64),
so hashing needs no Python loop over words.  Hashes depend only on the bytes,
never on the process, so every executor and every rerun agrees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE = np.random.RandomState(20240229).randint(0, 1 << 62, 256).astype(U64) * U64(4) + U64(1)
#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space
SPACES = bytes(range(0x09, 0x0E)) + b" "
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U64), "q": np.ones(1, U64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (works on uint64 arrays, wraps silently)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


WHITE = separators(SPACES)


def words_of(texts: list[bytes], gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case A-Z and cut every text into maximal runs of non-gap bytes.

    Returns (hashes, first word of each text (n+1 entries), bytes, starts, ends).
    The text boundary always separates words.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    edge = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    blank = gap[data]
    if not gap[10]:
        blank = blank.copy()
        blank[edge - 1] = True
    change = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    starts, ends = change[0::2], change[1::2]
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * _power("p", _BASE, len(data)), out=sums[1:])
    inverse = _power("q", pow(_BASE, -1, 1 << 64), len(data))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))
    first = np.concatenate(([0], np.searchsorted(starts, edge)))
    return hashes, first, data, starts, ends


def shingle_sets(texts: list[bytes | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted within the text.

    A text of fewer than k words, but at least one, has one shingle: all of it.
    None and texts without words have none.  Returns (hashes, bounds).
    """
    hashes, first, *_ = words_of([t or b"" for t in texts])
    n = np.diff(first)
    acc = np.full(len(hashes), 7, U64)
    for i in range(k):
        tail = hashes[i:]
        acc[: len(tail)] = mix(acc[: len(tail)] * U64(0x9E3779B97F4A7C15) + tail)
    out, bounds = [], np.zeros(len(texts) + 1, np.int64)
    for d in range(len(texts)):
        a, b = first[d], first[d + 1]
        if n[d] >= k:
            own = np.sort(acc[a : b - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif n[d]:
            one = np.full(1, 7, U64)
            for w in hashes[a:b]:
                one = mix(one * U64(0x9E3779B97F4A7C15) + w)
            own = mix(one + U64(n[d]))
        else:
            own = np.empty(0, U64)
        out.append(own)
        bounds[d + 1] = bounds[d] + len(own)
    return (np.concatenate(out) if out else np.empty(0, U64)), bounds


def slices(items: Iterable, size, limit: int) -> Iterator[list]:
    """Cut a stream into lists of about `limit` size units; a larger item stands alone."""
    part: list = []
    total = 0
    for item in items:
        s = size(item)
        if part and total + s > limit:
            yield part
            part, total = [], 0
        part.append(item)
        total += s
    if part:
        yield part

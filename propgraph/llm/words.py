"""Hashes of words, for whole chunks of text at a time.

Words are what ASCII white space parts; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at a time.
_SPAN = 1 << 19
_P = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(p: int, n: int) -> np.ndarray:
    """p^0 to p^(n-1) modulo 2^64."""
    if len(_powers.get(p, ())) < n:
        out = np.ones(max(n, _SPAN + 1), np.uint64)
        k = 1
        while k < len(out):
            m = min(k, len(out) - k)
            out[k : k + m] = out[:m] * np.uint64(pow(p, k, 1 << 64))
            k += m
        _powers[p] = out
    return _powers[p][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word: a polynomial of its bytes' values, from differences of one running sum."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _SPAN)
        while end < len(data) and not _IS_SPACE[data[end - 1]]:  # not within a word
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        space = _IS_SPACE[b]
        edges = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
        s, e = edges[::2], edges[1::2]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * _power(_P, len(b)), out=total[1:])
        starts.append(s + at)
        hashes.append(_mix((total[e] - total[s]) * _power(pow(_P, -1, 1 << 64), len(b) + 1)[s]))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)

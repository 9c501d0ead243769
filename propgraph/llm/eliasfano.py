"""Elias-Fano sequences in numpy, and files of arrays that are memory-mapped.

A non-decreasing sequence of n values below u takes about 2 + log2(u / n) bits a value: the low bits of each are
packed, the high bits are written in unary. A directory with the number of ones (and zeros) before each word of 64
bits gives access by index and successor search, for many queries at a time. Sorted queries touch memory in order.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_SEL = np.array([[([b for b in range(8) if x >> b & 1] + [0] * 8)[k] for k in range(8)] for x in range(256)], np.uint8)
_ONE, _ALL = np.uint64(1), ~np.uint64(0)


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the sequence: meta (n, low bits), low, high, ones, zeros."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    bits = max(0, int((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
    i = np.arange(n, dtype=np.uint64)
    low = np.zeros(n * bits // 64 + 2, np.uint64)
    if bits and n:
        x, at = v & np.uint64((1 << bits) - 1), i * np.uint64(bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(off > 0, x >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        for part, to in ((x << off, word), (over, word + 1)):
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            low[to[first]] |= np.bitwise_or.reduceat(part, first)
    at = ((v >> np.uint64(bits)) + i).astype(np.int64)
    size = int(at[-1]) + 2 if n else 1  # the last bucket's zero as well
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[at] = 1
    flags[size:] = 1  # so that no zeros stand behind the sequence
    high = np.packbits(flags, bitorder="little").view(np.uint64)
    ones = np.r_[0, np.cumsum(_POP[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64))]
    return {"meta": np.array([n, bits, size - n], np.int64), "low": low, "high": high, "ones": ones, "zeros": np.arange(len(ones), dtype=np.int64) * 64 - ones}


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each word: three halvings by the number of ones, then a table."""
    w, k = words, k.astype(np.uint8)
    at = np.zeros(len(k), np.uint8)
    for half in (32, 16, 8):
        ones = np.bitwise_count(w & np.uint64((1 << half) - 1))
        over = k >= ones
        k = k - ones * over
        shift = over * np.uint8(half)
        at += shift
        w = w >> shift
    return (at + _SEL[(w & np.uint64(255)).astype(np.uint8), k]).astype(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits, self.buckets = (int(x) for x in arrays["meta"])
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in ("low", "high", "ones", "zeros"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> off
        more = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (x | more) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select(np.asarray(self.high[word]), i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _smaller(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``bucket`` (0 to the number of buckets)."""
        k = np.maximum(bucket - 1, 0)
        word = np.searchsorted(self.zeros, k, "right") - 1
        at = word * 64 + _select(~np.asarray(self.high[word]), k - self.zeros[word])
        return np.where(bucket > 0, at - k, 0)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each ``x``: place of the first value that is not below it, the end of its bucket, its low bits."""
        h = x >> np.uint64(self.bits)
        out = h >= np.uint64(self.buckets)
        bucket = np.where(out, 0, h).astype(np.int64)
        lo, end = self._smaller(bucket), self._smaller(bucket + 1)
        hi = end.copy()
        want = x & np.uint64((1 << self.bits) - 1) if self.bits else np.zeros(len(x), np.uint64)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            below = self._low(mid) < want[live]
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
            live = live[lo[live] < hi[live]]
        lo[out] = end[out] = self.n
        return lo, end, want

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that is not below each ``x``; n if there is none."""
        x = np.asarray(x, np.uint64)
        return self._search(x)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each ``x`` (the first, if it is repeated); -1 where it is no value."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.full(len(x), -1, np.int64)
        at, end, want = self._search(x)
        ok = np.flatnonzero(at < end)  # the successor lies in the same bucket: high bits are equal
        out = np.full(len(x), -1, np.int64)
        ok = ok[self._low(at[ok]) == want[ok]]
        out[ok] = at[ok]
        return out


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file with named arrays, put in place when complete: a task that runs twice leaves the same file."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    os.replace(temporary, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped: only the pages that are asked for are read."""
    whole = np.memmap(path, np.uint8, "r")
    size = int(whole[:8].view(np.int64)[0])
    head = json.loads(whole[8 : 8 + size].tobytes())
    return {k: whole[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}


def named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def part(prefix: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano({k: arrays[f"{prefix}.{k}"] for k in ("meta", "low", "high", "ones", "zeros")})

"""Hashes of words and of runs of words, for whole batches of texts at once.

A word's hash has two halves of 64 bits. Its bytes are taken eight at a time and
mixed in by a one-to-one function each time, so words of up to eight bytes and
one length never collide within a half; words of over 64 bytes are hashed by
blake2b. Where a decision falls, callers compare the words themselves or a
128-bit blake2b digest of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_random = np.random.Generator(np.random.PCG64(20240607))
_LEFT, _RIGHT, _ALONE, *_HALVES = (int(x) | 1 for x in _random.integers(0, 2**64, 5, dtype=np.uint64))
#: Bytes of a word that are mixed eight at a time.
SHORT = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def digest(words: bytes) -> bytes:
    """128 bits that no two different strings are known to share."""
    return hashlib.blake2b(words, digest_size=16).digest()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of several texts: all of them with one space between, where each starts and ends there, the halves of its digest, and each text's first word."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    others: np.ndarray
    firsts: np.ndarray  # one more than texts: the last is the number of words

    def of(self, k: int) -> slice:
        return slice(self.firsts[k], self.firsts[k + 1])

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) with one space between."""
        return self.data[self.starts[a] : self.ends[b - 1]] if b > a else b""


def words_of(texts: list[bytes]) -> Words:
    """Splits at the six blanks of ASCII."""
    split = [t.split() for t in texts]
    data = b" ".join([b" ".join(ws) for ws in split if ws])
    n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    firsts = np.concatenate(([0], np.cumsum(n)))
    raw = np.frombuffer(data + b" " + bytes(SHORT), dtype=np.uint8)
    ends = np.flatnonzero(raw[: len(data) + 1] == 32) if len(data) else np.zeros(0, dtype=np.int64)
    starts = np.concatenate((ends[:0], [0], ends[:-1] + 1)) if len(ends) else ends
    sizes = ends - starts
    eights = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    halves = []
    for seed in _HALVES:
        h = np.uint64(seed) ^ (sizes.astype(np.uint64) * np.uint64(_LEFT))
        at, some = 0, slice(None)
        while at < SHORT:
            left = np.minimum(sizes[some] - at, 8)
            h[some] = mix(h[some] ^ (eights[starts[some] + at] & _MASKS[left])) + np.uint64(seed)
            at += 8
            some = np.flatnonzero(sizes > at)
            if not len(some):
                break
        halves.append(h)
    for k in np.flatnonzero(sizes > SHORT):
        halves[0][k], halves[1][k] = np.frombuffer(digest(data[starts[k] : ends[k]]), dtype="<u8")
    return Words(data, starts, ends, *halves, firsts)


def shingles(ws: Words, size: int = 2, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of size words, repeats and all, and each text's first one, from either half of the words' digests.

    A text of fewer words has one run, all of its words; one without words has none.
    """
    n = np.diff(ws.firsts)
    h = ws.hashes if hashes is None else hashes
    runs = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for k in range(size):
        part = h[k : len(h) - size + 1 + k]
        runs = runs * np.uint64(_LEFT) + part
    runs = mix(runs)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    firsts = np.concatenate(([0], np.cumsum(counts)))
    short = np.flatnonzero((n > 0) & (n < size))
    if not len(short) and len(counts) and (n >= size).all():
        keep = np.ones(len(runs), dtype=bool)
        for back in range(1, size):
            inner = ws.firsts[1:-1] - back
            keep[inner[inner < len(runs)]] = False
        return runs[keep], firsts
    out = np.empty(firsts[-1], dtype=np.uint64)
    for k in np.flatnonzero(n):
        a = ws.firsts[k]
        if n[k] >= size:
            out[firsts[k] : firsts[k + 1]] = runs[a : a + counts[k]]
        else:
            whole = np.full(1, _ALONE, dtype=np.uint64)
            for x in h[a : a + n[k]]:
                whole = whole * np.uint64(_RIGHT) + x
            out[firsts[k]] = mix(whole)[0]
    return out, firsts


def shingle_set(text: bytes, size: int) -> set[bytes]:
    """The distinct runs of size words themselves; of a text of fewer words, all of them as one."""
    ws = text.split()
    if len(ws) < size:
        return {b" ".join(ws)} if ws else set()
    return set(map(b" ".join, zip(*(ws[k:] for k in range(size)))))  # noqa: B905  the shortest ends it

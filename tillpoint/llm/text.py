"""Word splitting and hashing over whole Arrow batches with numpy.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes after
lower-casing A-Z, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
# Words longer than this are hashed one by one.
LONG_WORD = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


@dataclass
class Words:
    data: np.ndarray      # lower-cased bytes of all texts
    starts: np.ndarray    # byte positions of the words
    ends: np.ndarray
    docs: np.ndarray      # word index at which each text starts, and one more

    def of(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def joined(self, i: int, j: int) -> bytes:
        return b" ".join(self.of(k) for k in range(i, j))


def split_words(texts: pa.Array) -> Words:
    """The words of a large_string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[first:last] if raw is not None and last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    data = LOWER[data]
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = False, inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(data) + 1, dtype=bool)
    after[:-1], after[-1] = inside, False
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def hash_words(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    n = len(w.starts)
    size = w.ends - w.starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if not n:
        return h
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([w.data, np.zeros(8, np.uint8)]), 8)
    keep = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    keep = np.append(keep, np.uint64(0xFFFFFFFFFFFFFFFF))
    todo, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        chunk = np.ascontiguousarray(eight[w.starts[todo] + at]).view("<u8").ravel()
        chunk &= keep[np.minimum(size[todo] - at, 8)]
        h[todo] = mix(h[todo] ^ chunk)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(w.of(i), digest_size=8).digest(), "little")
    return h


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each word (length len - n + 1)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k, c in enumerate(odd(n, n)):
        total += words[k:k + m] * c
    return mix(total)

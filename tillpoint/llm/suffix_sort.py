"""Two-stage suffix sorting of the segments inside one task, with numpy.

Suffixes smaller than their successor are sorted directly; the others follow
by one scan over the buckets of first bytes, in order: whatever precedes a
sorted suffix and is larger than it goes to the next free place of its own
bucket.  The order is that of the first ``depth`` bytes."""

from __future__ import annotations

import numpy as np

_PACK, _BITS = 6, 10
# Suffixes compared at once.
_PAIRS = 8192


def _refine(rank: np.ndarray, who: np.ndarray, order: np.ndarray, differs: np.ndarray) -> None:
    """Split groups of equal rank (a rank is the group's first place).
    ``who`` holds whole groups, ``order`` sorts it by rank and key, ``differs``
    says where the key of ``who[order]`` differs from the one before."""
    who = who[order]
    old = rank[who]
    first = np.empty(len(who), bool)
    first[0], first[1:] = True, old[1:] != old[:-1]
    at = np.arange(len(who))
    group = np.maximum.accumulate(np.where(first, at, 0))
    start = np.maximum.accumulate(np.where(first | differs, at, 0))
    rank[who] = old + start - group


def _differs(key: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), bool)
    out[0], out[1:] = True, key[1:] != key[:-1]
    return out


def _tied(rank: np.ndarray, who: np.ndarray) -> np.ndarray:
    count = np.bincount(rank, minlength=len(rank) + 1)
    return who[count[rank[who]] > 1]


def _sort_smaller(symbols: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` (suffixes smaller than their successor) in order.

    A unit runs from one such position to the next, both included, so that no
    unit is a proper prefix of another; units are ranked by their symbols and
    the suffixes by doubling the number of units compared."""
    n, m = len(symbols), len(at)
    size = np.append(at[1:] + 1, n) - at
    padded = np.concatenate([symbols, np.zeros(_PACK, np.int64)])
    rank, who, done = np.zeros(m, np.int64), np.arange(m), 0
    while len(who):
        key = np.zeros(len(who), np.int64)
        for k in range(_PACK):
            inside = done + k < size[who]
            place = np.minimum(at[who] + done + k, n)
            key = (key << _BITS) | np.where(inside, padded[place], 0)
        order = np.argsort(key) if not done else np.lexsort((key, rank[who]))
        _refine(rank, who, order, _differs(key[order]))
        done += _PACK
        who = _tied(rank, who)
        who = who[size[who] > done]
    step, bits = 1, int(m).bit_length()
    who = _tied(rank, np.arange(m))
    # Three ranks make one key while they fit; 0 stands for the end of the text.
    ahead = 2 if 3 * bits <= 63 else 1
    after = np.zeros(m + 1, np.int64)
    while len(who):
        # Units that already cover ``depth`` bytes need no more.
        ends = np.where(who + step < m, at[np.minimum(who + step, m - 1)], n)
        open_rank = np.zeros(m, bool)
        open_rank[rank[who[ends - at[who] < depth]]] = True
        who = who[open_rank[rank[who]]]
        if not len(who):
            break
        after[:m] = rank + 1
        key = rank[who]
        for k in range(1, ahead + 1):
            key = (key << bits) | after[np.minimum(who + k * step, m)]
        order = np.argsort(key)
        _refine(rank, who, order, _differs(key[order]))
        who = _tied(rank, who)
        step *= ahead + 1
    return at[np.argsort(rank, kind="stable")]


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All positions of ``data`` (small unsigned integers) in the order of the
    first ``depth`` values of their suffixes; a shorter suffix comes first."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    s = data.astype(np.int64)
    change = np.append(s[1:] - s[:-1], -1)
    nxt = np.minimum.accumulate(np.where(change != 0, np.arange(n), n)[::-1])[::-1]
    smaller = change[nxt] > 0
    direct = np.flatnonzero(smaller)
    ordered = _sort_smaller(2 * s + smaller, direct, depth) if len(direct) else direct
    values = int(s.max()) + 1
    bounds = np.searchsorted(s[ordered], np.arange(values + 1))
    larger: list[list[np.ndarray]] = [[] for _ in range(values)]
    larger[s[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(values):
        induced = larger[c]
        wave = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        parts = []
        while len(wave):
            parts.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(s[wave] == c) & ~smaller[wave]]
        bucket = np.concatenate([*parts, ordered[bounds[c]:bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(s[before] > c) & ~smaller[before]]
        if len(before):
            first = s[before]
            turn = np.argsort(first, kind="stable")
            before, first = before[turn], first[turn]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(first))):
                larger[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each two suffixes, up to ``depth``."""
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(depth, data.dtype)]), depth)
    out = np.empty(len(left), np.int64)
    for a in range(0, len(left), _PAIRS):
        differ = window[left[a:a + _PAIRS]] != window[right[a:a + _PAIRS]]
        first = differ.argmax(axis=1)
        out[a:a + _PAIRS] = np.where(differ[np.arange(len(first)), first], first, depth)
    return np.minimum(out, len(data) - np.maximum(left, right))

"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

The top level works on bytes: suffixes are classified as smaller or larger than their
follower, the leftmost smaller ones (LMS) start the substrings that are sorted and named, the
string of names is sorted recursively, and its order induces the order of all suffixes in two
linear passes.  A pass goes through the buckets of first bytes and handles a bucket in waves,
each as one array operation, which gives the same order as handling its suffixes one by one.
Deeper levels have as many letters as names, so there the passes go suffix by suffix.
"""

from __future__ import annotations

import numpy as np

from .common import ByteHash


def smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; an end is smaller than any letter."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    ends = np.append(change, n - 1)
    up = np.append(s[change] < s[change + 1], False)
    return np.repeat(up, np.diff(ends, prepend=-1))


def leftmost(kind: np.ndarray) -> np.ndarray:
    return np.flatnonzero(kind[1:] & ~kind[:-1]) + 1


class Buckets:
    """Arrays appended to 256 buckets, kept in order of arrival."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(self, positions: np.ndarray, letters: np.ndarray) -> None:
        if len(positions) == 1:
            self.parts[letters[0]].append(positions)
        elif len(positions):
            order = np.argsort(letters, kind="stable")
            positions, letters = positions[order], letters[order]
            cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
            heads = np.concatenate([[0], cuts])
            for part, c in zip(np.split(positions, cuts), letters[heads]):
                self.parts[c].append(part)

    def take(self, c: int) -> np.ndarray:
        parts = self.parts[c]
        self.parts[c] = []
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)


def induce(s: np.ndarray, kind: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes from the order of the LMS ones in `seeds`."""
    n = len(s)
    start = Buckets()
    start.deal(seeds, s[seeds])
    large, larges = Buckets(), [np.zeros(0, np.int64)] * 256
    large.deal(np.array([n - 1]), s[n - 1 :])
    for c in range(256):
        seen = []
        while len(wave := large.take(c)):
            seen.append(wave)
            before = wave[wave > 0] - 1
            before = before[~kind[before]]
            large.deal(before, s[before])
        if seen:
            larges[c] = np.concatenate(seen)
        if len(first := start.take(c)):
            before = first - 1
            large.deal(before, s[before])
    small, out = Buckets(), []
    for c in range(255, -1, -1):
        seen = []
        while len(wave := small.take(c)):
            seen.append(wave)
            before = wave[wave > 0] - 1
            before = before[kind[before]]
            small.deal(before, s[before])
        back = larges[c][::-1]
        before = back[back > 0] - 1
        before = before[kind[before]]
        small.deal(before, s[before])
        out += [*seen, back]
    return np.concatenate(out)[::-1]


def names_of(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A rank for every LMS position in text order, equal for equal substrings; their count."""
    n = len(s)
    ends = np.append(lms[1:] + 1, n)
    place = np.searchsorted(lms, ordered)
    length = (ends - lms)[place]
    # the last substring runs into the end of the text, which no other does
    hashed = ByteHash(s).ranges(ordered, ends[place]) if len(ordered) else np.zeros(0, np.uint64)
    new = np.ones(len(ordered), bool)
    new[1:] = (length[1:] != length[:-1]) | (hashed[1:] != hashed[:-1])
    last = place == len(lms) - 1
    new |= last
    new[1:] |= last[:-1]
    rank = np.cumsum(new) - 1
    out = np.empty(len(lms), np.int64)
    out[place] = rank
    return out, int(rank[-1]) + 1 if len(rank) else 0


def sort_names(s: list[int], letters: int) -> list[int]:
    """Induced sorting of a string over many letters, suffix by suffix."""
    n = len(s)
    if n < 2:
        return list(range(n))
    kind = [False] * n
    for i in range(n - 2, -1, -1):
        kind[i] = s[i] < s[i + 1] or s[i] == s[i + 1] and kind[i + 1]
    count = [0] * (letters + 1)
    for c in s:
        count[c + 1] += 1
    for c in range(letters):
        count[c + 1] += count[c]
    heads, tails = count[:-1], count[1:]
    lms = [i for i in range(1, n) if kind[i] and not kind[i - 1]]

    def passes(seeds: list[int]) -> list[int]:
        sa, head, tail = [-1] * n, heads[:], tails[:]
        for i in reversed(seeds):
            tail[s[i]] -= 1
            sa[tail[s[i]]] = i
        sa_head = head[s[n - 1]]
        sa[sa_head] = n - 1
        head[s[n - 1]] += 1
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not kind[j]:
                c = s[j]
                sa[head[c]] = j
                head[c] += 1
        tail = tails[:]
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and kind[j]:
                c = s[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    if not lms:
        return passes([])
    is_lms = [False] * n
    for i in lms:
        is_lms[i] = True
    follow = dict(zip(lms, [*lms[1:], n]))
    rank, last, name = {}, -1, -1
    for i in passes(lms):
        if i >= 0 and is_lms[i]:
            a, b = s[i : follow[i] + 1], s[last : follow.get(last, last) + 1]
            if last < 0 or a != b or follow[i] == n or follow[last] == n:
                name += 1
            rank[i], last = name, i
    reduced = [rank[i] for i in lms]
    if name + 1 == len(lms):
        order = [0] * len(lms)
        for k, r in enumerate(reduced):
            order[r] = k
    else:
        order = sort_names(reduced, name + 1)
    return passes([lms[k] for k in order])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte array in their order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    kind = smaller(s)
    lms = leftmost(kind)
    sa = induce(s, kind, lms)
    if len(lms) < 2:
        return sa
    marked = np.zeros(n, bool)
    marked[lms] = True
    names, count = names_of(s, lms, sa[marked[sa]])
    order = np.argsort(names) if count == len(lms) else np.array(sort_names(names.tolist(), count))
    return induce(s, kind, lms[order])


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi) by text position: the position before in suffix order (-1: none), and the
    length of the prefix common with it.  Where the letters before both agree the value is
    one less than its left neighbour's, so only the others are compared, eight bytes a time."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    plain = (here > 0) & (phi > 0)
    plain[plain] = s[here[plain] - 1] == s[phi[plain] - 1]
    ask = np.flatnonzero(~plain & (phi >= 0))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.concatenate([s, np.zeros(8, np.uint8)]), 8)).view("<u8").ravel()
    length = np.zeros(n, np.int64)
    a, b, live = ask.copy(), phi[ask], ask
    while len(live):
        room = n - np.maximum(a, b)
        differ = words[a] ^ words[b]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        got = np.minimum(same, room)
        length[live] += got
        on = (same == 8) & (room > 8)
        a, b, live = a[on] + 8, b[on] + 8, live[on]
    anchor = np.where(plain, -1, here)
    anchor = np.maximum.accumulate(anchor)
    return np.where(phi < 0, 0, np.maximum(0, length[anchor] - (here - anchor))), phi

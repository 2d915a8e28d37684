"""Suffix arrays by two-stage sorting, to a depth.

Only suffixes that are smaller than their successors are sorted directly; all
others are induced by one scan over the buckets of first bytes, and adjacent
common prefixes follow. Suffixes that agree on ``depth`` bytes may be in any
order. Memory is about 90 bytes for each byte of text.
"""

from __future__ import annotations

import numpy as np


def words8(t: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros after the end."""
    n = len(t)
    w = np.zeros(n + depth + 8, np.uint64)
    w[:n] = t
    for k in (1, 2, 4):
        w[: -k] = (w[:-k] << np.uint64(8 * k)) | w[k:]
        w[-k:] <<= np.uint64(8 * k)
    return w


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the suffix after it; the last one isn't."""
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
    up = np.zeros(len(ends), bool)
    up[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
    return np.repeat(up, np.diff(ends, prepend=-1))


def sort_direct(s: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``s`` in order of their first bytes, eight at a time: only those that still agree with a neighbour are sorted on."""
    s = s[np.argsort(w[s])]
    new = np.ones(len(s), bool)
    new[1:] = w[s[1:]] != w[s[:-1]]
    for k in range(8, depth, 8):
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            break
        key = w[s[at] + k]
        by = np.argsort(key)
        rank = np.empty(len(at), np.int64)
        rank[by] = np.cumsum(np.append(0, key[by[1:]] != key[by[:-1]]))
        order = np.argsort(np.cumsum(new[at]) << 32 | rank)
        s[at], key = s[at[order]], key[order]
        new[at[1:]] |= key[1:] != key[:-1]
    return s


def two_stage(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the bytes ``t``, and words8 of t."""
    n = len(t)
    w = words8(t, depth)
    if not n:
        return np.zeros(0, np.int64), w
    small = smaller_than_next(t)
    s = np.flatnonzero(small)
    s = sort_direct(s, w, depth)
    at = np.searchsorted(t[s], np.arange(257))  # bounds of each first byte in the sorted ones
    came: list[list[np.ndarray]] = [[] for _ in range(256)]
    came[t[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the smallest of all
    out: list[np.ndarray] = []

    def induce(seg: np.ndarray, c: int) -> np.ndarray:
        before = seg[seg > 0] - 1
        before = before[~small[before]]
        first = t[before]
        same = before[first == c]
        rest = before[first != c]
        first = t[rest]
        order = np.argsort(first, kind="stable")
        rest, first = rest[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(rest, cuts) if len(rest) else ():
            came[t[part[0]]].append(part)
        return same

    for c in range(256):
        seg = np.concatenate(came[c]) if came[c] else np.zeros(0, np.int64)
        while len(seg):
            out.append(seg)
            seg = induce(seg, c)
        direct = s[at[c] : at[c + 1]]
        if len(direct):
            out.append(direct)
            induce(direct, c)
    return np.concatenate(out), w


def adjacent_prefixes(sa: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix of ``sa`` with the one before it, up to ``depth`` bytes; the first has 0."""
    lcp = np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    for k in range(0, depth, 8):
        d = w[sa[live] + k] ^ w[sa[live - 1] + k]
        lead = np.full(len(d), 8)
        odd = d != 0
        x, zeros = d[odd], np.zeros(int(odd.sum()), np.int64)
        for byte in range(1, 8):
            zeros += (x >> np.uint64(64 - 8 * byte)) == 0
        lead[odd] = zeros
        lcp[live] += lead
        live = live[~odd]
    return np.minimum(lcp, depth)

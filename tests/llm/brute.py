"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import re

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
GRAPH = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def byte_repeats(docs, width=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256); ids are distinct."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < i:
                gone[s : s + width] = [True] * width
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def word_repeats(docs, width=20):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first = {}
    split = {i: GRAPH.findall(t or "") for i, t in docs}
    for i in sorted(split):
        w = split[i]
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), (i, s))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone[s : s + width] = [True] * width
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def benchmark_hits(docs, items, width=10):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    split = lambda t: ALNUM.findall((t or "").translate(ASCII_LOWER))
    names = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            names.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    sizes = {len(k) for k in names}
    out = {}
    for i, t in docs:
        w = split(t)
        hit, got = [False] * len(w), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in names:
                    hit[s : s + n] = [True] * n
                    got |= names[tuple(w[s : s + n])]
        out[i] = (len(w), sum(hit), len(got), sha(",".join(sorted(got)).encode()), any(hit))
    return out


def jaccard_components(docs, gram=4, num=85, den=100):
    """doc_id -> (n_shingles, component_id, n_links)."""
    sets = {}
    for i, t in docs:
        w = GRAPH.findall((t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[s : s + gram]) for s in range(len(w) - gram + 1)} if len(w) >= gram else {tuple(w)} if w else set()
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if den * len(sets[i]) < num * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}

"""Cheapest edits of role/fault sequences: Re-Pair rules, one min-plus transfer matrix with audit ropes for each.

States say what the kept roles so far look like: 0 nothing, 1 a system row, 2 after a user row, 3 after an assistant row; a
conversation ends in 0 or 3. A cell (i, j) of a matrix is the least cost of edits that lead from i to j and the ASCII-least of
the audits with it. Audits that share a cell and a cost are never prefixes of each other (letters fix the path, and more
insertions cost more), so the least audit of a concatenation is made of least parts.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
USER, ASSISTANT = {0, 1, 3}, {2}  # states in which such a row may come
MOD, BASE = (1 << 61) - 1, 1_000_003_019


class Rope:
    """A string as a tree of shared parts, with its length and a polynomial hash."""

    __slots__ = ("n", "h", "a", "b", "p")

    def __init__(self, a, b=None):
        self.a, self.b = a, b
        if b is None:
            self.n, h = len(a), 0
            for c in a:
                h = (h * BASE + ord(c) + 1) % MOD
            self.h, self.p = h, pow(BASE, len(a), MOD)
        else:
            self.n, self.h, self.p = a.n + b.n, (a.h * b.p + b.h) % MOD, a.p * b.p % MOD

    def __add__(self, other: "Rope") -> "Rope":
        return other if not self.n else self if not other.n else Rope(self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.b is None:
                out.append(x.a)
            else:
                todo += (x.b, x.a)
        return "".join(out)

    def __lt__(self, other: "Rope") -> bool:
        """By the first difference; equal parts are skipped by their hashes."""
        left, right = [self], [other]
        while left and right:
            x, y = left.pop(), right.pop()
            if x is y or (x.n == y.n and x.h == y.h):
                continue
            if x.b is None and y.b is None:
                k = min(x.n, y.n)
                if x.a[:k] != y.a[:k]:
                    return x.a < y.a
                if x.n > k:
                    left.append(Rope(x.a[k:]))
                if y.n > k:
                    right.append(Rope(y.a[k:]))
            elif y.b is None or (x.b is not None and x.n >= y.n):
                left += (x.b, x.a)
                right.append(y)
            else:
                left.append(x)
                right += (y.b, y.a)
        return bool(right) and any(y.n for y in right) and not any(x.n for x in left)


Cell = tuple[int, Rope]
Matrix = list[list["Cell | None"]]
EMPTY = Rope("")


def better(x: Cell | None, y: Cell | None) -> Cell | None:
    if x is None or y is None:
        return y if x is None else x
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if y[1] < x[1] else x


def through(row: list[Cell | None], m: Matrix) -> list[Cell | None]:
    """A vector times a matrix in the (min, then concatenate) algebra."""
    out: list[Cell | None] = [None] * 4
    for j, x in enumerate(row):
        if x is not None:
            for k, y in enumerate(m[j]):
                if y is not None:
                    cost, have = x[0] + y[0], out[k]
                    if have is None or cost <= have[0]:
                        out[k] = better(have, (cost, x[1] + y[1]))
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return [through(row, b) for row in a]


def _inserts() -> Matrix:
    """Any number of inserted rows: the fewest from state to state."""
    m: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at = i
        for n in range(3):
            m[i][at] = m[i][at] or (INSERT * n, Rope("I" * n))
            at = 3 if at in ASSISTANT else 2
    return m


INSERTS = _inserts()


def _row(symbol: int) -> Matrix:
    """Insertions, then one row's edit. Symbol 0 has to be deleted; else 1 + 2 * role (s, u, a, other) + truncated."""
    m: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        m[i][i] = (DELETE, Rope("D"))
        if symbol:
            role, more = divmod(symbol - 1, 2)
            more *= TRUNCATED
            to = 3 if i in ASSISTANT else 2
            m[i][to] = better(m[i][to], (REROLE + more, Rope("R")))
            keep = 1 if role == 0 and i == 0 else 2 if role == 1 and i in USER else 3 if role == 2 and i in ASSISTANT else None
            if keep is not None:
                m[i][keep] = better(m[i][keep], (more, Rope("K")))
    return product(INSERTS, m)


SYMBOLS = [_row(s) for s in range(9)]


def grammar(sequences: list[list[int]], least: int = 4) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair: the most frequent pair of symbols becomes a rule (numbers from 9 on) as long as it occurs ``least`` times; rules, rewritten sequences."""
    seqs, rules = [list(s) for s in sequences], []
    count: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)

    def tally(k: int, sign: int) -> set[tuple[int, int]]:
        s = seqs[k]
        pairs = list(zip(s, s[1:]))
        for p in pairs:
            count[p] += sign
            where[p].add(k) if sign > 0 else where[p].discard(k)
        return set(pairs)

    for k in range(len(seqs)):
        tally(k, 1)
    heap = [(-n, p) for p, n in count.items() if n >= least]
    heapq.heapify(heap)
    while heap:
        n, pair = heapq.heappop(heap)
        now = count[pair]
        if now < least:
            continue
        if now != -n:
            heapq.heappush(heap, (-now, pair))
            continue
        new, changed = 9 + len(rules), set()
        rules.append(pair)
        for k in sorted(where[pair]):
            tally(k, -1)
            s, out, i = seqs[k], [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[k] = out
            changed |= tally(k, 1)
        count[pair] = 0
        for p in changed:
            if new in p and count[p] >= least:
                heapq.heappush(heap, (-count[p], p))
    return rules, seqs


def matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    """Of all symbols, then of each rule, bottom-up."""
    out = list(SYMBOLS)
    for a, b in rules:
        out.append(product(out[a], out[b]))
    return out


START: list[Cell | None] = [(0, EMPTY), None, None, None]


def finish(row: list[Cell | None]) -> Cell:
    """The cheapest accepted end, insertions at the end included; no rows at all cost nothing."""
    end = through(row, INSERTS)
    return better(end[0], end[3]) or (0, EMPTY)

"""Arrow text columns as numpy byte arrays: slices of bounded size, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once; longer texts are cut where no word is.
SLICE = 1 << 19

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the n + 1 offsets of n texts; null texts are empty."""
    col = col.cast(pa.large_string()).fill_null("")
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def ids(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """int64 document ids; null ids come after all others."""
    return col.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        inv = U(pow(int(_P), -1, 1 << 64))
        for k, base in ((0, _P), (1, inv)):
            a = np.full(n, base, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def is_word(chars: str) -> np.ndarray:
    """Byte table of word bytes: 'graph' for all but white space, 'alnum' for letters, digits and everything beyond ASCII."""
    t = np.ones(256, bool)
    if chars == "graph":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:128] = [chr(b).isalnum() for b in range(128)]
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray, word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word, in text order; words never cross texts."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + SLICE)
        while b < n:  # cut after a byte that is in no word, or at a text's end
            cut = np.flatnonzero(~word[data[a:b]])
            ends = offs[np.searchsorted(offs, a, "right") : np.searchsorted(offs, b, "right")]
            best = max(a + int(cut[-1]) + 1 if len(cut) else a, int(ends[-1]) if len(ends) else a)
            if best > a:
                b = best
                break
            b = min(n, b + SLICE)
        x = data[a:b]
        if lower:
            x = _LOWER[x]
        inside = word[x]
        first = offs[np.searchsorted(offs, a) : np.searchsorted(offs, b)] - a  # text starts in the slice
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[first] = inside[first]
        s = np.flatnonzero(start)
        if len(s):
            last = np.zeros(len(x) + 1, bool)
            last[1:] = inside
            last[1:-1] &= ~inside[1:]
            f = first[first > 0]
            last[f] = inside[f - 1]
            e = np.flatnonzero(last)
            p, inv = _pow(len(x))
            sums = np.zeros(len(x) + 1, U)
            np.cumsum(_TABLE[x] * p, out=sums[1:])
            out.append((s + a, e + a, mix((sums[e] - sums[s]) * inv[s])))
        a = b
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(k) for k in zip(*out))  # type: ignore[return-value]


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive elements: len(x) - k + 1 of them."""
    if len(x) < k:
        return np.zeros(0, U)
    done, have, power, size = None, 0, x, 1
    p = lambda e: U(pow(int(_P), e, 1 << 64))
    while True:
        if k & size:
            m = len(x) - have - size + 1
            done = power[: len(power)] if done is None else done[:m] + p(have) * power[have : have + m]
            have += size
        if have == k:
            return done[: len(x) - k + 1]
        power = power[:-size] + p(size) * power[size:]
        size *= 2


def byte_values(x: np.ndarray) -> np.ndarray:
    return _TABLE[x]


def slices(bounds: np.ndarray, overlap: int, limit: int = SLICE) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first element, end element): rows up to ``limit`` elements together; a longer row alone, in pieces that share ``overlap`` elements."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        a, b = int(bounds[i]), int(bounds[j])
        if j > i + 1 or b - a <= limit:
            yield i, j, a, b
        else:
            for at in range(a, max(a + 1, b - overlap), limit):
                yield i, j, at, min(b, at + limit + overlap)
        i = j


def pack(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, low bytes of all first: equal high bytes compress away."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(b: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel().astype(U)

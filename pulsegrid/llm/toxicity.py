"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (letters, bytes
   beyond ASCII, word boundaries; a table of bounded size).
2. Tokens that look obfuscated (digits or signs among letters, letters three
   times or more, letters spaced out) become character lattices; Viterbi search
   under channel costs and the character model gives the likeliest reading. All
   other tokens have one path, themselves.
3. Words of the restored text and their beginnings have log-odds, learned from
   labelled rows; a logistic function of a document's strongest and number of
   strong words gives the score.

Labels are learned from a bounded sample by hash (TOXIC and CLEAN rows about);
repeated labels of an id count as the largest. Null and empty texts, and all
texts where nothing was learned, have the score of a text without strong words.
Repeated rows give repeated rows; extra columns are ignored; only the text is
an input of a score. A null doc_id counts as the empty text in the split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables
from . import textblock as tb
from .language_id import _rows, split_of

#: Labelled rows that are learned from, at most (about); they bound the features too.
TOXIC, CLEAN = 20_000, 60_000
#: A feature has to be in so many toxic texts, and a word this log-odds, to be strong.
LEAST, STRONG = 5, 2.5
#: Symbols: 0 boundary, 1-26 letters, 27-154 bytes beyond ASCII.
SYMBOLS = 155
SYMBOL = np.zeros(256, np.int64)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
LETTERS = SYMBOL > 0

# Letters that digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
AS_LETTER, AS_BOUNDARY, ONCE, TWICE, JOIN, PART = 0.5, 5.0, 0.0, 1.0, 0.2, 6.0
_SIGNS = regex.escape("".join(LEET))
TOKEN = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:\p{{L}}(?:[ .\-_*]{{1,2}}\p{{L}}){{3,}}(?!\p{{L}})|[\p{{L}}{_SIGNS}]*\p{{L}}[\p{{L}}{_SIGNS}]*)")
SPACED = regex.compile(r"\p{L}(?:[ .\-_*]{1,2}\p{L})+")
#: Signs that end a token without standing for a letter.
TAIL = "!|+*("
#: Classes of characters, as bits; readings of longer tokens aren't remembered.
LETTER, NUMBER, SIGN, TAILED, GAP = 1, 2, 4, 8, 16
REMEMBERED = 64


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and small letter of each code point; planes from 4 on have no letters or numbers."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))
    kind, small = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for bit, chars in ((LETTER, regex.findall(r"\p{L}", every)), (NUMBER, regex.findall(r"\p{N}", every)), (SIGN, LEET), (TAILED, TAIL), (GAP, " .-_*")):
        kind[[ord(c) for c in chars]] |= bit
    for i in np.flatnonzero(kind & LETTER).tolist():
        small[i] = ord(chr(i).lower()[0])
    small[0x3C2] = 0x3C3  # both small sigmas
    return kind, small


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to small letters, in UTF-8 bytes."""
    x = tb._LOWER[data]
    two = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) if len(x) > 1 else np.zeros(0, np.int64)
    x[two + 1] += 0x20
    return x


@dataclass
class CharModel:
    """Costs (negative log-probabilities) of a symbol after two others, from trigram counts: code (first, second, third symbol in base SYMBOLS) and n."""

    code: np.ndarray
    n: np.ndarray

    def __post_init__(self) -> None:
        self.table: memoryview | None = None  # cost of symbol c after a and b at (a * SYMBOLS + b) * SYMBOLS + c

    def __getstate__(self) -> dict:
        return {"code": self.code, "n": self.n, "table": None}  # tasks build the table

    def build(self) -> None:
        if self.table is None:
            tri = np.zeros(SYMBOLS**3, np.float32)
            tri[self.code] = self.n
            tri = tri.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
            bi = tri.sum(0, dtype=np.float64)
            low = ((bi + 0.1) / (bi.sum(1, keepdims=True) + 0.1 * SYMBOLS)).astype(np.float32)
            total = tri.sum(2, dtype=np.float64).astype(np.float32)
            for a in range(SYMBOLS):
                tri[a] = -np.log((tri[a] + 4 * low) / (total[a][:, None] + 4))
            self.table = memoryview(tri.reshape(-1))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Slots of (letters, channel cost); '' is nothing and ' ' a boundary. Among spaced letters, a wider gap than the least one may as well be a boundary."""
    spaced = SPACED.fullmatch(token) is not None
    least = min(map(len, regex.findall(r"\P{L}+", token))) if spaced else 0
    slots: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        ch = token[i]
        j = i
        while j < len(token) and token[j] == ch:
            j += 1
        if spaced and not ch.isalpha():
            while j < len(token) and not token[j].isalpha():
                j += 1
            slots.append([("", JOIN), (" ", PART if j - i == least else JOIN)])
            i = j
        elif ch in LEET:
            slots.append([(x, AS_LETTER) for x in LEET[ch]] + [(" ", AS_BOUNDARY)])
            i += 1
        elif j - i >= 2:
            slots.append([(ch, ONCE if j - i > 2 else TWICE), (ch * 2, TWICE if j - i > 2 else ONCE)])
            i = j
        else:
            slots.append([(ch, 0.0)])
            i = j
    return slots


def viterbi(slots: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The cheapest path through a lattice, between word boundaries; states are the last two symbols, with the path that leads there."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    table = model.table
    for options in [*slots, [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for letters, price in options:
            symbols = [int(SYMBOL[b]) for b in letters.encode()]
            for (a, b), (cost, path) in states.items():
                cost += price
                for s in symbols:
                    cost += table[(a * SYMBOLS + b) * SYMBOLS + s]
                    a, b = b, s
                if (a, b) not in new or cost < new[a, b][0]:
                    new[a, b] = (cost, (path, letters) if letters else path)
        states = new  # at most the pairs of last symbols that two slots' options spell: no bound is needed
    least = min(cost for cost, _ in states.values())
    return min(_spelled(path) for cost, path in states.values() if cost == least).strip()


def _spelled(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


class Restorer:
    """Restored texts; readings of tokens are remembered up to a bound."""

    def __init__(self, model: CharModel):
        model.build()
        self.model, self.known = model, {}

    def suspects(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts that have any token worth a lattice, by the rules of TOKEN and read()."""
        found = [i + self._odd(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in _rows(offs, 1 << 19)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _odd(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        try:
            code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            return np.arange(len(offs) - 1)
        starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
        code = np.insert(code, starts[:-1], 10)  # a line end before each text
        starts = starts + np.arange(len(starts))
        kind, small = _characters()
        k, x = np.append(kind[code], np.uint8(0)), small[code]
        letter, sign, tail = (k & LETTER) > 0, (k & SIGN) > 0, (k & TAILED) > 0
        at = []
        # runs of letters and signs that have a letter and a sign before their tail
        run = letter | sign
        inner = sign & ~tail
        inner[:-1] |= tail[:-1] & run[1:] & ~tail[1:]
        edge = np.diff(run.astype(np.int8), prepend=np.int8(0))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letters, inners = (np.concatenate(([0], np.cumsum(m))) for m in (letter, inner))
        at.append(first[(letters[end] > letters[first]) & (inners[end] > inners[first])])
        # a letter three times
        if len(x) > 2:
            at.append(np.flatnonzero((x[2:] == x[1:-1]) & (x[1:-1] == x[:-2]) & letter[2:-1]))
        # four single letters with gaps of one or two between them
        spot = np.flatnonzero(letter)
        if len(spot) > 3:
            gaps = np.concatenate(([0], np.cumsum((k & GAP) > 0)))
            far = np.diff(spot)
            near = (far >= 2) & (far <= 3) & (gaps[spot[1:]] - gaps[spot[:-1]] == far - 1)
            begin = (k[spot[:-3] - 1] & (LETTER | NUMBER)) == 0
            at.append(spot[:-3][near[:-2] & near[1:-1] & near[2:] & begin & ~letter[spot[3:] + 1]])
        return np.unique(np.searchsorted(starts, np.concatenate(at), "right") - 1)

    def read(self, token: str) -> str:
        low = token.lower()
        got = self.known.get(low)
        if got is None:
            core = low.rstrip(TAIL)
            odd = SPACED.fullmatch(core) or any(c in LEET for c in core) or any(core[i] == core[i + 1] == core[i + 2] for i in range(len(core) - 2))
            got = viterbi(lattice(core), self.model) if odd and any(c.isalpha() for c in core) else low
            if len(self.known) > 200_000:
                self.known.clear()
            if len(low) <= REMEMBERED:
                self.known[low] = got
        return got

    def restore(self, text: str) -> str:
        return TOKEN.sub(lambda m: self.read(m[0]), text)

    def restored(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets with suspect texts restored."""
        odd = self.suspects(data, offs)
        if not len(odd):
            return data, offs
        raw, parts, at = data.tobytes(), [], 0
        n = np.diff(offs)
        for i in odd.tolist():
            new = self.restore(raw[offs[i] : offs[i + 1]].decode("utf-8", "replace")).encode()
            parts += [raw[at : offs[i]], new]
            at = int(offs[i + 1])
            n[i] = len(new)
        parts.append(raw[at:])
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(n)))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each word, and (words, 4) feature hashes: the word and its first 4, 5 and 6 bytes (0: none)."""
    x = lower(data)
    s, e, h = tb.words(x, offs, LETTERS, False)
    out = np.zeros((len(s), 4), np.uint64)
    out[:, 0] = h
    v = tb.byte_values(x)
    for col, k in ((1, 4), (2, 5), (3, 6)):
        long = e - s >= k
        if long.any():
            out[long, col] = tb.mix(tb.grams(v, k)[s[long]] + np.uint64(k))
    return np.searchsorted(offs, s, "right") - 1, out


@dataclass
class Model:
    chars: CharModel
    keys: np.ndarray  # sorted feature hashes
    odds: np.ndarray
    weights: np.ndarray  # of 1, strongest word, number of strong words


def measures(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, 2): log-odds of the strongest word, log(1 + strong words)."""
    row, f = features(data, offs)
    out = np.zeros((len(offs) - 1, 2))
    if len(model.keys) and len(row):
        at = np.minimum(np.searchsorted(model.keys, f), len(model.keys) - 1)
        odds = np.where(model.keys[at] == f, model.odds[at], 0.0).max(1)
        np.maximum.at(out[:, 0], row, odds)
        out[:, 1] = np.log1p(np.bincount(row, odds >= STRONG, len(out)))
    return out


def count_characters(docs: DataFrame, text: str = "text") -> DataFrame:
    """code, n: symbol trigrams of all texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            data, offs = tb.buffers(b.column(0))
            for i, j in _rows(offs):
                x = SYMBOL[lower(data[offs[i] : offs[j]])]
                x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))] if len(x) else x  # one boundary between words
                if len(x) > 2:
                    code, n = np.unique((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], return_counts=True)
                    total[code] += n
        on = np.flatnonzero(total)
        yield pa.record_batch([pa.array(on), pa.array(total[on])], ["code", "n"])

    return docs.select(text).mapInArrow(tables.released(each), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, every = tb.buffers(b.column("t"))
        for x, y in _rows(every):
            offs = every[x : y + 1] - every[x]
            s, _, h = tb.words(data[every[x] : every[y]], offs, LETTERS, True)
            bounds = np.searchsorted(s, offs)
            sign = [int(tb.mix(tb.grams(h[i:j], min(4, j - i))).min().view(np.int64)) if j > i else 0 for i, j in zip(bounds[:-1], bounds[1:])]
            part = b.slice(x, y - x)
            yield pa.record_batch([part.column("_id").cast(pa.int64()), part.column("y"), pa.array(sign, pa.int64())], ["_id", "y", "sign"])


def _sampled(docs: DataFrame, labels: DataFrame, learn: Column, text: str, doc_id: str, toxic: int, clean: int) -> DataFrame:
    """text, y of the learning rows; the labels that are joined are bounded and broadcast."""
    y = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).filter(learn).groupBy("_id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in y.groupBy("y").count().collect() if r["y"] in (0, 1)}
    part = lambda k, most: min(1.0, most / max(1, n.get(k, 0)))
    share = F.when(F.col("y") == 1, F.lit(part(1, toxic))).when(F.col("y") == 0, F.lit(part(0, clean))).otherwise(F.lit(0.0))
    kept = y.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t"))
    # one text of each group of copies: near copies share the smallest hash of their word quadruples
    marked = texts.join(F.broadcast(kept), "_id").mapInArrow(tables.released(_copies), "_id long, y int, sign long")
    single = tables.checkpoint(marked.groupBy("sign", "y").agg(F.min("_id").alias("_id")).select("_id", "y"))
    return texts.join(F.broadcast(single), "_id").select("t", "y")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """``learn`` is a condition on the column _id of the labels."""
    sc = docs.sparkSession.sparkContext
    tables.bounded_batches(docs.sparkSession)
    counts = count_characters(docs, text).toArrow()  # at most SYMBOLS cubed rows of two numbers
    chars = CharModel(counts.column("code").to_numpy().astype(np.int32), counts.column("n").to_numpy())
    rows = _sampled(docs, labels, learn, text, doc_id, toxic, clean)
    shared = sc.broadcast(chars)

    def counted(only):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(shared.value)
            for b in batches:
                data, offs = tb.buffers(b.column("t"))
                for i, j in _rows(offs):
                    row, f = features(*restorer.restored(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                    key, doc = f.ravel(), np.repeat(row, 4)
                    ok = key != 0
                    if only is not None:
                        ok &= only.value[np.minimum(np.searchsorted(only.value, key), len(only.value) - 1)] == key
                    key, doc = key[ok], doc[ok]
                    order = np.lexsort((doc, key))
                    key, doc = key[order], doc[order]
                    first = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
                    k, n = np.unique(key[first], return_counts=True)  # texts with the feature
                    yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

        return tables.released(each)

    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    bad = rows.filter("y = 1").mapInArrow(counted(None), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).collect()
    keys = np.sort(np.array([r["k"] for r in bad], np.int64).view(np.uint64))
    if not len(keys):
        return Model(chars, keys, np.zeros(0), np.array([-3.0, 0.0, 0.0]))
    wanted = sc.broadcast(keys)
    good = rows.filter("y = 0").mapInArrow(counted(wanted), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    wanted.destroy()
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    for r in bad:
        a[np.searchsorted(keys, np.array([r["k"]], np.int64).view(np.uint64)[0])] = r["n"]
    for r in good:
        b[np.searchsorted(keys, np.array([r["k"]], np.int64).view(np.uint64)[0])] = r["n"]
    n1, n0 = max(1, total.get(1, 0)), max(1, total.get(0, 0))
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 1.0) / (n0 + 1)) - np.sqrt(1 / (a + 0.5) + 1 / (b + 1.0))  # a cautious estimate
    model = Model(chars, keys[odds > 0], odds[odds > 0], np.zeros(3))
    told = sc.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(told.value.chars)
        for x in batches:
            m = _measured(told.value, restorer, x.column("t"))
            yield pa.record_batch([pa.array(m[:, 0]), pa.array(m[:, 1]), x.column("y")], ["a", "b", "y"])

    got = rows.mapInArrow(tables.released(measured), "a double, b double, y int").groupBy(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "y").count().collect()
    told.destroy()
    x = np.array([[1.0, r["a"], r["b"]] for r in got])
    y, n = np.array([r["y"] for r in got], float), np.array([r["count"] for r in got], float)
    n[y == 1] *= min(10.0, n0 / n1)  # both classes weigh alike up to a point
    w = np.array([-3.0, 0.5, 0.5])
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 1.0 * w
        w = w - np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(3), grad)
    model.weights = w
    return model


def _measured(model: Model, restorer: Restorer, col: pa.Array) -> np.ndarray:
    data, offs = tb.buffers(col)
    parts = [measures(model, *restorer.restored(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in _rows(offs)]
    return np.concatenate(parts) if parts else np.zeros((0, 2))


def scores(model: Model, restorer: Restorer, col: pa.Array) -> np.ndarray:
    m = _measured(model, restorer, col)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + m @ model.weights[1:], -30, 30)))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(told.value.chars)
        for x in batches:
            s = scores(told.value, restorer, x.column("t"))
            yield pa.record_batch([x.column("doc_id"), x.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), (split_of(F.col(doc_id), 5) == 0).alias("held_out"), F.col(text).alias("t")).mapInArrow(tables.released(each), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows that score under 0.5, with all their columns."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(told.value.chars)
        for x in batches:
            yield x.filter(pa.array(scores(told.value, restorer, x.column(text)) < 0.5))

    return docs.mapInArrow(tables.released(each), docs.schema)

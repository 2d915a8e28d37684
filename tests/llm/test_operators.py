"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cell string, sid string, spans string, label string, t string, `count` int"


def table(spark, rows):
    """doc_id, text (and lang, source) rows as documents with extra columns whose names operators use inside."""
    full = [(i, t, (r + ["en"])[0], (r + ["en", "src0"])[1] if len(r) > 1 else "src0", len(t or ""), "x", "x", "x", "x", "x", 1) for i, t, *r in rows for r in [list(r)]]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, kinds=60):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = words(rng, 120, 5000)
    passage = words(rng, 60, 5000)
    docs = [(0, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, "one two"), (5, "é" * 200), (6, "é" * 200 + "x"), (7, "a" * 300), (8, "ab" * 200)]
    docs += [(10 + k, words(rng, 40 + k, 5000)) for k in range(8)]
    docs += [(20 + k, base) for k in range(3)]
    docs += [(30 + k, base.replace(" ", f" v{k} ", 1)) for k in range(6)]
    docs += [(40 + k, words(rng, 30, 5000) + " " + passage + " " + words(rng, 30, 5000)) for k in range(5)]
    docs += [(50, " ".join(["same words again"] * 60)), (51, words(rng, 3000, 5000) + " " + base)]
    return docs


@pytest.mark.parametrize("cell_bytes,bucket_bytes", [(1 << 22, 1 << 22), (2000, 3000)])
def test_suffix_dedup(spark, corpus, cell_bytes, bucket_bytes):
    from pulsegrid.llm.suffix_dedup import dedup

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup(table(spark, corpus), cell_bytes=cell_bytes, bucket_bytes=bucket_bytes).collect()}
    assert got == brute.byte_repeats(corpus)


@pytest.mark.parametrize("cell_bytes,bucket_bytes", [(1 << 22, 1 << 22), (2000, 3000)])
def test_lz_dedup(spark, corpus, cell_bytes, bucket_bytes):
    from pulsegrid.llm.lz_dedup import dedup

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup(table(spark, corpus), cell_bytes=cell_bytes, bucket_bytes=bucket_bytes).collect()}
    assert got == brute.word_repeats(corpus)


@pytest.mark.parametrize("width", [20, 106, 150, 200])
def test_repeats_of_wide_windows(spark, width):
    from pulsegrid.llm import lz_dedup, suffix_dedup

    rng = random.Random(width)
    parts = [words(rng, n, 500) for n in (40, 130, 210, 260)]
    docs = [(i, " ".join([words(rng, 15, 500), *rng.sample(parts, 2), words(rng, 15, 500)])) for i in range(14)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(table(spark, docs), width).collect()}
    assert got == brute.byte_repeats(docs, width) and any(r[1] for r in got.values())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in lz_dedup.dedup(table(spark, docs), width).collect()}
    assert got == brute.word_repeats(docs, width) and any(r[1] for r in got.values())


def test_two_stage_suffix_sorting():
    from pulsegrid.llm.suffix_array import adjacent_prefixes, two_stage

    rng = np.random.default_rng(0)
    for kinds, n in ((2, 300), (4, 500), (200, 400), (1, 60)):
        t = rng.integers(65, 65 + kinds, n).astype(np.uint8)
        sa, w = two_stage(t, 400 if kinds == 1 else 64)
        raw = t.tobytes()
        cut = [raw[i : i + 64] for i in sa]
        assert sorted(sa.tolist()) == list(range(n)) and cut == sorted(cut)
        lcp = adjacent_prefixes(sa, w, 64)
        for a, b, k in zip(cut, cut[1:], lcp[1:]):
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert k == min(64, same) or (k > same and same == min(len(a), len(b)))


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    from pulsegrid.llm import textblock
    from pulsegrid.llm.lz_dedup import dedup

    monkeypatch.setattr(textblock, "SLICE", 100)
    text = words(random.Random(1), 500)
    s, e, h = textblock.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), textblock.is_word("graph"), False)
    assert [text[a:b] for a, b in zip(s, e)] == text.split()
    assert len(set(h.tolist())) == len(set(text.split()))
    assert dedup(table(spark, [(1, text)])).first().n_words == 500


def test_jaccard_join(spark, corpus):
    from pulsegrid.llm import jaccard_join

    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(table(spark, corpus)).collect()}
    assert got == brute.jaccard_components(corpus)
    assert len({c for _, c, _ in got.values()}) < len(corpus)


def test_near_copies_write_few_pair_rows_in_many_buckets(spark):
    """Rows are written at the ends of runs of common prefix grams, not for each bucket that has one; their sums are the numbers of common grams."""
    from pulsegrid.llm import jaccard_join as jj, textblock as tb

    rng = random.Random(5)
    base = words(rng, 600, 10_000).split()
    texts = []
    for k in range(10):
        w = list(base)
        w[rng.randrange(600)] = f"z{k}"
        texts.append(" ".join(w))
    docs = table(spark, list(enumerate(texts)))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    posts = jj.prefix_postings(docs, spark.sparkContext.broadcast(none), 5, 80, 100, "text", 64).collect()
    row, g = jj.shingles(*tb.buffers(pa.array(texts)), 5)
    sid, n = jj._sids(row, g, len(texts))
    heads = {int(s): set(g[row == i][: int(jj._prefix(n[i], 80, 100) + jj._more(n[i]))].tolist()) for i, s in enumerate(sid)}
    got, rows = {}, 0
    for r in posts:
        got[r.a, r.b] = got.get((r.a, r.b), 0) + r.q
        rows += 1
    assert got == {(a, b): len(heads[a] & heads[b]) for a in heads for b in heads if a < b}
    assert rows <= 12 * len(got)  # some 50 each, if every bucket with a common gram wrote one


@pytest.mark.parametrize("block", [3000, 1 << 20])
def test_jaccard_join_of_chains_and_thresholds(spark, monkeypatch, block):
    from pulsegrid.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "MEETINGS", 50)
    monkeypatch.setattr(jaccard_join, "WIDE", 6)
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 4000)
    rng = random.Random(2)
    docs = []
    for g in range(6):
        w = words(rng, 100, 10_000).split()
        for k in range(12):
            docs.append((len(docs), " ".join(w)))
            w[rng.randrange(100)] = f"z{g}_{k}"
            if k % 3 == 0:
                w[rng.randrange(100)] = f"y{g}_{k}"
    rng.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(table(spark, docs), bucket_bytes=2000, block_bytes=block).collect()}
    assert got == brute.jaccard_components(docs)


def test_join_blocks_is_the_plain_join():
    from pulsegrid.llm.jaccard_join import join_blocks

    rng = np.random.default_rng(3)
    base = rng.permutation(1 << 20)[:60].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    more = np.arange(1, 500, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    sets = []
    for _ in range(60):
        x = set(rng.choice(base, rng.integers(48, 61), replace=False).tolist()) | set(rng.choice(more, rng.integers(0, 5)).tolist())
        sets.append(np.array(sorted(x), np.uint64))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    everyone = np.ones(60, bool)
    a, b = join_blocks(sets, everyone, everyone, True, 85, 100)
    assert len(a) == len(want) > 20 and set(zip(a.tolist(), b.tolist())) == want
    left = np.arange(60) < 25
    a, b = join_blocks(sets, left, ~left, False, 85, 100)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in want if i < 25 <= j}


def test_jaccard_join_of_repeated_and_null_rows(spark):
    from pulsegrid.llm.jaccard_join import join

    text, other = " ".join(f"w{i}" for i in range(300)), " ".join(f"v{i}" for i in range(200_000))
    d = table(spark, [(7, text), (7, text), (9, text + " end"), (None, text), (None, None), (3, ""), (None, "x y"), (1, other), (2, other + " z")])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in join(d).collect()), key=str)
    assert got == sorted([(7, 297, 7, 3), (7, 297, 7, 3), (9, 298, 7, 3), (None, 297, 7, 3), (None, 0, None, 0), (3, 0, 3, 0), (None, 1, None, 0), (1, 199_997, 1, 1), (2, 199_998, 1, 1)], key=str)


def test_keep_one(spark, corpus):
    from pulsegrid.llm.jaccard_join import keep_one

    docs = table(spark, [*corpus, corpus[9], corpus[9]])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {i for i, (n, c, _) in brute.jaccard_components(corpus).items() if n == 0 or c == i}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_decontamination(spark, corpus):
    from pulsegrid.llm.decontaminate import contaminated, digest, remove

    text = dict(corpus)[12].split()
    items = [(1, " ".join(text[5:30])), (2, "one two"), (3, None), (4, "..."), (5, " ".join(text[10:20])), (6, "Never Seen " * 8)]
    docs = [*corpus, (60, "Was it ONE, two? " + " ".join(text[3:25]).upper()), (61, " ".join(text[5:14]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in digest(contaminated(table(spark, docs), bench)).collect()}
    assert got == brute.benchmark_hits(docs, items)
    blocks = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in digest(contaminated(table(spark, docs), bench, block_bytes=60)).collect()}
    assert blocks == got
    clean = {r.doc_id: (r.text, r.n_chars) for r in remove(table(spark, docs), bench).collect()}
    for i, t in docs:
        assert (clean[i][0] == t) == (not got[i][4])
    assert clean[60] == (clean[60][0], len(clean[60][0])) and "ONE" not in clean[60][0] and clean[60][0].startswith("Was it ")


def test_remove_is_the_same_for_any_blocks(spark):
    from pulsegrid.llm.decontaminate import remove

    docs, items = [(900, None), (901, "")], []
    for d in range(12):
        w = [f"d{d}w{k}" for k in range(60)]
        docs.append((d, " ".join(w)))
        # windows that overlap, and one that is there only once the words between have gone
        items += [(3 * d, " ".join(w[10:22])), (3 * d + 1, " ".join(w[17:30])), (3 * d + 2, " ".join(w[5:10] + w[30:35]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = lambda n: {r.doc_id: (r.text, r.n_chars) for r in remove(table(spark, docs), bench, block_bytes=n).collect()}
    one = text(1 << 20)
    assert one[3][0].split() == [f"d3w{k}" for k in range(60) if not 10 <= k < 30] and one[900][0] is None and one[901][0] == ""
    assert text(900) == one  # several passes
    assert text(4000) == one


def test_windows_are_the_distinct_ones_with_all_their_items():
    import pyarrow as pa

    from pulsegrid.llm.decontaminate import windows

    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "..."]
    w = windows(pa.array([str(i % 50) for i in range(len(texts))]), pa.array(texts, pa.string()), 4)
    plain = {}
    for i, t in enumerate(texts):
        x = (t or "").replace(".", "").split()
        for k in range(max(1, len(x) - 3) if x else 0):
            plain.setdefault(tuple(x[k : k + 4]), set()).add(str(i % 50))
    rows = [tuple(v for v in r if v) for r in w.patterns().tolist()]
    assert len(set(rows)) == len(rows) == len(plain)
    letters = {h: x for x in "ab" for h in windows(pa.array(["i"]), pa.array([x]), 4).vocabulary.tolist()}
    named = {tuple(letters[int(w.vocabulary[v - 1])] for v in r): set(w.items(k)) for k, r in enumerate(rows)}
    assert named == plain
    assert len(windows(pa.array(["i"]), pa.array([None], pa.string()), 4).start) == 0


def test_decontamination_of_repeated_rows_null_ids_and_long_documents(spark, monkeypatch):
    from pulsegrid.llm import decontaminate as D

    item = "p q r s t u v w x y"
    rows = [(None, item), (None, item), (3, "lead " + item), (3, "lead " + item), (4, "clean " * 50 + item + " clean" * 50), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, item), ("b", item), ("c", None)], "item_id string, text string")
    for shard in (D.SHARD_BYTES, 64):
        monkeypatch.setattr(D, "SHARD_BYTES", shard)
        got = sorted((str(r.doc_id), r.n_words, tuple(r.spans), tuple(r["items"])) for r in D.contaminated(d, bench).collect())
        both = ("b", "null")
        assert got == sorted([("None", 10, (0, 10), both)] * 2 + [("3", 11, (1, 11), both)] * 2 + [("4", 110, (50, 60), both), ("5", 0, (), ())])


def test_fm_index():
    from pulsegrid.llm.fm_index import FMIndex

    x = np.random.default_rng(1).integers(1, 6, 700)
    index = FMIndex(x, 5)
    for n in (1, 2, 4):
        pats = np.random.default_rng(n).integers(1, 6, (30, n))
        lo, hi = index.search(pats)
        for p, a, b in zip(pats, lo, hi):
            want = [i for i in range(len(x) - n + 1) if (x[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_scan(spark):
    from pulsegrid.llm.secret_scan import digest, redact, scan

    key, copied, opaque = "AKIA" + "Q7" * 8, "token = \"deadbeefdeadbeefdeadbeef99\"", "zX9-kk42mmQ7_pp31ww88"
    docs = [
        (1, f"é😀 {key} and PassWord: 'abc123+/=' end", "en", "a"), (2, f"say {copied} ok", "en", "a"), (3, f"say {copied}", "fr", "b"), (4, copied + copied, "en", "c"),
        (5, "secret=token:abcdef token=abc apikey==abcdefgh", "en", "a"), (6, None, None, None), (7, "", "en", "b"), (8, f"x {opaque} y", "en", "a"), (9, "AKIAAKIA" + "B" * 11, "en", "a"), (9, "AKIAAKIA" + "B" * 11, "en", "a"),
    ]
    rows = digest(scan(table(spark, docs))).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = next(d[1] for d in docs if d[0] == r.doc_id) or ""
        want = base_spans(t)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
    by = {r.doc_id: r for r in rows}
    assert by[8].spans == f"owned:2:{2 + len(opaque)}" and by[1].n_live == 2
    assert by[2].n_example == 2 and by[2].n_live == 0  # three owners hold it
    masked = {r.doc_id: r for r in redact(table(spark, docs)).collect()}
    assert masked[1].text == "é😀 [SECRET] and [SECRET]' end" and masked[1].n_chars == len(masked[1].text)
    assert masked[2].text == docs[1][1] and masked[6].text is None and masked[8].text == "x [SECRET] y"


def test_secret_scan_of_very_many_matches(spark):
    from pulsegrid.llm import secret_scan as S

    rng = random.Random(8)
    alphabet = string.ascii_letters + string.digits

    def text(n):
        some = [
            lambda: "password=" + "".join(rng.choices(alphabet, k=9)), lambda: "AKIA" + "".join(rng.choices("ABCD0123", k=18)), lambda: "".join(rng.choices("0123456789abcdef", k=30)),
            lambda: "".join(rng.choices(alphabet + "_-", k=25)), lambda: "my_token:" + "".join(rng.choices(alphabet + "/", k=40)), lambda: "\u00e4\u20ac plain",
        ]
        return rng.choice(["", "x "]) + rng.choice([" ", "\n", "."]).join(rng.choice(some)() for _ in range(n))

    texts = [text(n) for n in (0, 1, 2, 3, 4, 5, 9, 16, 17, 40, 300)]
    spans = lambda t, k, p, g, least: [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[g]) >= least]
    plain = {}
    for i, t in enumerate(texts):
        base = sorted(spans(t, 0, S.ASSIGN, 2, 6) + spans(t, 1, S.ACCESS, 0, 20) + spans(t, 2, S.HEX, 0, 24))
        digits = lambda v: sum(c.isdigit() for c in v) >= 4 and sum(c.isalpha() for c in v) >= 4
        more = [s for s in spans(t, 3, S.OPAQUE, 0, 20) if digits(t[s[0] : s[2]]) and not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        plain[i] = (base, sorted(base + more))
    d = table(spark, list(enumerate(texts)))
    got = {r.doc_id: ([(s.start, s.kind, s.end) for s in r.base], [(s.start, s.kind, s.end) for s in r.spans]) for r in S.scan(d, max_owners=99, max_repositories=99).collect()}
    assert got == plain
    clean = {r.doc_id: r.text for r in S.redact(d, max_owners=99, max_repositories=99).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for a, _, b in plain[i][1]:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert clean[i] == out + t[at:]
    # all values hot, and joined all the same
    hot = table(spark, [(i, "password=hunter2secret") for i in range(50)])
    assert [len(r.spans) for r in S.scan(hot).collect()] == [1] * 50
    big = table(spark, [(1, text(16000))])
    assert len(S.scan(big, max_owners=99, max_repositories=99).collect()[0].spans) > 12000


def test_sharding(spark, corpus):
    from pulsegrid.llm.sharding import layout, shard_documents, shard_of

    docs = [*corpus, *[(1000 + i, f"t{i}") for i in range(3000)], (None, "x"), (3, "one two")]
    rows = shard_documents(table(spark, docs), 40, rows_per_chunk=20).collect()
    assert len(rows) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, set()).add((t or "").encode())
    slots = {}
    for r in rows:
        assert (r["size"], r.text_crc32) in {(len(b) + 16, zlib.crc32(b)) for b in texts[r.doc_id]}
        assert r.law == "key" and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {40}
    n = np.bincount([r.shard for r in rows], minlength=40)
    assert n.min() > 30 and n.max() < 140
    # draw by draw, as Spark hashes: the id, then the child's name
    def plain(key, node):
        while node.children:
            seed = 42 if key is None else xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
            u = lambda c: ((xxhash.xxh64(c.name.encode(), seed=seed).intdigest() & ((1 << 52) - 1)) + 0.5) / (1 << 52)  # noqa: E731, B023
            node = min(node.children, key=lambda c: (-math.log(u(c)) / c.weight, c.name))
        return node.shard

    assert all((r.shard, r.grown_shard) == (plain(r.doc_id, layout(40, 40)), plain(r.doc_id, layout(41, 40))) for r in rows)
    # a change of one weight moves keys only into or out of subtrees whose weight changes
    keys = spark.range(4000)
    before, after = layout(16, 16), layout(16, 16, weights={5: 3.0})
    moved = keys.select(shard_of(F.col("id"), before).alias("a"), shard_of(F.col("id"), after).alias("b")).filter("a <> b").collect()
    region = {s: next(c.name for c in before.children if any(x.shard == s for k in c.children for x in k.children)) for s in range(16)}
    assert moved and all(region[r.b] == region[5] for r in moved)


def test_bpe(spark, corpus):
    import public_tokenizers as P
    import tiktoken

    from pulsegrid.llm.bpe import decode, encode, encoded, round_trip

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    docs = [*corpus, (70, "".join(rng.choice("abcdeno ththe\n'") for _ in range(900))), (71, "a" * 500), (72, "".join(rng.choice("abcdenoth") for _ in range(400))), (73, "<|endoftext|> 日本語 I'm  \n ok"), (73, "<|endoftext|> 日本語 I'm  \n ok")]
    d = table(spark, docs)
    want = {i: tik.encode_ordinary(t or "") for i, t in docs}
    got = encode(d, path, P.PATTERN)
    assert {r.doc_id: r.ids for r in got.collect()} == want
    assert {r.doc_id: bytes(r.bytes).decode() for r in decode(got, path, P.PATTERN).collect()} == {i: t or "" for i, t in docs}
    for r in round_trip(d, path, P.PATTERN).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((dict(docs)[r.doc_id] or "").encode()).hexdigest()
    assert encoded(d, path, P.PATTERN).count() == len(docs)


@pytest.mark.parametrize("letters", ["a", "ab", "an", "aab", "ing ", "=-", "abcdefghijklmnopqrstuvwxyz"])
def test_bpe_of_long_words(letters):
    import public_tokenizers as P
    import tiktoken

    from pulsegrid.llm.bpe import Codec, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    tik, codec, rng = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={}), Codec(path, P.PATTERN), random.Random(4)
    for text in (letters * 400, "".join(rng.choice(letters) for _ in range(1500)), "".join(rng.choice(letters) for _ in range(3000))):
        assert codec.encode(text).tolist() == tik.encode_ordinary(text)
    if len(letters) == 1:
        text = letters * 1_000_000  # a word of a million letters
        ids = codec.encode(text)
        assert len(ids) == 250_000 and codec.decode_all([ids]) == [text.encode()]


def test_lattice_points():
    from pulsegrid.llm.lattice_dedup import ROOTS, nearest_point

    assert len(ROOTS) == 240 and np.allclose((ROOTS**2).sum(1), 2) and len(np.unique(ROOTS, axis=0)) == 240
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = nearest_point(x)
    twice = np.rint(p * 2)
    assert np.allclose(p * 2, twice) and ((twice % 2 == twice[:, :1] % 2).all()) and (p.sum(1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    assert (d[:, None] <= (((x - p)[:, None] - ROOTS) ** 2).sum(2) + 1e-9).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_near_dedup(spark, block):
    from pulsegrid.llm.lattice_dedup import near_dedup

    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        c = rng.normal(size=32)
        for _ in range(1 + 6 * (g % 5)):
            rows.append((len(rows), (c + rng.normal(size=32) * 0.08).astype(np.float32).tolist(), g % 3))
    rows += [(len(rows) + k, rows[5][1], rows[5][2]) for k in range(4)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] + [1.0] * 31, 1), (n + 3, rows[5][1], None), (n + 4, [None] + [1.0] * 31, 1), (n + 5, [], 1), (n + 6, [1.0] * 8, 1), (n + 7, [float("inf")] + [1.0] * 31, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: r for r in near_dedup(df, block=block).collect()}
    assert len(got) == len(rows)
    x = np.array([np.asarray(v, np.float32) for _, v, _ in rows[:n]], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([y for _, _, y in rows[:n]])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    total = link.sum()
    found = sum(got[i].n_links for i in range(n))
    assert all(got[i].n_links <= link[i].sum() for i in range(n)) and found >= 0.9 * total > 0
    for i in range(n):
        assert got[i].kept == (got[i].component_id == i) and got[i].component_id <= i
    for i in range(n, len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


LANGS = {"aa": "lo mi ka tu re pa", "bb": "sch und ber ein ich ung", "cc": "é ça ouè aux eau lé"}


def test_language_id(spark):
    from pulsegrid.llm.language_id import fit, identify, split_of

    rng = random.Random(3)
    docs = [(i, " ".join("".join(rng.choice(LANGS[lang].split()) for _ in range(2)) for _ in range(60)), lang) for i in range(240) for lang in [list(LANGS)[i % 3]]]
    odd = [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, docs[0][1], None), (904, docs[1][1] * 40, "bb")]
    d = table(spark, [*docs, *odd])
    got = {r.doc_id: r for r in identify(d, fit(d, split_of(F.col("doc_id"), 3) != 1)).collect()}
    assert len(got) == len(docs) + len(odd)
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].lang_pred == dict((a, c) for a, _, c in docs)[i] for i in held]) > 0.95
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and got[904].lang_pred == "bb" and 0 <= got[904].score <= 1
    none = identify(d.limit(3), fit(d.filter("false"), F.lit(True)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_gradients():
    """Backpropagation through time lowers the loss on separable bytes."""
    from pulsegrid.llm.language_id import predict_texts, train

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(97, 103, (200, 24)), rng.integers(100, 106, (200, 24))]).astype(np.uint8)
    y = np.repeat([0, 1], 200)
    net = train(x, y, ["a", "b"], steps=80)
    p = predict_texts(net, x.ravel(), np.arange(401) * 24)
    assert (p.argmax(1) == y).mean() > 0.95 and np.allclose(p.sum(1), 1, atol=1e-4)


def _toxic_table(spark):
    rng = random.Random(8)
    common = ["the", "and", "tion", "ing", "with", "that", "from", "this", "for", "hand", "lady", "told", "man", "idol"]
    bad = ["idiot", "moron", "scum"]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(common) + rng.choice(["", "er", "ed", "ly"]) for _ in range(30)]
        toxic = int(i % 4 == 0)
        if toxic:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(30), b)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    docs += [(500, "he is an 1d10t and a m0r0n"), (501, "you i d i o t there"), (502, "sccccum and idiooot"), (503, None), (504, ""), (505, "the hand that told this"), (506, "THE!! HAND!! " * 40)]
    labels += [(1, 0, None), (None, 1, 1)]
    return docs, table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    from pulsegrid.llm.language_id import split_of
    from pulsegrid.llm.toxicity import fit, keep_clean, score

    docs, d, labels = _toxic_table(spark)
    model = fit(d, labels, split_of(F.col("_id"), 5) != 0)
    got = {r.doc_id: r for r in score(d, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} >= set(held)
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert [got[i].predicted for i in range(500, 507)] == [1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = keep_clean(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    none = fit(d, labels.filter("false"), F.lit(True))
    assert {r.predicted for r in score(d, none).collect()} == {0}


ODD = ["i--d--i--o--t", "a$$", "hat3", "l€mon", "euro€", "жжЖ", "ééé", "wo|w", "a b c d", "3 a  b.c_d!"]


@pytest.mark.parametrize("form", [*ODD, "y o u  a r e  a n  i d i o t " * 20, "idio" + "t" * 100])
def test_suspects_are_the_texts_of_odd_tokens(form):
    from pulsegrid.llm import textblock, toxicity as T

    plain = ["", "wow! (2024) it's", "a b c de", "xa b c d", "aa bb (", "€ 30"]
    data, offs = textblock.buffers(T.pa.array([*plain, form, "x", f"so {form}", "y"]))
    assert T.Restorer(T.CharModel(np.zeros(0, np.int32), np.zeros(0))).suspects(data, offs).tolist() == [len(plain), len(plain) + 2]


def test_toxicity_reads_long_tokens(spark):
    from pulsegrid.llm.toxicity import Restorer, fit, score

    docs, d, labels = _toxic_table(spark)
    model = fit(d, labels, F.lit(True))
    spaced = "h e  t o l d  t h e  m a n  w i t h  t h a t  h a n d  i d i o t  a n d  t h a t  m o r o n"
    rows = [(0, spaced), (1, "i" + "d" * 100 + "iot with mor" + "o" * 90 + "n"), (2, "i--d--i--o--t and m--o--r--o--n"), (3, "h a n d " * 5000)]
    assert {"idiot", "moron"} <= set(Restorer(model.chars).restore(spaced).split())
    assert [r.predicted for r in sorted(score(table(spark, rows), model).collect(), key=lambda r: r.doc_id)] == [1, 1, 1, 0]


def test_empty_tables(spark, corpus):
    import public_tokenizers as P

    from pulsegrid.llm import bpe, decontaminate, jaccard_join, language_id, lattice_dedup, lz_dedup, secret_scan, sharding, suffix_dedup, toxicity

    d = table(spark, corpus).filter("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    model = toxicity.fit(d, labels, F.lit(True))
    for out in (
        suffix_dedup.dedup(d), lz_dedup.dedup(d), jaccard_join.join(d), jaccard_join.keep_one(d), decontaminate.digest(decontaminate.contaminated(d, bench)), decontaminate.remove(d, bench),
        secret_scan.digest(secret_scan.scan(d)), secret_scan.redact(d), sharding.shard_documents(d), bpe.round_trip(d, path, P.PATTERN), language_id.identify(d, language_id.fit(d, F.lit(True))),
        toxicity.score(d, model), toxicity.keep_clean(d, model), lattice_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert out.collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs, d, labels = _toxic_table(spark)
    rng = random.Random(5)
    item = words(rng, 30, 9000)
    more = [(600, "lead words " + item + " tail"), (601, words(rng, 80, 9000)), (602, "my password=hunter2secret9 ok " + words(rng, 20, 9000))]
    more += [(603 + k, more[1][1] + f" end{k}") for k in range(3)]
    base = table(spark, [*docs, *more]).select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in C.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != C.STAGES[-1][0]:
            assert out.columns == base.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in now.collect()})
    assert 500 not in seen[0] and 505 in seen[0] and 600 in seen[0]
    assert 601 in seen[1] and not {603, 604, 605} & set(seen[1])
    assert seen[2][600].text.split() == ["lead", "words", "tail"]
    assert "hunter2" not in seen[3][602].text and "[SECRET]" in seen[3][602].text
    assert {i: (r.n_tokens, r.ids_sha256) for i, r in seen[4].items()} == {r.doc_id: (r.n_tokens, r.ids_sha256) for r in C.run(spark, str(tmp_path)).collect()}


def test_pipeline_near_copies_of_five_words(spark):
    import corpus_pipeline as C
    from pulsegrid.llm.jaccard_join import join

    rng = random.Random(6)
    docs = []
    for n in (17, 21, 23, 26):  # 0.873, 0.845, 0.831, 0.811 on four words; 0.843, 0.809, 0.793, 0.769 on five
        w = [f"d{n}w{i}" for i in range(1000)]
        docs.append((len(docs), " ".join(w)))
        for i in rng.sample(range(20, 980, 10), n):
            w[i] = f"x{i}"
        docs.append((len(docs), " ".join(w)))
    assert {i: c for i, (_, c, _) in brute.jaccard_components(docs).items()} == {0: 0, 1: 0, **{i: i for i in range(2, 8)}}
    assert {r.doc_id: r.component_id for r in join(table(spark, docs)).collect()} == {0: 0, 1: 0, **{i: i for i in range(2, 8)}}
    assert {i for i, (_, c, _) in brute.jaccard_components(docs, 5, 80, 100).items() if c == i} == {0, 2, 4, 5, 6, 7}
    assert {r.doc_id for r in C.drop_near_copies(spark, table(spark, docs), "").collect()} == {0, 2, 4, 5, 6, 7}


def test_byte_bpe_reads_its_vocabulary_once_and_decodes_every_token(monkeypatch):
    import public_tokenizers

    from pulsegrid.llm import bpe

    calls, read = [], bpe.read_ranks
    monkeypatch.setattr(bpe, "read_ranks", lambda path: calls.append(path) or read(path))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe._vocabulary.cache_clear()
    one, two = bpe.Codec(path, public_tokenizers.PATTERN), bpe.Codec(path, public_tokenizers.PATTERN)
    assert calls == [path]
    texts = ["the and qzxkvw the", "", "é漢字 " + "ab" * 100, "the"]  # whole tokens, short and long pieces in one call
    ids = one.encode_all(texts)
    assert [two.encode(t).tolist() for t in texts] == [i.tolist() for i in ids]
    assert two.decode_all(ids) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        two.decode_all([np.array([ids[0][0], 1 << 20], np.uint32)])


def test_direct_suffixes_are_sorted_on_only_where_they_agree():
    from pulsegrid.llm import suffix_array as sa

    rng = np.random.default_rng(4)
    base = rng.integers(97, 100, 400).astype(np.uint8)
    copies = [base.copy() for _ in range(6)]
    for k, x in enumerate(copies):
        x[rng.integers(0, 400, k)] = 122
    t = np.concatenate([*copies, rng.integers(97, 123, 2000).astype(np.uint8), np.full(100, 97, np.uint8)])
    w = sa.words8(t, 50)
    s = np.flatnonzero(sa.smaller_than_next(t))
    got, raw = sa.sort_direct(s, w, 50), t.tobytes()
    assert sorted(got.tolist()) == s.tolist()
    first = [raw[i : i + 50] for i in got.tolist()]
    assert first == sorted(first)
    assert len(sa.sort_direct(s[:0], w, 50)) == 0

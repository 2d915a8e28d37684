"""op11, op12 and op13 against plain versions, and their edge cases."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import audit_grammar as G
from pulsegrid.llm import conversation_repair as R
from pulsegrid.llm import html_extract as H
from pulsegrid.llm import vector_codes as V

SF = "/root/testdata/sf0.001"

# --- vector codes -----------------------------------------------------------------------------


def plain_codes(rows):
    kept = sorted([(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: (r[0], r[1]))
    q = np.array([r[1] for r in kept]).reshape(len(kept), 8, -1)
    book = q[:16].transpose(1, 0, 2).copy()

    def near():
        d = ((q[:, :, None, :] - book[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(6):
        code, _e = near()
        for p, k in itertools.product(range(8), range(book.shape[1])):
            m = code[:, p] == k
            if m.any():
                book[p, k] = [int(s) // int(m.sum()) for s in q[m, p].sum(0)]
    code, err = near()
    labels = {}
    for (_, _, lab), e in zip(kept, err):
        labels[lab] = labels.get(lab, 0) + int(e)
    return sorted((i, "".join(f"{c:02x}" for c in cs), int(e), labels[lab], V.book_hash(book)) for (i, _, lab), cs, e in zip(kept, code, err))


def test_vector_codes(spark):
    """Nulls, non-finite components, ties, repeated rows, null labels, extra columns."""
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 9 == 0 else [None if (i % 11 == 0 and j == 3) else math.nan if (i % 13 == 0 and j == 1) else math.inf if (i % 17 == 0 and j == 0) else float(x) for j, x in enumerate(np.round(rng.normal(size=16), 1))], None if i % 4 == 0 else i % 3) for i in range(250)]
    rows += [rows[5], rows[5], rows[7]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, q string, code int").repartition(7)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(map(tuple, V.digest(df).collect())) == plain_codes(rows)


def test_vector_codes_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(i, [float(i + j) for j in range(8)], 1) for i in range(5)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, V.digest(df).collect())) == plain_codes([tuple(r) for r in df.collect()])
    assert V.digest(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        V.digest(spark.createDataFrame([(1, [1.0] * 9, 1)], df.schema))


def test_net_displacement_saves_scans_and_never_errs():
    """Bounds hold for every round; fewer parts are scanned than rows times parts; moves that cancel out age nothing."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 16))
    q = (centres[rng.integers(0, 16, 500)] + rng.integers(-200, 200, (500, 16))).astype(np.int64)
    history = q[:16].reshape(1, 16, 8, 2).transpose(0, 2, 1, 3)
    code = bound = stamp = None
    scans = []
    for _ in range(6):
        code, bound, stamp, error, n = V.assign(q, history, code, bound, stamp)
        x = q.reshape(500, 8, 2)
        d = ((x[:, :, None] - history[-1][None]) ** 2).sum(3)
        assert (d.argmin(2) == code).all() and (d.min(2) == error).all()
        scans.append(n)
        book = history[-1].copy()
        for p, k in itertools.product(range(8), range(16)):
            m = code[:, p] == k
            if m.any():
                book[p, k] = x[m, p].sum(0) // m.sum()
        history = np.concatenate([history, book[None]])
    assert scans[0] == 4000 and scans[-1] < 2000
    there_and_back = np.concatenate([history[:1], history[:1] + 500, history[:1]])
    assert V.displacement(there_and_back)[0].max() == 0


def test_label_sums_by_salted_join(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, f"{i:02x}", i) for i in range(60)], "vec_id long, label int, code string, error long")
    assert sorted(V.with_label_error(df, limit=1).collect(), key=str) == sorted(V.with_label_error(df).collect(), key=str)


# --- conversation repair ------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        if k:
            out += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        v = re.findall(r"[^\x20\x09-\x0D]", x)
        out.append("b" if not v else "d" if (r, x) in seen else "t" if v[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def exhaustive(rows, faults, inserts=4):
    """The cheapest (cost, audit, lines) of all edit strings with so many insertions at most."""
    best = None

    def go(i, state, cost, audit, lines, left):
        nonlocal best
        if best is not None and (cost > best[0]):
            return
        if i == len(rows) and state in (0, 3):
            best = min(filter(None, (best, (cost, audit, lines))), key=lambda b: b[:2])
        if left:
            role = "assistant" if state == 2 else "user"
            go(i, NEXT[state, role[0]], cost + 5, audit + "I", [*lines, f"{role}:"], left - 1)
        if i < len(rows):
            _, r, x = rows[i]
            go(i + 1, state, cost + 2, audit + "D", lines, left)
            if faults[i] not in ("b", "d"):
                more = 5 * (faults[i] == "t")
                if (state, r[:1]) in NEXT:
                    go(i + 1, NEXT[state, r[:1]], cost + more, audit + "K", [*lines, f"{r}:{x}"], left)
                for role in ("user", "assistant"):
                    if (state, role[0]) in NEXT:
                        go(i + 1, NEXT[state, role[0]], cost + more + 1, audit + "R", [*lines, f"{role}:{x}"], left)

    go(0, 0, 0, "", [], inserts)
    return best


def plain_repair(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in plain_damage(rows) if r[0] == c], key=lambda z: (z[0] is not None, z[0] or 0, hashlib.md5(f"{z[1]}:{z[2]}".encode()).hexdigest()))
        f, turns = plain_faults(mine), [t for t, _, _ in mine if t is not None]
        cost, audit, lines = exhaustive(mine, f)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, convs, sizes):
    rng = random.Random(seed)
    return [
        (c, rng.choice([None, i, i, i, i, i - 1, i * 3]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), rng.choice([None, "", "hi.", "hi", "yes!", "a b ?  ", "x .", "é", "no\n", f"t{i}.", f"u{i}."]))
        for c in convs for i in range(rng.choice(sizes))
    ]


SCHEMA = "conv_id long, turn long, role string, text string"


def digest(spark, rows, n=5):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], f"{SCHEMA}, rid string, piece int").repartition(n).checkpoint()
    return {r.conv_id: tuple(r)[1:] for r in R.digest(df, R.damage(df)).collect()}


def test_repair_against_all_edits(spark):
    """Every edit string is tried; nulls in all columns, repeated rows and turns, other roles, clashing extra columns."""
    rows = random_rows(1, [None, *range(50)], [1, 2, 3, 5, 6])
    assert digest(spark, rows) == plain_repair(rows)


def test_repair_of_one_hot_conversation_in_pieces(spark, monkeypatch):
    """Small pieces, blocks and segments give what large ones do: a conversation spread over all partitions."""
    rng = random.Random(2)
    rows = [(7, i if i % 3 else None, rng.choice(["user", "assistant"]), rng.choice(["hi.", "ok.", f"t {i}.", f"q {i}"])) for i in range(2000)] + [(8, 1, "user", "x."), (9, 1, "user", "")]
    want = digest(spark, rows)
    for name, value in (("PIECE", 7), ("BLOCK", 5), ("SEGMENT", 50)):
        monkeypatch.setattr(R, name, value)
    assert digest(spark, rows) == want
    assert len(want[7][6]) >= 1800 and want[8][5:7] == (2, "D") and want[9][5:7] == (2, "D")


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.digest(df, R.damage(df)).collect() == []
    dropped = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert digest(spark, [(1, dropped, "user", "x.")]) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "assistant", "hello."), (1, 2, "user", "a?"), (1, 3, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).checkpoint()
    got = [(r.role, r.text, r.edit) for r in R.repair(df).rows().orderBy("ord", "n").collect()]
    assert got == [("user", "be kind.", "R"), ("assistant", "hello.", "K"), ("user", "a?", "K"), ("assistant", "b.", "K")]  # cheaper than deleting hello


def test_grammar_keeps_sequences_and_matrices():
    rng = random.Random(4)
    seqs = [[rng.choice([3, 5, 3, 5, 0, 4]) for _ in range(rng.choice([1, 2, 9, 60]))] for _ in range(80)]
    rules, short = G.grammar(seqs)

    def spelled(s):
        return [x for t in s for x in (spelled(rules[t - 9]) if t >= 9 else [t])]

    assert [spelled(s) for s in short] == seqs and sum(map(len, short)) < 0.6 * sum(map(len, seqs)) and rules
    tables = G.matrices(rules)
    for whole, s in zip(seqs, short):
        a = b = list(G.START)
        for t in whole:
            a = G.through(a, G.SYMBOLS[t])
        for t in s:
            b = G.through(b, tables[t])
        assert [(x and (x[0], str(x[1]))) for x in a] == [(x and (x[0], str(x[1]))) for x in b]


def test_ropes_compare_as_strings():
    rng = random.Random(5)
    for _ in range(2000):
        parts = [["".join(rng.choice("DK") for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(rng.choice([1, 3, 6]))] for _ in range(2)]
        a, b = (sum(map(G.Rope, p[1:]), G.Rope(p[0])) for p in parts)
        assert (a < b) == ("".join(parts[0]) < "".join(parts[1])) and str(a) == "".join(parts[0])


# --- HTML ------------------------------------------------------------------------------------------


def test_pages_give_their_articles(spark):
    """A plain reading of the known page template: the article's blocks."""
    from pulsegrid.llm.queries import op13_html_extraction

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in op13_html_extraction(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for i, p in pages.items():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == p.url


class Tree(HTMLParser):
    """A plain DOM of well-formed html."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"tag": "html", "up": None, "kids": [], "text": []}

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "up": self.at, "kids": [], "text": []}
        self.at["kids"].append(node)
        if tag not in H.VOID:
            self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["text"].append(" ".join(data.split()))


def test_densities_are_those_of_a_recursion():
    page = "<div><p>one two <a>three</a></p><p>four <b>five</b><br>six</p></div><section><a>x</a><a>y</a><p>seven eight nine ten</p></section>"
    t = Tree()
    t.feed(page)

    def count(n):
        c, tags, lc, lt = sum(map(len, n["text"])), 0, 0, 0
        for k in n["kids"]:
            kc, kt, klc, klt = count(k)
            c, tags, lc, lt = c + kc, tags + kt + 1, lc + klc, lt + klt + (k["tag"] == "a")
        return c, tags, c if n["tag"] == "a" else lc, lt

    C, _, LC, _ = count(t.root)
    want = []

    def density(n):
        c, tags, lc, lt = count(n)
        inner = c / max(c - lc, 1) * lc + LC / C * c + math.e
        return c / max(tags, 1) * math.log(c / max(lc, 1) * max(tags, 1) / max(lt, 1)) / max(math.log(math.log(inner)), 0.25) if c else 0.0

    def walk(n):
        want.append((n["tag"], density(n), sum(density(k) for k in n["kids"])))
        for k in n["kids"]:
            walk(k)

    walk(t.root)
    p = H.parse(page)
    d = H.densities(p)
    assert [w[0] for w in want] == p.tag
    assert np.allclose([w[1] for w in want], d.value) and np.allclose([w[2] for w in want], d.total)


P = "This is a paragraph of the article, with quite a few words in it so that it counts."
CASES = {
    "": "", "   ": "", "plain &amp; text": "plain & text", "<p>a<b>b</b>c</p><p>d": "abc\n\nd", "<p>a<br>b\n\t c&nbsp;d</p>": "a b c d", "x<script>var a='<p>no</p>'</script>y": "xy", "<p>one<!-- two --> three<!-- four": "one three",
    "<style>p{}</style><p>a</p><script>x": "a", "a < b & c > d": "a < b & c > d", "<p>1 &lt;b&gt; &#233; &eacute; &bogus; &#x1F600;</p>": "1 <b> é é &bogus; 😀", "<td>a</td><td>b</td>": "a\n\nb", "<P CLASS=x>Up</P>": "Up", "<p title='a>b'>q</p>": "q", "tail <b": "tail",
}


@pytest.mark.parametrize("page", CASES)
def test_small_pages(page):
    assert H.main_text(page) == CASES[page]
    assert H.main_text(None) == ""


NOISE = {
    "nav": "<nav><a href=1>Home</a><a href=2>News</a></nav>", "menu by class": "<div class='main-menu'><a href=1>Home</a> <a href=2>Products</a></div>", "list of links": "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>",
    "header": "<header><p>The Daily Site</p></header>", "footer": "<footer><p>&copy; 2020 Somebody</p></footer>", "sidebar": f"<div id='sidebar'><p>{P.replace('article', 'margin')}</p></div>", "aside": f"<aside><p>{P}</p></aside>",
    "cookie notice": f"<div class='cookie-consent'><p>We use cookies. {P}</p><button>Accept</button></div>", "advert": f"<div class='ad'>Buy now! {P}</div>", "form": "<form><label>Mail</label><input name=a><p>Join our list of readers today, it is free</p></form>",
    "comments": f"<section id='comments'><h2>Comments</h2><article class='comment'><p>{P} {P} {P}</p></article><article class='comment'><p>{P} {P}</p></article></section>", "hidden": f"<div style='display: none'><p>{P}</p></div>", "role": f"<div role='complementary'><p>{P}</p></div>", "noscript": "<noscript>Enable scripts</noscript>",
}
SHELLS = {"class": ("<div class='article'>", "</div>"), "article": ("<article>", "</article>"), "div": ("<div class='post'>", "</div>"), "main": ("<main><div>", "</div></main>"), "bare": ("", "")}
BODY = f"<h1>Title</h1><p>{P}</p><p>Short.</p><blockquote>{P} &quot;x&quot;</blockquote><p>{P} <a href=q>link</a></p><ul><li>first item of a list</li><li>second item</li></ul>"
WANT = "\n\n".join(["Title", P, "Short.", P + ' "x"', P + " link", "first item of a list", "second item"])


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("noise", NOISE)
def test_noise_goes(shell, noise):
    a, b = SHELLS[shell]
    for before, after in ((NOISE[noise], ""), ("", NOISE[noise]), (NOISE[noise], NOISE[noise])):
        assert H.main_text(f"<html><head><title>T</title></head><body class='has-sidebar'>{before}{a}{BODY}{b}{after}</body></html>") == WANT


def test_headers_of_the_article_stay():
    """A header inside the article, or one that is named after it, holds the title; the site's goes."""
    site = "<header><p>The Daily Site</p></header><div class='site-header'><p>Since 1900</p></div>"
    for head in ("<header><h1>Title</h1></header>", "<div class='entry-header'><h1>Title</h1></div>", "<div class='header'><h1>Title</h1></div>"):
        for a, b in (("<article>", "</article>"), ("<div class='post'>", "</div>")):
            assert H.main_text(f"<body>{site}{a}{head}<p>{P}</p><p>{P}</p>{b}</body>") == f"Title\n\n{P}\n\n{P}"


def test_method_decides():
    """Without marks, the container with the highest sum is found; what is beside it stays if it is as dense as the path."""
    story, links = f"<div><p>{P}</p><p>{P} {P}</p><p>{P}</p></div>", "<div>" + "".join(f"<span><a href={i}>word {i}</a></span>" for i in range(20)) + "</div>"
    assert H.main_text(f"<body>{links}{story}<div><span>a</span> <span>b</span> <span>c</span></div></body>") == "\n\n".join([P, f"{P} {P}", P])


def test_nesting_and_length_are_linear():
    for page, size in (("<div>" * 30_000 + "x", 1), ("<b>" * 20_000 + "<p>" * 20_000 + "y", 1), ("<a " * 100_000, 0), ("<p>word</p>" * 30_000, 30_000 * 6 - 2)):
        assert len(H.main_text(page)) == size


def test_extract_keeps_rows(spark):
    rows = [(1, "u", None, "old"), (1, "u", None, "old"), (None, None, "<p>x</p>", None), (2, "v", "", "")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (2, "v", "", 0), (None, None, "x", 1)]
    assert H.extract(got.withColumn("html", F.lit("")).limit(0)).collect() == []

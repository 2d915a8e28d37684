"""Main text of HTML pages by composite text density.

A page becomes a DOM tree in one pass. Every node gets its characters a tag, adjusted for
links; a node's score is the sum of its children's densities. The container of the highest
score is the article's body. The lowest density on the path from ``body`` to it is the
threshold for what stands beside that path. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are told by their element, role, class
or id and never score.

Defined results: null, empty or tagless-but-blank html gives an empty text; text without
tags is one block; unclosed and misnested tags are closed as browsers do, an unclosed
comment or script runs to the end; of containers with equal scores the outer, earlier one is
taken. Texts are never cut: work is linear in the html (elements nested more than 512 deep
count to the 512th). Rows are kept one to one (repeated rows, null
ids and extra columns too; ``text`` and ``n_chars`` of the input are replaced).
"""

from __future__ import annotations

import functools
import html as _html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import bounded_batches, released

# Elements by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DEAD = frozenset("script style head title template noscript textarea select option optgroup datalist button input iframe object embed svg math canvas audio video map xmp noembed noframes".split())
NOISE = frozenset("nav footer aside form dialog menu search fieldset".split())
CONTROL = frozenset("button input select textarea".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hgroup details".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What an opening tag closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "thead": ({"tbody", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}), "frameset": ({"head"}, {"html"})}
#: Opening tags that don't close a paragraph although they are blocks, being parts of other structures.
IN_P = frozenset("html body caption dd dt frameset legend li optgroup option tbody td tfoot th thead tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip status".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox "
    "newsletter subscribe subscription signup login signin paywall sidebar sidebars aside rail menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot masthead topbar toolbar "
    "share sharing sharebar social related recommended recommendations trending widget widgets pagination pager skip search searchbox copyright disclaimer comment comments commentlist disqus respond replies "
    "form".split()
)
HEADER_WORDS = frozenset(("header", "banner", "top"))
STORY_WORDS = frozenset(("article", "post", "entry", "story"))
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
NEGATIONS = frozenset(("no", "not", "has", "with", "without", "non"))

#: Open elements; what is nested deeper counts to the last of them, as in browsers.
DEPTH = 512

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+'|['"])*+)>|[!?/][^>]*+>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)


@functools.cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


@functools.lru_cache(4096)
def _traits(attributes: str) -> frozenset[str]:
    """What attributes tell of an element: of hidden, role, noise, header, comment, story."""
    found = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "style" and _HIDDEN.search(value.lower())) or (name == "aria-hidden" and value.lower() == "true"):
            found.add("hidden")
        elif name == "role" and ROLES & set(value.lower().split()):
            found.add("role")
        elif name in ("class", "id"):
            for word in _html.unescape(value).split():
                parts = [p.lower() for p in _CAMEL.split(word) if p]
                if not parts or parts[0] in NEGATIONS:
                    continue
                found |= {kind for kind, words in (("noise", WORDS), ("header", HEADER_WORDS), ("comment", COMMENT_WORDS), ("story", STORY_WORDS)) if words & set(parts)}
    return frozenset(found)


@dataclass
class Page:
    """A DOM in arrays, parents before children. status: 0 counts, 1 noise, 2 dead; pieces: (node, text) in page order, text None where a block begins or ends."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [0])
    status: list[int] = field(default_factory=lambda: [0])
    story: list[bool] = field(default_factory=lambda: [False])
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def _status(page: Page, tag: str, attributes: str, at: int) -> int:
    if page.status[at]:
        return page.status[at]
    if tag in DEAD:
        return 2
    if tag in NOISE or (tag == "header" and not page.story[at]):
        return 1
    traits = _traits(attributes) if attributes and not attributes.isspace() else ()
    if not traits or tag in ("html", "body"):
        return 0
    if "hidden" in traits or "comment" in traits or ("role" in traits and tag != "article"):
        return 1
    if tag in ("main", "article") or tag in HEADING:
        return 0
    return 1 if "noise" in traits or ("header" in traits and "story" not in traits and not page.story[at]) else 0


def parse(html: str) -> Page:
    """The DOM of a page."""
    page, stack, pos = Page(), [0], 0
    live: dict[str, int] = {}  # open elements by name
    pieces, tags = page.pieces, page.tag
    end = html.rfind(">") + 1

    def close(names: set[str], stops: set[str] | frozenset[str]) -> None:
        if not any(live.get(name) for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            name = tags[stack[k]]
            if name in names:
                shut(k)
                return
            if name in stops:
                return

    def shut(k: int) -> None:
        for n in stack[k:]:
            live[tags[n]] -= 1
        if any(tags[n] in BLOCK for n in stack[k:]):
            pieces.append((stack[k], None))
        del stack[k:]

    while pos < end:
        m = _TAG.search(html, pos, end)
        if m is None:
            break
        if m.start() > pos:
            pieces.append((stack[-1], html[pos : m.start()]))
        pos = m.end()
        name = m[2]
        if name is None:
            if html.startswith("<!--", m.start()) and pos == end and not html.endswith(("-->", "--!>"), m.start(), end):
                pos = len(html)
            continue
        name = name.lower()
        if m[1]:
            close({name}, frozenset(("td", "th", "table")) - {name} if name in BLOCK else BLOCK)
            continue
        if name in ("html", "body") and name in [tags[n] for n in stack[:3]]:
            continue
        if name in BLOCK and name not in IN_P:
            close({"p"}, frozenset(("td", "th", "table", "button", "li", "body")))
        if name in HEADING and tags[stack[-1]] in HEADING and name != "hgroup" and tags[stack[-1]] != "hgroup":
            shut(len(stack) - 1)
        if name in CLOSES:
            close(*CLOSES[name])
        top = stack[-1]
        if name == "br":
            pieces.append((top, " "))
        node = len(tags)
        tags.append(name)
        page.parent.append(top)
        page.status.append(_status(page, name, m[3], top))
        page.story.append(page.story[top] or name in ("article", "main") or (name in ("div", "section") and bool(m[3]) and "story" in _traits(m[3])))
        if name in BLOCK:
            pieces.append((node, None))
        if name in RAW:
            stop = _raw_end(name).search(html, pos)
            if stop is None:
                pos = len(html)
            else:
                pieces.append((node, html[pos : stop.start()]))
                pos = html.find(">", stop.start()) + 1 or len(html)
        elif name not in VOID and len(stack) < DEPTH:
            stack.append(node)
            live[name] = live.get(name, 0) + 1
    rest = html[pos:]
    cut = re.search(r"<[A-Za-z/!?]", rest)
    if rest:
        pieces.append((stack[-1], rest[: cut.start()] if cut else rest))
    return page


def _squeezed(text: str) -> str:
    return " ".join((_html.unescape(text) if "&" in text else text).split())


@dataclass
class Density:
    """Of each node: density, sum of its children's densities, link characters, characters; children by node."""

    value: list[float]
    total: list[float]
    links: list[int]
    chars: list[int]
    children: list[list[int]]
    controls: list[int]


def densities(page: Page) -> Density:
    n = len(page.tag)
    chars, tags, link_chars, link_tags, controls = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for node, text in page.pieces:
        if text is not None and page.status[node] < 2:
            chars[node] += len(_squeezed(text))
    for i in range(n - 1, 0, -1):
        up, tag = page.parent[i], page.tag[i]
        if tag == "a":
            link_chars[i] = chars[i]
        controls[up] += controls[i] + (tag in CONTROL)
        if page.status[i] < 2:
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i] + (tag == "a")
        children[up].append(i)
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    value, total = [0.0] * n, [0.0] * n
    for i in range(n):
        children[i].reverse()
        c, t, lc = chars[i], tags[i] or 1, link_chars[i]
        if c:
            inner = c / ((c - lc) or 1) * lc + share * c + math.e
            value[i] = c / t * math.log(c / (lc or 1) * t / (link_tags[i] or 1)) / max(math.log(math.log(inner)), 0.25)
    for i in range(1, n):
        if not page.status[i]:
            total[page.parent[i]] += value[i]
    return Density(value, total, link_chars, chars, children, controls)


def _menu(page: Page, d: Density, i: int) -> bool:
    """A list of nothing but links."""
    return page.tag[i] in ("ul", "ol", "dl", "table") and d.chars[i] > 0 and d.links[i] >= 0.9 * d.chars[i] and len(d.children[i]) >= 3


def select(page: Page, d: Density) -> tuple[int, set[int]]:
    """The container of the highest score, and the roots of all subtrees that are the article."""
    root = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    holds = [i for i in range(len(page.tag)) if not page.status[i] and any(page.tag[c] in BLOCK and not page.status[c] for c in d.children[i])]
    best = max((i for i in holds if i >= root), key=lambda i: (d.total[i], -i), default=root)
    path = [best]
    while path[-1] != root and path[-1]:
        path.append(page.parent[path[-1]])
    # the innermost article (else main) around the best container is kept whole
    for kind in ("article", "main"):
        whole = next((i for i in path if page.tag[i] == kind), None)
        if whole is not None:
            return best, {whole}
    threshold = min(d.value[i] for i in path)
    keep = {best}
    for i, below in zip(path[1:], path):
        for c in d.children[i]:
            if c == below or page.status[c] or d.controls[c]:
                continue
            plain = page.tag[c] in TEXTUAL and d.links[c] * 2 <= d.chars[c]
            if plain or (d.value[c] >= threshold and d.links[c] * 2 <= d.chars[c]):
                keep.add(c)
    return best, keep | {-i - 1 for i in path[1:]}  # text of the path's own nodes: -node - 1


def blocks(html: str) -> list[str]:
    """The article's blocks in page order."""
    page = parse(html)
    d = densities(page)
    best, keep = select(page, d)
    inside = [False] * len(page.tag)
    for i in range(len(page.tag)):
        ok = i in keep or (i > 0 and inside[page.parent[i]])
        inside[i] = ok and not page.status[i] and not (i not in keep and _menu(page, d, i))
    inline = {-i - 1 for i in keep if i < 0}
    # text in a path's own node, or in inline elements right below it
    loose = [i in inline and not page.status[i] for i in range(len(page.tag))]
    for i in range(1, len(page.tag)):
        if not loose[i] and loose[page.parent[i]] and page.tag[i] not in BLOCK and page.tag[i] != "a" and not page.status[i]:
            loose[i] = True
    out: list[str] = []
    parts: list[str] = []
    strict = not any(i >= 0 and page.tag[i] in ("article", "main") for i in keep)

    def flush() -> None:
        text = _squeezed("".join(parts))
        parts.clear()
        if text and not (strict and _RIGHTS.match(text)):
            out.append(text)

    for node, text in page.pieces:
        if text is None:
            flush()
        elif inside[node] or loose[node]:
            parts.append(text)
    flush()
    return out


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks(html)) if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of pages without ``html``, and text (never null) and n_chars: a map over Arrow batches, no shuffle."""
    bounded_batches(pages.sparkSession)
    out = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", html)]
    names = [f.name for f in out]
    schema = T.StructType([*out, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.select(*[quoted(n) for n in dict.fromkeys([*names, html])]).mapInArrow(run, schema)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"

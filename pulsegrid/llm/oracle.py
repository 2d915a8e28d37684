"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .secret_scan import ACCESS, ASSIGN, HEX, KINDS, MAX_OWNERS, MAX_REPOSITORIES, OPAQUE

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GRAPH = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _kind(number: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, o, r, {number} AS kind, gaps, ms, vs, unnest(range(1, len(ms) + 1)) AS i, {least} AS least FROM
(SELECT rid, o, r, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs FROM d WHERE regexp_matches(t, '{p}'))"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, concat_ws('/', source, lang) AS r FROM documents),
m AS ({" UNION ALL ".join([_kind(0, ASSIGN, 2, 6), _kind(1, ACCESS, 0, 20), _kind(2, HEX, 0, 24), _kind(3, OPAQUE, 0, 20)])}),
s AS (SELECT rid, o, r, kind, vs[i] AS v, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT AS a, length(ms[i]) AS n FROM m WHERE length(vs[i]) >= least),
base AS (SELECT * FROM s WHERE kind < 3),
more AS (SELECT * FROM s WHERE kind = 3 AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = s.rid AND b.a < s.a + s.n AND s.a < b.a + b.n)),
both_ AS (SELECT * FROM base UNION ALL SELECT * FROM more),
freq AS (SELECT v, count(DISTINCT o) <= {MAX_OWNERS} AND count(DISTINCT r) <= {MAX_REPOSITORIES} AS live FROM both_ GROUP BY v),
j AS (SELECT rid, kind, a, live, ['{"', '".join(KINDS)}'][kind + 1] || ':' || a || ':' || (a + n) AS said FROM both_ JOIN freq USING (v) WHERE kind < 3 OR live),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, coalesce(string_agg(said, ',' ORDER BY a, kind) FILTER (kind < 3), '') AS base,
  string_agg(said, ',' ORDER BY a, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)"""

BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS i, unnest(list_transform(range(0, len(h) // 2 - 49), lambda j: unhex(substr(h, (2 * j + 1)::INT, 100)))) AS s FROM d WHERE len(h) >= 100),
f AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM p JOIN f USING (s) WHERE least < doc_id),
every AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS i, unnest(list_transform(range(0, len(h) // 2), lambda j: substr(h, (2 * j + 1)::INT, 2))) AS b FROM d WHERE len(h) > 0),
k AS (SELECT e.doc_id, e.i, b, g.i IS NOT NULL AS g FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i),
l AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM k),
a AS (SELECT doc_id, count(*) FILTER (g) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT g) AS kept FROM l GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_GRAPH}') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 85 * (na.n + nb.n - both_)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, u) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) k USING (doc_id) JOIN (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v) c USING (doc_id)"""

WORDS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_GRAPH}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda j: sha256(array_to_string(w[j:j + 19], ' ')))) AS s FROM d WHERE len(w) >= 20),
f AS (SELECT s, min({{'d': doc_id, 'i': i}}) AS first FROM p GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM p JOIN f USING (s) WHERE (doc_id, i) <> (first.d, first.i)),
every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT e.doc_id, e.i, word, g.i IS NOT NULL AS g FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i),
a AS (SELECT doc_id, count(*) FILTER (g) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT g) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

BENCHMARK = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, item, i, dw.n FROM dw JOIN bw ON bw.s = dw.s AND bw.n = dw.n),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""

# crc32 by its bits: a byte is folded in, then eight shifts (-1).
_CRC = """xor(4294967295, list_reduce(flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295))"""


def _least(*cells: str) -> str:
    """The least (cost, audit) of cells, nulls aside."""
    return f"list_min(list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL))"


def _after(cell: str, cost: str, letters: str, line: str = "''") -> str:
    """An edit after a cell: its cost, letters and lines."""
    return f"CASE WHEN {cell} IS NOT NULL THEN {{'c': {cell}.c + {cost}, 's': {cell}.s || '{letters}', 't': {cell}.t || {line}}} END"


_USER, _ASSISTANT = "(chr(10) || 'user:')", "(chr(10) || 'assistant:')"


def _inserted(p: str) -> list[str]:
    """The four cells with any insertions after them."""
    q = [f"{p}{i}" for i in range(4)]
    to_user = [_after(q[i], "5", "I", _USER) for i in (0, 1, 3)]
    to_assistant = [_after(q[i], "10", "II", f"({_USER} || {_ASSISTANT})") for i in (0, 1)]
    return [q[0], q[1], _least(q[2], *to_user), _least(q[3], _after(q[2], "5", "I", _ASSISTANT), *to_assistant)]


def _edited() -> list[str]:
    """The cells q0 to q3 after one more row."""
    own = lambda role: f"(chr(10) || {role} || ':' || text)"
    gone = [_after(f"q{i}", "2", "D") for i in range(4)]
    keep = lambda q, first: f"CASE WHEN may AND first = '{first}' THEN {_after(q, 'more', 'K', own('role'))} END"
    turn = lambda q, role: f"CASE WHEN may THEN {_after(q, '1 + more', 'R', own(chr(39) + role + chr(39)))} END"
    user = [f(q, n) for q in ("q0", "q1", "q3") for f, n in ((keep, "u"), (turn, "user"))]
    return [gone[0], _least(gone[1], keep("q0", "s")), _least(gone[2], *user), _least(gone[3], keep("q2", "a"), turn("q2", "assistant"))]


_CELL = "NULL::STRUCT(c BIGINT, s VARCHAR, t VARCHAR)"
REPAIR = f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS hit FROM d),
e AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, left(role, 1) AS first, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
 lag(left(role, 1)) OVER w AS before FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy)),
f AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS MATERIALIZED (SELECT *, fault NOT IN ('blank', 'duplicate') AS may, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 's': '', 't': ''}} AS p0, {_CELL} AS p1, {_CELL} AS p2, {_CELL} AS p3 FROM f
UNION ALL SELECT conv_id, n, {', '.join(_edited())} FROM (SELECT g.*, {', '.join(f'{c} AS q{i}' for i, c in enumerate(_inserted('r.p')))} FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.n = r.n + 1)),
z AS (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id),
b AS (SELECT conv_id, {_least('q0', 'q3')} AS best FROM (SELECT r.conv_id, {', '.join(f'{c} AS q{i}' for i, c in enumerate(_inserted('r.p')))} FROM r JOIN z ON z.conv_id IS NOT DISTINCT FROM r.conv_id AND z.n = r.n)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.s, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id"""


def _codes() -> str:
    """Six rounds of assignment and means, then the last assignment; parts as lists of eight components or so."""
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT rid, p, v, e.d AS d, e.k AS k FROM (SELECT rid, x.p, v, list_min(list_transform(book, lambda b: {{'d': list_sum(list_transform(list_zip(v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': b.k}})) AS e FROM x JOIN (SELECT p, list({{'k': k, 'c': c}} ORDER BY k) AS book FROM b{k} GROUP BY p) y ON y.p = x.p))"""
    parts = ["b0 AS MATERIALIZED (SELECT p, rid - 1 AS k, v AS c FROM x WHERE rid <= 16)"]
    for k in range(6):
        means = f"SELECT p, k, list(floor(m)::BIGINT ORDER BY i) AS c FROM (SELECT p, k, i, (sum(v[i])::BIGINT - (((sum(v[i])::BIGINT % count(*)) + count(*)) % count(*))) / count(*) AS m FROM (SELECT p, k, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY p, k"
        parts += [near(k), f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN ({means}) n ON n.p = b.p AND n.k = b.k)"]
    return ", ".join([*parts, near(6)])


VECTORS = f"""
WITH q AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT rid, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS v FROM q, (SELECT unnest(range(8)) AS p)),
{_codes()},
t AS (SELECT rid, string_agg('0' || substr('0123456789abcdef', k::INT + 1, 1), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM t JOIN q USING (rid), h"""

ORACLE_SQL = {"op2_secret_scans": SECRETS, "op3_suffix_array_dedup": BYTES, "op4_jaccard_join": JACCARD, "op7_substring_dedup": WORDS, "op8_decontamination": BENCHMARK, "op11_vector_codes": VECTORS, "op12_conversation_repair": REPAIR}

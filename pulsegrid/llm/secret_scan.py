"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

1. Each text is scanned for assigned secrets, access keys, long hex strings
   (the base kinds) and for opaque tokens (candidates).
2. The value of every span is hashed; (value, repository, owner) triples are
   made distinct and counted by value.
3. A value that at most ``max_owners`` owners and ``max_repositories``
   repositories hold is live-looking; all others are widely copied examples. Live-looking opaque tokens that no
   base span touches become spans of kind ``owned``. Base spans always stay.

Positions are code points, ends exclusive. Null texts count as empty; texts
without spans give the hash of the empty string; repeated rows give repeated
rows; null repositories and owners count as one repository and owner; extra
columns are ignored; an empty table gives no rows; very long texts are scanned whole. Counts are partial sums before any shuffle, so a value
that a third of the rows hold is one row for each task; the counts of such values
(fewer than ``HOT``) go back by broadcast. Offsets of very many matches in one
text are sums over runs of about the root of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

KEYWORDS = ("password", "passwd", "secret", "token")
#: Either case, spelled out so that only ASCII letters match.
_EITHER = "|".join(["".join(f"[{c}{c.upper()}]" for c in w) for w in KEYWORDS] + ["[aA][pP][iI]_?[kK][eE][yY]"])
ASSIGN = rf"({_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a maximal run: the same as AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A live-looking value has at most so many owners and repositories.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
#: A value that more than one in so many spans hold is joined by broadcast.
HOT = 1000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value, op over all values before it (zero for the first).

    Runs of about sqrt(n) values are folded by themselves, from what all runs
    before have: a fold copies its array at each step, so one over all values
    would cost the square of their number.
    """

    def scan(run: Column, start: Column) -> Column:
        return F.aggregate(run, F.array(start), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))

    def runs(v: Column, size: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda i: F.slice(v, i * size + 1, size))
        return _let(cut, lambda c: _let(scan(F.transform(c, lambda r: F.aggregate(r, zero, op)), zero), lambda at: F.flatten(F.transform(c, lambda r, i: F.slice(scan(r, F.element_at(at, i + 1)), F.lit(1), F.size(r))))))

    return F.when(F.size(values) > 0, _let(values, lambda v: _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: runs(v, size)))).otherwise(F.array().cast("array<int>"))


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _found(text: Column, kind: int, pattern: str, value_group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of one kind."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    parts = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("m"), value.alias("v")), lambda x: x["m"].isNotNull())

    def spans(x: Column) -> Column:
        at = _before(F.transform(x, lambda p: F.length(p["gap"]) + F.length(p["m"])), F.lit(0), lambda a, b: a + b)
        placed = F.zip_with(x, at, lambda p, at: F.struct((at + F.length(p["gap"])).alias("start"), F.lit(kind).alias("kind"), (at + F.length(p["gap"]) + F.length(p["m"])).alias("end"), p["v"].alias("value")))
        return F.filter(placed, lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), _let(parts, spans)).otherwise(F.array()).cast(SPANS)


def _untouched(spans: Column, base: Column) -> Column:
    """The spans (no two overlap) that no base span overlaps.

    In order of starts, a span is touched if a base span before it ends after its
    start, or the first base span after it starts before its end.
    """
    far = F.lit((1 << 31) - 1)

    def judged(x: Column) -> Column:
        reach = _before(F.transform(x, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"])), F.lit(0), lambda a, b: F.greatest(a, b))
        coming = F.reverse(_before(F.reverse(F.transform(x, lambda s: F.when(s["own"], far).otherwise(s["start"]))), far, lambda a, b: F.least(a, b)))
        zipped = F.arrays_zip(x.alias("s"), reach.alias("reach"), coming.alias("coming"))
        free = F.filter(zipped, lambda z: z["s"]["own"] & (z["reach"] <= z["s"]["start"]) & (z["coming"] >= z["s"]["end"]))
        return F.transform(free, lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["kind"].alias("kind"), z["s"]["end"].alias("end"), z["s"]["value"].alias("value")))

    row = lambda own: lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    mixed = F.array_sort(F.concat(F.transform(base, row(False)), F.transform(spans, row(True))))
    return F.when((F.size(base) > 0) & (F.size(spans) > 0), _let(mixed, judged)).otherwise(spans).cast(SPANS)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _opaque(value: Column) -> Column:
    """Mixed letters and digits: at least four digits and four letters."""
    return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4)


def _with_frequency(spans: DataFrame, freq: DataFrame) -> DataFrame:
    """spans with the counts of their hash; values of more than a share of 1 in HOT of all spans are fewer than HOT, so they are broadcast."""
    total = spans.count()
    hot = spans.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT > total).select("hash")
    few = F.broadcast(freq.join(F.broadcast(hot), "hash", "left_semi"))
    return spans.join(few, "hash").unionByName(spans.join(F.broadcast(hot), "hash", "left_anti").join(freq, "hash"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """A row for each row of docs: doc_id, row_key, base and all spans (start, kind, end, live), counts of live-looking and example values.

    ``row_key`` names a text of a document id; rows with both equal share their result.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    t = F.coalesce(F.col(text), F.lit(""))
    x = F.col("t")
    base = F.concat(_found(x, 0, ASSIGN, 2, 6), _found(x, 1, ACCESS, 0, 20), _found(x, 2, HEX, 0, 24))
    clear = _untouched(F.filter(F.col("opaque"), lambda c: _opaque(c["value"])), F.col("base"))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), t.alias("t"))
    rows = rows.withColumn("base", F.array_sort(base)).withColumn("opaque", _found(x, 3, OPAQUE, 0, 20)).withColumn("more", clear)
    rows = rows.select("doc_id", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "t")).alias("row_key"), "owner", "repository", hashed(F.col("base")).alias("base"), hashed(F.col("more")).alias("more"))
    rows = tables.checkpoint(rows)  # spans and hashes only: the texts are scanned once

    spans = rows.select("row_key", "owner", "repository", F.explode(F.concat("base", "more")).alias("s")).select("row_key", "owner", "repository", "s.*")
    held = spans.select("hash", "repository", "owner").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    freq = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories"))
    judged = _with_frequency(spans.select("row_key", "hash", "start", "kind", "end").distinct(), freq)
    judged = judged.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).filter((F.col("kind") < 3) | F.col("live"))
    found = judged.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repositories"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,repositories:bigint>>")
    return rows.select("doc_id", "row_key", "base").join(found, "row_key", "left").withColumn("spans", F.coalesce("spans", none))


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of what scan() found."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mask: str = "[SECRET]", **options) -> DataFrame:
    """docs with live-looking spans masked (examples that many owners copy stay); all rows and columns stay, n_chars follows the text."""
    key_, live_, new_ = tables.unused(docs, "__pg_key", "__pg_live", "__pg_new")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))))
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    marks = scan(docs, text, doc_id, **options).filter(F.exists("spans", lambda s: s["live"])).select(F.col("row_key").alias(key_), live.alias(live_)).dropDuplicates([key_])
    x = F.col(text)

    def cut(spans: Column) -> Column:
        done = _before(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(spans, done, lambda s, at: F.when((s["start"] < at) | (s["end"] <= at), F.lit("")).otherwise(F.concat(F.substring(x, at + 1, s["start"] - at), F.lit(mask))))
        return F.concat(F.array_join(pieces, ""), F.substring(x, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(x)))

    masked = _let(F.col(live_), cut)
    new = F.when(F.col(live_).isNull(), x).otherwise(masked)
    out = docs.withColumn(key_, key).join(marks, key_, "left").withColumn(new_, new)
    cols = [F.col(new_).alias(c) if c == text else F.when(F.col(live_).isNull(), F.col(c)).otherwise(F.length(new_).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)

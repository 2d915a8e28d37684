"""Stages of the pipeline on tables whose extra columns have the names that the stages use themselves, null and repeated ids, and no rows."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, jaccard_join, secret_scan, tables

NAMES = ["__pg_key", "__pg_live", "__pg_new", "__pg_id", "__pg_th", "__pg_bare", "__pg_h", "__pg_r", "__PG_SPANS", "spans", "h", "g", "row_key", "component_id", "th"]
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
TEXTS = [WORDS, WORDS, None, "", "password = hunter2secret and more", WORDS + " fifteen", "password = hunter2secret and more", "clean words here"]
IDS = [1, 2, 3, None, 4, 5, 4, None]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(zip(IDS, TEXTS))], "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *[F.concat(F.lit("x"), F.lit(str(k))).alias(n) for k, n in enumerate(NAMES)]).checkpoint()


def extras_stay(got, docs):
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    rows = got.collect()
    assert all(r[n] == f"x{k}" for r in rows for k, n in enumerate(NAMES))
    return rows


def test_redact(docs):
    rows = extras_stay(secret_scan.redact(docs), docs)
    assert sorted((r.text or "") for r in rows) == sorted((t or "").replace("password = hunter2secret", "[SECRET]") for t in TEXTS)
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert secret_scan.redact(docs.limit(0)).collect() == []


def test_keep_one(docs):
    rows = extras_stay(jaccard_join.keep_one(docs, gram=5, num=80, den=100), docs)
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(map(str, [(1, WORDS), (3, None), (None, ""), (4, TEXTS[4]), (None, TEXTS[7])]))


def test_remove(spark, docs):
    bench = spark.createDataFrame([("b", " ".join(WORDS.split()[2:12]))], "item_id string, text string")
    rows = extras_stay(decontaminate.remove(docs, bench), docs)
    assert sum("six" in (r.text or "") for r in rows) == 0 and len(rows) == len(TEXTS)


def test_unused_names(docs):
    assert tables.unused(docs, "__pg_spans", "new", "New") == ["__pg_spans_", "new", "New_"]

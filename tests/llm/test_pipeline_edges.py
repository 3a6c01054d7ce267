"""Pipeline stages on tables with clashing columns, nulls, ties, repeats, very long texts, and without rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

CLASH = ("__key", "__quality", "__quality_w", "key", "judged", "quality", "places", "place", "spans", "nth", "text_key", "component", "kept", "doc_key", "mark", "row", "c0")


def table(spark, sf_dir):
    rng = random.Random(6)
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(40).collect()
    long = "\n".join(f"This is sentence number {i} of a very long text, with words {rng.random()} and more." for i in range(20_000))
    rows = [tuple(r) for r in base] + [tuple(base[3]), tuple(base[3]), (900, long, "en", None, len(long)), (901, None, None, None, None), (902, "", "en", "x", 0), (None, base[5][1], "en", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASH})


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_clashing_columns_come_back_as_they_were(spark, sf_dir, name, stage):
    docs = table(spark, sf_dir)
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == c + ("" if r.doc_id is None else str(r.doc_id)) for r in rows for c in CLASH)
    assert all(r.n_chars == len(r.text or "") for r in rows if r.doc_id == 900)
    # rows stand among those that came in
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_no_rows_give_none(spark, sf_dir, name, stage):
    assert stage(spark, table(spark, sf_dir).limit(0), sf_dir).count() == 0


def test_of_rows_that_differ_besides_id_and_text_one_stays_always(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "a", 5), (1, text, "de", "b", 6), (2, text, "en", "a", 5), (3, "other words here", "en", "a", 1)]
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        got.append(sorted(map(tuple, P.near_duplicates(spark, df, sf_dir).collect())))
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 3]

import collections

import duckdb
import pytest

import corpus_pipeline
from sequor.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = lambda x: collections.Counter(map(tuple, x))
    assert rows(df.select(*cols).collect()) == rows(want.select(*cols).fetchall())


def test_pipeline_stages_hold_their_contracts(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the same table with what real tables have: nulls, repeats and an extra column
    docs = docs.union(docs.limit(3)).union(docs.limit(2).selectExpr("cast(null as long)", "cast(null as string)", "lang", "source", "n_chars"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = seen[name][1]
    before, after = seen["n-gram jaccard join"]
    assert after.select("doc_id").distinct().count() == after.count() < before.count()
    before, after = seen["source mixing"]
    words = lambda d: d.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0]
    assert abs(words(after) / words(before) - 1.5) < 0.01
    before, after = seen["k-d sharding"]
    assert after.count() == before.count() and 30 <= after.select("shard").distinct().count() <= 40


def test_pipeline_runs_as_a_query(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100

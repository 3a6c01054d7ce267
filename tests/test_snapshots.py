"""Merges by id, dependent fetches, cases, previews, shared scans and look-ups in place."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_sources import write

from sequor.functions import sequences as S
from sequor.operators import exports, gold, previews, search
from sequor.plans import build as B
from sequor.sources import paged
from sequor.sources.linked import fetch_linked


def test_the_later_version_of_an_interaction_is_kept(spark):
    schema = "antibody_id string, target_id string, family string, position int, rank_score long, relationships array<string>, evidence array<string>, sources array<string>, name string, interactions array<struct<interaction_id:string,note:string>>"
    rows = [("a", "t1", "direct", 1, 5, ["binds"], ["E1"], ["s1"], "n", [("i1", "old"), ("i2", "x")]), ("a", "t2", "direct", 1, 9, ["binds"], ["E2"], ["s2"], "n", [("i3", "y"), ("i1", "new"), (None, "q"), (None, "q")]), ("b", "t1", "direct", 2, 1, ["binds"], ["E1"], ["s1"], "m", [])]
    got = {r.antibody_id: r for r in B.merged_rows(spark.createDataFrame(rows, schema)).collect()}
    assert [tuple(i) for i in got["a"].interactions] == [("i1", "new"), ("i2", "x"), ("i3", "y"), (None, "q")]
    assert got["a"].rank_score == 9 and got["a"].sources == ["s1", "s2"] and got["a"].n_interactions == 4
    assert got["b"].interactions == [] and got["b"].n_interactions == 0
    back = B.merged_rows(spark.createDataFrame(rows, schema), F.struct(-F.col("rank_score")))
    assert [i.note for i in back.where("antibody_id = 'a'").first().interactions if i.interaction_id == "i1"] == ["old"]


def test_the_driver_reads_few_pages(monkeypatch, tmp_path):
    for pages in (1, 2, 3, 37, 64, 90):
        for p in range(pages):
            write(tmp_path / f"p-{p}.csv", ["a"], *[[str(i)] for i in range(2 if p < pages - 1 else 1)])
        reads = []
        true = paged.fetch
        monkeypatch.setattr(paged, "fetch", lambda url, attempts=1: reads.append(url) or true(url, 1))
        reader = paged._Reader([], {"url": f"file://{tmp_path}/p-{{page}}.csv", "page_size": "2", "attempts": "1"})
        assert len(reader.partitions()) == pages
        assert len(reads) <= 2 * max(1, pages.bit_length()) + 1, (pages, len(reads))
        monkeypatch.setattr(paged, "fetch", true)
        for p in range(pages):
            (tmp_path / f"p-{p}.csv").unlink()


def test_linked_answers_are_whole_or_an_error(spark, tmp_path):
    for b in range(3):
        write(tmp_path / f"b-{b}.csv", ["id", "v"], *[[str(i), f"v{i}"] for i in range(b * 4, min(10, b * 4 + 4))])
    ids = spark.createDataFrame([(str(i),) for i in [*range(10), 3, 3]] + [(None,), ("x1",)], "k string")
    # batches go by hash ranges of ids, so each file answers with what its batch asks
    asked = {r.batch: r.ids for r in __import__("sequor.sources.tabular", fromlist=["batches"]).batches(ids.where("k rlike '^[0-9]+$'").withColumnRenamed("k", "id"), "id", 4).groupBy("batch").agg(F.collect_list("id").alias("ids")).collect()}
    for b, own in asked.items():
        write(tmp_path / f"b-{b}.csv", ["id", "v"], *[[i, f"v{i}"] for i in own])
    url = f"file://{tmp_path}/b-{{batch}}.csv"
    out = fetch_linked(ids, "k", url, ("id", "v"), "id", size=4, at_once=2, attempts=1)
    assert sorted(map(tuple, out.collect())) == sorted((str(i), f"v{i}") for i in range(10)) and out.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="missing columns w"):
        fetch_linked(ids, "k", url, ("id", "w"), size=4, attempts=1).collect()
    write(tmp_path / "b-1.csv", ["id", "v"], ["77", "x"])
    with pytest.raises(Exception, match="not asked: 77"):
        fetch_linked(ids, "k", url, ("id", "v"), "id", size=4, attempts=1).collect()
    (tmp_path / "b-1.csv").unlink()
    with pytest.raises(Exception, match="b-1"):
        fetch_linked(ids, "k", url, ("id", "v"), size=4, attempts=1).collect()


def test_digests_tell_rows_and_no_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), rng.choice(["a", "", None])) for _ in range(200)]
    digest = lambda x, n: spark.createDataFrame(x, "i long, s string").repartition(n).agg(exports.multiset_digest("i", "s").alias("d")).first().d
    first = digest(rows, 1)
    assert digest(rows[::-1], 7) == first
    assert len({first, digest(rows[1:], 2), digest(rows + rows[:1], 2), digest([(rows[0][0] + 1, rows[0][1]), *rows[1:]], 2)}) == 4


def test_cases_name_what_they_miss(spark):
    entities = spark.createDataFrame([("e1", ["A", "B"], ["1XYZ"], "ACD", "EFG"), ("e2", [], None, "ACD", "")], "antibody_id string, direct_targets array<string>, exact_structures array<string>, heavy string, light string")
    cases = spark.createDataFrame([("c1", "e1", ["A"], ["1XYZ"], "paired"), ("c2", "e1", ["A", "C", "C"], None, "heavy_only"), ("c3", "e2", ["A"], ["2ABC"], None), ("c4", "gone", ["A"], [], "paired")], "case_id string, antibody_id string, direct_targets array<string>, exact_structures array<string>, chains string")
    got = sorted(map(tuple, gold.check_cases(cases, entities).collect()))
    assert got == [("c2", "chains", "heavy_only"), ("c2", "direct_targets", "C"), ("c3", "direct_targets", "A"), ("c3", "exact_structures", "2ABC"), ("c4", "entity", "gone")]


def test_previews_merge_within_two_percent(spark):
    rows = spark.range(60_000).selectExpr("id % 7 as part", "id % 20000 as chains", "id as records", "if(id % 3 = 0, null, id % 500) as clusters")
    levels = {"records": "records", "chains": "chains", "clusters": "clusters"}
    exact = {r.level: r.rows for r in previews.selected(rows, levels).collect()}
    assert exact == {"records": 60_000, "chains": 20_000, "clusters": 500}
    parts = previews.sketches(rows, levels, ("part",))
    for some in (parts, parts.repartition(5)):
        told = {r.level: r.rows for r in previews.preview(some).collect()}
        assert all(abs(told[k] - exact[k]) <= 0.02 * exact[k] for k in exact)


def test_strict_sequences_fail_on_other_characters(spark):
    df = spark.createDataFrame([("acd ef",)], "s string")
    assert df.select(S.strict_residues("s").alias("x")).first().x == "ACDEF"
    with pytest.raises(Exception, match="it has 1 -|it has - 1"):
        spark.createDataFrame([("AC-1",)], "s string").select(S.strict_residues("s")).collect()


def test_filled_views_stop_where_there_are_enough(spark):
    pages = spark.createDataFrame([("t", "direct", p, p * 10 + i, i % 2 == 0) for p in range(1, 6) for i in range(4)] + [("u", "direct", 1, 99, False)], "target_id string, family string, page long, row int, ok boolean")
    got = [r.row for r in search.filled(pages, pages.where("ok"), 3).orderBy("row").collect()]
    assert got == [10, 12, 20, 22]
    assert search.filled(pages, pages.where("ok"), 100).count() == 10


def test_shared_scans_and_look_ups_in_place(spark, tmp_path):
    members = spark.createDataFrame([(f"ab_{i}", "heavy", 95, f"ab_{i - i % 3}", 3, "c") for i in range(300)], "id string, scope string, level int, representative_id string, size long, cluster_id string")
    out = str(tmp_path / "s")
    tables = {"clusters": members, "totals": spark.range(1).selectExpr("id as antibodies")}
    B.write(tables, out, stamp="one")
    snapshot = B.Snapshot(spark, out)
    asked = spark.createDataFrame([("ab_4",), ("gone",)], "id string")
    found = snapshot.cluster_lookup("heavy", 95, asked)
    assert sorted((r.id, r.representative_id, r["size"]) for r in found.collect()) == [("ab_4", "ab_3", 3), ("gone", "gone", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan, plan
    scan = next(i for i, x in enumerate(plan.split("\n")) if "FileScan parquet" in x and "Bucketed: true" in x)
    above = plan.split("\n")[:scan][::-1]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    path, at = [], depth(plan.split("\n")[scan])
    for line in above:
        if depth(line) < at:
            path.append(line)
            at = depth(line)
    assert not any("Exchange" in x for x in path) and any("Join" in x for x in path)
    first = snapshot.shared("clusters")
    cached = lambda df: bool(re.search("InMemoryRelation|In-memory table", df._jdf.queryExecution().executedPlan().toString()))
    assert cached(snapshot.shared("clusters").groupBy("scope").count()) and first.count() == 300
    B.write(tables | {"clusters": members.limit(10)}, out, stamp="two")
    assert B.Snapshot(spark, out).shared("clusters").count() == 10
    B.Snapshot(spark, out).release("clusters")
    assert not cached(B.Snapshot(spark, out).table("clusters"))


def test_large_targets_spread_over_files(spark, tmp_path):
    # these few rows would be read as one range
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(5000).selectExpr("'hot' as target_id", "'direct' as family", "cast(id as string) as antibody_id", "id as position", "cast(id / 100 as long) as page")
    exports.write_pages(rows, str(tmp_path / "p"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = spark.read.parquet(str(tmp_path / "p")).groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("page").alias("pages"), F.count("*").alias("n")).collect()
    assert len(per) > 1 and max(r.n for r in per) <= 3 * sorted(r.n for r in per)[len(per) // 2] and sum(r.pages for r in per) == 50

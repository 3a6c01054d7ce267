import json

import pytest
from pyspark.sql import functions as F

from sequor.operators import clusters, exports, screening, search, similarity, targets, validate
from sequor.operators.components import connected_components
from sequor.plans import tables

BASE = "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRF"


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, None), (3, 8)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 4: 4, 5: 4}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_descendants_end_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, id string")
    got = targets.descendants(edges, spark.createDataFrame([("a",)], "r string"))
    assert {r.id for r in got.collect()} == {"a", "b", "c"}


def test_names_are_never_chosen_by_likeness(spark):
    names = spark.createDataFrame([("1", "Alpha-1", ["beta"]), ("2", "alpha 1", []), ("3", "gamma", [])], "id string, name string, aliases array<string>")
    terms = search.name_terms(names)
    asked = spark.createDataFrame([("ALPHA 1",), ("Beta",), ("gama",)], "query string")
    got = {r["query"]: (r.status, r.ids) for r in search.exact_names(terms, asked).collect()}
    assert got == {"ALPHA 1": ("multiple", ["1", "2"]), "Beta": ("one", ["1"]), "gama": ("none", [])}
    assert search.autocomplete(terms, "gama", 5).first().id == "3"
    assert search.autocomplete(terms, "g", 5).count() == 0


def test_near_regions_are_one_apart_in_length(spark):
    regions = spark.createDataFrame([("ACDEFGHIK",), ("ACDEFGHI",), ("ACDEFG",), ("ACDEFGHWW",)], "sequence string")
    got = similarity.near_regions(spark.createDataFrame([("ACDEFGHIK",)], "query string"), regions)
    assert {(r.sequence, r.distance) for r in got.collect()} == {("ACDEFGHIK", 0), ("ACDEFGHI", 1), ("ACDEFGHWW", 2)}


def chain_rows(spark):
    near = "Q" + BASE[1:]
    return spark.createDataFrame([(1, BASE, "", 1), (2, BASE, "", 2), (3, near, "", 3), (4, BASE[::-1], "", 4), (5, "ACD", "", 5)], "id long, heavy string, light string, ord long")


def test_clusters_join_copies_and_near_chains(spark):
    got = {r.id: (r.representative_id, r.size) for r in clusters.clusters(chain_rows(spark), 95).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3)}
    got = {r.id: (r.representative_id, r.size) for r in clusters.clusters(chain_rows(spark), 99).collect()}
    assert got == {1: (1, 2), 2: (1, 2)}
    assert validate.cluster_members(clusters.clusters(chain_rows(spark), 95)).count() == 0


def test_cluster_lookup_reports_single_entities(spark):
    rows = chain_rows(spark)
    got = {r.id: (r.size, r.members) for r in clusters.lookup(clusters.clusters(rows, 95), rows.select("id")).collect()}
    assert got[3] == (3, [1, 2, 3]) and got[4] == (1, [4])


@pytest.mark.parametrize("mode, kept", [("entities", 5), ("unique_chains", 4), ("cluster_95", 3)])
def test_redundancy_modes(spark, mode, kept):
    got = clusters.redundancy(chain_rows(spark), mode)
    assert got.count() == 5 and got.select("kept_id").distinct().count() == kept


def test_similarity_modes(spark):
    asked = spark.createDataFrame([(9, BASE)], "query_id long, sequence string")
    for mode in ("strict", "loose"):
        got = {r.id: round(r.identity, 1) for r in similarity.similar(asked, chain_rows(spark), "heavy", mode=mode).collect()}
        assert got[1] == got[2] == 100.0 and 98 < got[3] < 100 and got.get(4, 0) < 60


def test_recall_is_whole_at_full_identity(spark):
    rows = chain_rows(spark)
    got = {r.level: r.recall for r in similarity.recall(rows, "heavy", (100, 90), least=40).collect()}
    assert got[100] == 1.0


def test_screening_gives_every_query_an_outcome(spark):
    asked = spark.createDataFrame([("e", BASE), ("n", BASE[1:] + "WWW"), ("i", "AC-D"), ("z", None)], "query_id string, raw string")
    got = {r.query_id: r.status for r in screening.screen(asked, chain_rows(spark)).collect()}
    assert got == {"e": "EXACT", "n": "NO MATCH", "i": "INVALID", "z": "INVALID"}


def test_fasta_wraps_and_cleans_headers(spark):
    rows = spark.createDataFrame([(1, "a|b\nc", "A" * 85, "")], "id long, name string, heavy string, light string")
    got = exports.fasta(rows).first().record
    assert got == ">1|a b c|heavy\n" + "A" * 80 + "\n" + "A" * 5
    assert exports.coding_errors(rows.withColumn("heavy", F.lit("AX"))).count() == 1


def test_csv_cells_are_quoted(spark):
    rows = spark.createDataFrame([('a,"b"', ["x", "y"], None)], "p string, q array<string>, r string")
    assert exports.csv_lines(rows, ("p", "q", "r")).first().line == '"a,""b""",x; y,'


def test_workspaces_are_checked():
    good = exports.workspace_json(["ab_" + "0" * 20], {"mode": "direct"})
    assert exports.read_workspace(good) == {"selected_ids": ["ab_" + "0" * 20], "filters": {"evidence_mode": "direct"}}
    for bad in (json.dumps({"selected_ids": ["x"]}), json.dumps({"selected_ids": ["ab_" + "0" * 20] * 5001})):
        with pytest.raises(ValueError):
            exports.read_workspace(bad)


def test_bundles_hold_tables_and_texts(spark):
    import io
    import zipfile

    raw = exports.bundle({"a.txt": "hi", "b.csv": spark.range(2).selectExpr("cast(id as string) AS line")})
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.read("b.csv") == b"0\n1\n" and z.testzip() is None


def test_entities_are_written_by_shard(spark, tmp_path):
    rows = spark.createDataFrame([("ab_0011", "x"), ("ab_ff22", "y")], "antibody_id string, name string")
    exports.write_entities(rows, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.where("shard = 'ff'").count() == 1
    assert validate.entities(rows.withColumn("shard", exports.shard("antibody_id"))).count() == 0
    assert validate.entities(rows.union(rows).withColumn("shard", F.lit("zz"))).count() == 6


def test_postings_rule_fires(spark):
    rows = chain_rows(spark)
    index = similarity.capped(similarity.signatures(rows, "heavy"))
    assert validate.postings(index, rows, "heavy").count() == 0
    assert validate.postings(index.union(spark.createDataFrame([(7, 4)], "hash long, id long")), rows, "heavy").count() == 1


def test_selections_are_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r.id for r in search.selection(ids("a", "b"), ids("b", "c"), ids("a")).collect()) == ["b", "c"]


def test_examples_must_resolve(spark):
    names = spark.createDataFrame([("1", "alpha"), ("2", "beta"), ("3", "beta")], "id string, name string")
    asked = spark.createDataFrame([("Alpha",), ("beta",), ("gamma",)], "query string")
    assert {(r["query"], r.status) for r in search.missing_examples(search.name_terms(names), asked).collect()} == {("beta", "multiple"), ("gamma", "none")}


@pytest.mark.parametrize("raw, is_it, clean", [(BASE, True, BASE), ("PD-L1", False, None), (">h x\nacd\n ef", False, "ACDEF"), (">only", False, None)])
def test_typed_sequences(spark, raw, is_it, clean):
    got = spark.createDataFrame([(raw,)], "q string").select(search.is_sequence(F.col("q")).alias("a"), search.pasted_sequence(F.col("q")).alias("b")).first()
    assert got.a is is_it and got.b == clean
    assert search.dispatch("A", "B", "similarity") == "paired_similarity" and search.dispatch("A", "", "exact") == "exact"


def test_names_are_resolved_once_and_no_claim_is_lost(spark):
    rows = [("covabdab", "red ring", i) for i in range(50)] + [("therasabdab", "zz/red ring", 50), (None, "a/b", 51), ("covabdab", None, 52)]
    claims = spark.createDataFrame(rows, "source string, target_raw string, n long")
    out = targets.dispatch(claims, targets.alias_table(spark, {"ring family": ["red ring"]}))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.n: r for r in out.collect()}
    assert len(got) == 53 and all(got[i].canonical == "ring family" and got[i].curated for i in range(51))
    assert got[51].canonical == "a/b" and not got[51].curated


def test_rollup_multiplies_no_rows(spark):
    rows = [("t", "Long name", a, f, s) for a in ("a", "b", None) for f, s in (("binds", "s1"), ("binds", "s2"), ("does_not_bind", "s1"))] + [("t", "Name", "c", "neutralizes", "s3")]
    out = targets.rollup(spark.createDataFrame(rows, "target_id string, target_name string, antibody_id string, relationship string, source string"))
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()
    assert (r["name"], r["count"], r.direct_count, r.negative_count, r.functional_count) == ("Name", 10, 6, 3, 1)
    assert (r.direct_antibodies, r.negative_antibodies, r.functional_antibodies, r.sources) == (2, 2, 1, ["s1", "s2", "s3"])


def test_postings_are_checked_in_one_grouping(spark):
    rows = chain_rows(spark)
    index = similarity.capped(similarity.signatures(rows, "heavy"))
    lost = index.orderBy("hash", "id").first()
    odd = spark.createDataFrame([(7, 4), (7, 4), (8, None), (None, 5)], "hash long, id long")
    out = validate.postings(index.where(~((F.col("hash") == lost["hash"]) & (F.col("id") == lost["id"]))).union(odd), rows, "heavy")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.subject or "", r.message) for r in out.collect())
    assert got == sorted([("4", "posting without hash")] * 2 + [("4", "duplicate posting"), ("", "posting without hash"), ("5", "posting without hash"), (str(lost["id"]), "hash without posting")])


def test_rollup_makes_sets_of_few_rows_only(spark):
    rows = [("t", "n", "a", "binds", "s"), (None, None, "a", "binds", None), (None, "m", None, "neutralizes", "s")]
    out = targets.rollup(spark.createDataFrame(rows, "target_id string, target_name string, antibody_id string, relationship string, source string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("antibody_id" not in x for x in plan.splitlines() if "ObjectHashAggregate" in x)
    got = {r.target_id: r for r in out.collect()}
    assert (got[None]["name"], got[None]["count"], got[None].direct_antibodies, got[None].functional_antibodies, got[None].sources) == ("m", 2, 1, 0, ["s"])
    assert got["t"]["count"] == 1 and len(got) == 2


def test_pages_of_asked_targets_are_those_of_all(spark, sf_dir):
    ids = spark.createDataFrame([("target:ring-family",)], "id string")
    columns = ("target_id", "family", "antibody_id", "position", "page")
    own, every = tables._pages(spark, sf_dir, ids).select(*columns), tables._pages(spark, sf_dir).where("target_id = 'target:ring-family'").select(*columns)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, every.collect())) != []


def test_exact_hits_of_loose_searches_are_not_shuffled_as_pairs(spark):
    rows = spark.createDataFrame([(i, BASE, "") for i in range(30)] + [(30, "Q" + BASE[1:], "")], "id long, heavy string, light string")
    asked = spark.createDataFrame([(100, BASE), (101, BASE), (102, "ACD")], "query_id long, sequence string")
    out = similarity.similar(asked, rows, "heavy", mode="loose")
    got = sorted((r.query_id, r.id, r.shared, r.score) for r in out.collect() if r.identity == 100)
    assert got == [(q, i, 32, 2 * len(BASE)) for q in (100, 101) for i in range(30)] and out.count() == 62
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    at = next(i for i, x in enumerate(lines) if "Generate explode(query_id" in x)
    path, least = [], depth(lines[at])
    for line in lines[:at][::-1]:
        if 0 < depth(line) < least:
            path.append(line)
            least = depth(line)
    assert not any("Exchange" in x or "Join" in x for x in path), path

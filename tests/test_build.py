import json

import pytest
from pyspark.sql import functions as F
from test_sources import VH, VL, receptor_files, write

from sequor import cli
from sequor.plans import build as B

LONG = VH + "GFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYY"


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("snapshot")
    main, links, assays = receptor_files(d)
    thera = write(d / "t.csv", ["Therapeutic", "HeavySequence", "LightSequence", "Target", "Est. Status"], ["alphamab", LONG, VL, "Spike", "Active"], ["betamab", "Q" + LONG[1:], VL, "Other/Spike;", "Active"], ["badmab", "AC-D", VL, "Spike", ""])
    lit = write(d / "l2.csv", ["ID", "heavy_sequence", "light_sequence", "targets_mentioned"], ["L1", LONG, VL, "x;y"])
    sources = {"plabdab": {"path": lit}, "therasabdab": {"path": thera, "summary_url": "https://example.org/"}, "iedb": {"path": main, "links_path": links, "assays_path": assays}}
    (d / "sources.json").write_text(json.dumps(sources))
    (d / "aliases.json").write_text(json.dumps({"Spike protein": ["Spike", "S protein"]}))
    (d / "entities.json").write_text(json.dumps({"Spike protein": {"kind": "protein", "identifiers": {"uniprot": "P0DTC2"}}, "Other": {"parent": "Spike", "relation": "part_of"}, "Nowhere": {"parent": "Spike"}}))
    out = str(d / "out")
    assert cli.main(["--snapshot", out, "build", "--sources", str(d / "sources.json"), "--aliases", str(d / "aliases.json"), "--entities", str(d / "entities.json")], spark) == 0
    return B.Snapshot(spark, out)


def test_a_built_snapshot_breaks_no_rule(snapshot):
    assert snapshot.violations().collect() == []


def test_entities_merge_over_sources(snapshot):
    rows = {r.name: r for r in snapshot.table("antibodies").collect()}
    assert rows["L1"].sources == ["plabdab", "therasabdab"] and rows["L1"].aliases == ["alphamab"]
    assert rows["badmab"].heavy == "" and rows["badmab"].direct_target_count == 0


def test_target_command(snapshot, spark, capsys):
    rows = snapshot.target("s-protein").collect()
    assert {r.name for r in rows} >= {"L1"} and all(r.interactions for r in rows)
    assert snapshot.resolve("nobody") is None and cli.main(["--snapshot", snapshot.path, "target", "nobody"], spark) == 2
    assert cli.main(["--snapshot", snapshot.path, "--format", "fasta", "target", "Spike"], spark) == 0
    assert ">ab_" in capsys.readouterr().out
    assert cli.main(["--snapshot", snapshot.path, "target", "Spike", "--include-descendants"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["query"]["scope"] == "include_descendants"
    assert cli.main(["--snapshot", snapshot.path, "--format", "csv", "target", "Spike protein", "--paired"], spark) == 0
    assert "L1" in capsys.readouterr().out


def test_antibody_and_sequence_commands(snapshot, spark, capsys):
    any_id = snapshot.table("antibodies").first().antibody_id
    assert cli.main(["--snapshot", snapshot.path, "antibody", any_id], spark) == 0
    assert cli.main(["--snapshot", snapshot.path, "antibody", "ab_" + "0" * 20], spark) == 2
    assert cli.main(["--snapshot", snapshot.path, "sequence", "--heavy", LONG, "--light", VL], spark) == 0
    capsys.readouterr()
    assert snapshot.sequence(LONG, "", "similar").count() >= 2


def test_clusters_and_mentions(snapshot):
    assert snapshot.table("clusters").where("scope = 'heavy' and level = 95").count() == 2
    assert snapshot.table("literature").count() == 2
    assert {r.source: r.quarantined for r in snapshot.table("manifest").collect()}["therasabdab"] == 1


def test_targets_have_names_and_parents(snapshot):
    rows = {r.name: r for r in snapshot.table("targets").collect()}
    spike = rows["Spike protein"]
    assert {"Spike", "S protein"} <= set(spike.aliases) and spike.identifiers == {"uniprot": "P0DTC2"}
    assert spike.target_id == "target:spike-protein"


def test_slash_groups_take_the_first_known_part(snapshot):
    assert {r.target_id for r in snapshot.table("interactions").where("source = 'therasabdab'").collect()} == {"target:spike-protein"}


def test_similar_tables_are_rebuilt(snapshot, spark):
    before = sorted(map(str, snapshot.table("clusters").drop("cluster_id").collect()))
    assert cli.main(["--snapshot", snapshot.path, "rebuild-similar"], spark) == 0
    assert sorted(map(str, snapshot.table("clusters").drop("cluster_id").collect())) == before


def test_planted_defects_are_found(snapshot, spark, tmp_path):
    import shutil

    out = str(tmp_path / "broken")
    shutil.copytree(snapshot.path, out)
    broken = B.Snapshot(spark, out)
    change = lambda name, f: f(broken.table(name)).write.mode("overwrite").parquet(f"{out}/{name}_") or (shutil.rmtree(f"{out}/{name}"), shutil.move(f"{out}/{name}_", f"{out}/{name}"))
    change("totals", lambda t: t.withColumn("antibodies", t.antibodies + 1))
    change("postings", lambda t: t.union(t.limit(1)))
    change("observations", lambda t: t.withColumn("record_url", F.lit("")))
    change("nucleotides", lambda t: t.unionByName(t.sparkSession.createDataFrame([("ab_x", "nobody", "r", "VX", "ACGX", "all", "f")], t.schema)))
    change("antibodies", lambda t: t.withColumn("light", F.concat("light", F.lit("A"))))
    change("targets", lambda t: t.withColumn("children", F.array(F.lit("nobody"))))
    change("interactions", lambda t: t.withColumn("assay_ids", F.array(F.lit("none"))))
    change("names", lambda t: t.where("term not like 'l%'"))
    change("clusters", lambda t: t.withColumn("size", t["size"] + 1))
    rules = {r.rule for r in broken.violations().collect()}
    assert {"V1", "V3", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V12", "V13"} - rules <= {"V6"}

import pytest
from pyspark.sql import functions as F

from sequor.functions import sequences as S
from sequor.operators import entities, targets
from sequor.sources import adapters, tabular

VH = "EVQLVESGGGLVQPGGSLRLSCAAS"
VL = "DIQMTQSPSSLSASVGDRVTITC"


def write(path, header, *rows):
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


def test_literature_makes_mentions_and_no_targets(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["ID", "heavy_sequence", "light_sequence", "targets_mentioned"], ["1", VH, VL, "a;b;c;d;e"], ["2", VH, VL, ""])
    obs, claims = adapters.literature(spark, path)
    assert obs.count() == 1
    assert [r.target_raw for r in claims.orderBy("target_raw").collect()] == list("abcde")
    named = claims.withColumns({"target_id": F.col("target_raw"), "target_name": F.col("target_raw")})
    assert targets.rollup(named).count() == 0


def test_missing_columns_are_an_error(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["ID"], ["1"])
    with pytest.raises(ValueError, match="heavy_sequence"):
        adapters.literature(spark, path)


def test_bad_characters_quarantine_the_claims(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["Therapeutic", "HeavySequence", "LightSequence", "Target"], ["x", VH + "-", VL, "T1"], ["y", VH, VL, "T1"])
    obs, claims = adapters.therapeutic(spark, path, summary_url="https://example.org/")
    held = {r.name: r for r in obs.collect()}
    assert held["x"].quarantine == {"heavy": VH + "-"} and held["x"].heavy == ""
    assert [r.source_record_id for r in claims.collect()] == ["y"]


@pytest.mark.parametrize("extra, arms, edges", [({}, 2, 0), ({"Target (primary)": "A", "Target (ifbispec)": "B"}, 2, 2), ({"Target (primary)": "A"}, 2, 0)])
def test_arms_need_explicit_targets(spark, tmp_path, extra, arms, edges):
    header = ["Therapeutic", "HeavySequence", "LightSequence", "HeavySequence(ifbispec)", "LightSequence(ifbispec)", "Target", *extra]
    path = write(tmp_path / "a.csv", header, ["m", VH, VL, VH[::-1], VL[::-1], "A;B", *extra.values()])
    obs, claims = adapters.therapeutic(spark, path)
    assert sorted(r.name for r in obs.collect()) == ["m", "m [arm_2]"][:arms]
    assert claims.count() == edges
    assert all(r.therapeutic_status == "" and r.structures == [] for r in obs.collect())


def test_semicolon_targets_are_multispecific(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["Therapeutic", "HeavySequence", "LightSequence", "Target"], ["m", VH, VL, "A;B"])
    obs, claims = adapters.therapeutic(spark, path)
    assert obs.count() == 1 and claims.count() == 0


def test_structure_tiers(spark, tmp_path):
    header = ["Therapeutic", "HeavySequence", "LightSequence", "Target", "100% SI Structure", "99% SI Structure"]
    path = write(tmp_path / "a.csv", header, ["m", VH, VL, "A", "1abc:H;2xyz", "3def"])
    row = adapters.therapeutic(spark, path)[0].first()
    assert row.structures == ["1ABC", "2XYZ"] and row.structure_tiers["99%"] == ["3DEF"]


def test_coronavirus_relations(spark, tmp_path):
    header = ["Name", "Binds to", "Doesn't Bind to", "Neutralising Vs", "VHorVHH", "VL", "Protein + Epitope"]
    path = write(tmp_path / "a.csv", header, ["c", "SARS-CoV-2 (weak)", "MERS_CoV", "SARS-CoV-2", VH, VL, "S; RBD"])
    _, claims = adapters.coronavirus(spark, path)
    got = {(r.relationship, r.target_raw, r.assertion_origin) for r in claims.collect()}
    assert ("binds", "SARS-CoV-2 RBD", "source_epitope") in got and ("does_not_bind", "MERS CoV", "source") in got and ("neutralizes", "SARS-CoV-2", "source") in got
    assert claims.where("relationship = 'binds' and assertion_origin = 'source'").first().note == "SARS-CoV-2 (weak)"


def test_orthopox_relations(spark, tmp_path):
    cols = list(adapters._POX_RELATIONS)
    path = write(tmp_path / "a.csv", ["Name", "VH or VHH", "VL", *cols], ["p", VH, VL, "VACV_WR_L1", "", "MPXV", "", "", "VARV"])
    _, claims = adapters.orthopox(spark, path)
    assert {(r.relationship, r.target_raw) for r in claims.collect()} == {("binds", "Vaccinia virus WR L1"), ("neutralizes", "Mpox virus"), ("does_not_protect", "Variola virus")}


def receptor_files(tmp_path):
    main = write(
        tmp_path / "r.csv",
        ["receptor_group_id", "receptor__type", "epitope__name", "chain_1__type", "chain_2__type", "chain_1__v_domain_calculated", "chain_2__v_domain_calculated", "chain_1__cdr1_calculated", "chain_1__cdr1_curated"],
        ["7", "BCR", "e", "heavy", "kappa", VH, VL, "GFTF", "OTHER"],
        ["8", "BCR", "e", "heavy", "", VH, "", "", "GFTX"],
    )
    links = write(tmp_path / "l.csv", ["receptor_group_id", "iedb_assay_ids"], ["7", "{501,502}"], ["9", "{503}"])
    head = ["assay_id", "assay__method", "assay__response_measured", "assay__qualitative_measure", "assay__quantitative_measurement", "assay__measurement_inequality", "epitope__molecule_parent", "epitope__molecule_parent_iri"]
    assays = write(
        tmp_path / "s.csv",
        head,
        ["501", "SPR", "dissociation constant KD", "Positive", "2.5", "<", "Spike", "iri:1"],
        ["502", "neutralization", "EC50", "Positive", "8", "", "Spike", "iri:1"],
        ["503", "SPR", "KD", "Positive", "1", "", "Spike", "iri:1"],
        ["504", "ELISPOT", "secretion", "Positive", "", "", "Spike", "iri:1"],
    )
    return main, links, assays


def test_receptors_join_their_assays(spark, tmp_path):
    main, links, assays = receptor_files(tmp_path)
    obs, claims = adapters.receptors(spark, main, links_path=links, assays_path=assays)
    first = {r.record_id: r for r in obs.collect()}
    assert first["7"].cdrh1 == "GFTF" and first["8"].cdrh1 == "GFTX"
    got = {(r.relationship, r.measurements[0].metric, r.measurements[0].qualifier) for r in claims.collect()}
    assert got == {("binds", "KD", "<"), ("neutralizes", "EC50", "")}
    assert adapters.receptors(spark, main)[1].count() == 0


def test_identity_matrix(spark):
    single = S.is_single_domain("format", F.lit(""), "heavy", "light")
    rows = [("s", "1", "n", VH, VL, ""), ("t", "2", "m", VH, VL, ""), ("s", "3", "n", VH, "", ""), ("s", "4", "n", VH, "", ""), ("s", "5", "a", VH, "", "VHH"), ("t", "6", "b", VH, "", "nanobody")]
    df = spark.createDataFrame(rows, "source string, record_id string, name string, heavy string, light string, format string")
    ids = [r.x for r in df.select(S.identity("source", "record_id", "name", "heavy", "light", single).alias("x")).collect()]
    assert ids[0] == ids[1] and ids[2] != ids[3] and ids[4] == ids[5] and len(set(ids)) == 4


def test_merge_takes_the_first_filled_value(spark):
    rows = [("e", "b", 1, 1, "r1", "", "human", ["z"]), ("e", "a", 0, 1, "r2", "first", "", ["y"]), ("e", "a", 0, 2, "r2", "second", "mouse", ["first"])]
    df = spark.createDataFrame(rows, "antibody_id string, source string, source_ord int, row_ord int, record_id string, name string, organism string, aliases array<string>")
    got = entities.merge(df).first()
    assert (got.name, got.organism, got.sources, got.source_record_count) == ("first", "mouse", ["a", "b"], 2)
    assert got.aliases == ["second", "y", "z"]
    clash = entities.conflicts(df, ("organism",)).collect()
    assert [(c.existing_value, c.incoming_value) for c in clash] == [("mouse", "human")]


def test_alias_collisions_are_an_error(spark):
    with pytest.raises(ValueError, match="belongs to both"):
        targets.alias_table(spark, {"A": ["x-1"], "B": ["X1"]})


def test_batches_are_told_apart(spark):
    assert [tuple(r) for r in tabular.parse_batch(spark, ">a\nAC\nDE\n>\nFG").orderBy("record").select("name", "sequence").collect()] == [("a", "ACDE"), ("sequence_2", "FG")]
    assert tabular.parse_batch(spark, "id,vh,vl\nq,acd,efg").first()[1:4] == ("q", "ACD", "EFG")
    assert [r.sequence for r in tabular.parse_batch(spark, "acd\n\nefg").orderBy("record").collect()] == ["ACD", "EFG"]
    with pytest.raises(ValueError, match="quote"):
        tabular.parse_batch(spark, 'id,vh\n"q,acd')


def test_many_batches_are_read_alike(spark):
    raw = {"fasta": ">a\nAC\nDE\n>\nFG", "table": "id,vh,vl\nq,acd,efg\n\n", "lines": "acd\n\nefg", "bad": 'id,vh\n"q,acd', "none": None}
    got = tabular.parse_batches(spark.createDataFrame(list(raw.items()), "batch string, raw string")).orderBy("batch", "record").collect()
    want = [(k, *r, None) for k in ("fasta", "lines", "table") for r in tabular._parsed(raw[k])]
    assert [tuple(r) for r in got if r.batch != "bad"] == want
    assert [(r.record, r.error) for r in got if r.batch == "bad"] == [(None, "unclosed quote in table")]

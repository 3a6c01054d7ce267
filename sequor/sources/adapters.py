"""One adapter for each public source format: ``(observations, interactions)``.

Every adapter names its columns; the rest (normalising, quarantine, identity) is
shared.  A field with a character outside its alphabet is emptied and kept raw
in ``quarantine``; such a record stays, but its claims are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.functions import relations as R
from sequor.functions import sequences as S
from sequor.functions import text as T
from sequor.sources.tabular import cell, read_csv, require

AMINO = ("heavy", "light", "cdrh1", "cdrh2", "cdrh3", "cdrl1", "cdrl2", "cdrl3")
NUCLEOTIDE = ("vh_nt_source", "vl_nt_source")
PLAIN = ("organism", "format", "heavy_v", "heavy_d", "heavy_j", "light_v", "light_j", "therapeutic_status", "reference", "record_url")
Pair = tuple[DataFrame, DataFrame]
_MEASUREMENTS = "array<struct<metric:string,value:double,unit:string,qualifier:string,raw_value:string,assay_id:string>>"


def observe(rows: DataFrame, source: str, record_id: Column, name: Column, source_url: str = "", **fields: Column) -> DataFrame:
    """The common observation columns beside those of ``rows``; ``fields`` gives what the source has."""
    raw = {f: T.fold_missing(fields.get(f, F.lit(""))) for f in (*AMINO, *NUCLEOTIDE)}
    out = rows.withColumns({f"raw_{f}": c for f, c in raw.items()})
    clean = {f: S.residues(f"raw_{f}") for f in AMINO} | {f: S.nucleotides(f"raw_{f}") for f in NUCLEOTIDE}
    bad = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"raw_{f}").alias("raw"), clean[f].isNull().alias("bad")) for f in clean])
    rid, nm = T.fold_missing(record_id), T.fold_missing(name)
    out = out.withColumns(
        {
            "source": F.lit(source),
            "record_id": F.when(rid != "", rid).otherwise(nm),
            "name": F.when(nm != "", nm).when(rid != "", rid).otherwise("Unnamed antibody"),
            "source_url": F.lit(source_url),
            "quarantine": F.map_from_entries(F.transform(F.filter(bad, lambda x: x["bad"]), lambda x: F.struct(x["field"], x["raw"]))),
            **{f: F.coalesce(c, F.lit("")) for f, c in clean.items()},
            **{f: fields.get(f, F.lit("")) for f in PLAIN},
            "aliases": fields.get("aliases", F.array().cast("array<string>")),
            "structures": fields.get("structures", F.array().cast("array<string>")),
            "structure_tiers": fields.get("structure_tiers", F.create_map().cast("map<string,array<string>>")),
            "metadata": F.map_filter(fields.get("metadata", F.create_map().cast("map<string,string>")), lambda k, v: v != ""),
            "construct_id": fields.get("construct_id", F.lit("")),
            "arm_id": fields.get("arm_id", F.lit("")),
        }
    ).drop(*[f"raw_{f}" for f in raw])
    out = out.withColumn("link_scope", F.when(F.col("record_url") != "", "record").otherwise("source_homepage"))
    single = S.is_single_domain("format", F.coalesce(F.try_element_at("metadata", F.lit("domain_type")), F.lit("")), "heavy", "light")
    return out.withColumn("antibody_id", S.identity("source", "record_id", "name", "heavy", "light", single))


def claims(observations: DataFrame, edges: Column) -> DataFrame:
    """Interactions from an array of edge structs; quarantined observations make none."""
    edge = F.explode(edges).alias("e")
    cols = ("antibody_id", "source", F.col("record_id").alias("source_record_id"), "reference", "record_url", "link_scope")
    return observations.where(F.size("quarantine") == 0).select(*cols, edge).select(*[c if isinstance(c, str) else "source_record_id" for c in cols], "e.*")


def _edge(target: Column, relationship: Column, evidence: str | Column = "CURATED", **more: Column) -> Column:
    blank = F.lit("")
    ev = F.lit(evidence) if isinstance(evidence, str) else evidence
    return F.struct(
        target.alias("target_raw"),
        relationship.alias("relationship"),
        ev.alias("evidence"),
        *[more.get(k, blank).alias(k) for k in ("epitope", "assay", "note")],
        more.get("assertion_origin", F.lit("source")).alias("assertion_origin"),
        more.get("target_external_id", blank).alias("target_external_id"),
        more.get("assay_ids", F.array().cast("array<string>")).alias("assay_ids"),
        more.get("measurements", F.array().cast(_MEASUREMENTS)).alias("measurements"),
    )


def unpivot(fields: dict[str, str], df: DataFrame) -> Column:
    """``array<struct<relationship, raw>>`` of the listed values of several relation columns."""
    return unpivot_cells({r: cell(df, f) for f, r in fields.items()})


def unpivot_cells(cells: dict[str, Column]) -> Column:
    """The same of cells by relationship."""

    def listed(relationship: str, c: Column) -> Column:
        return F.transform(T.split_values(c), lambda v: F.struct(F.lit(relationship).alias("relationship"), v.alias("raw")))

    return F.flatten(F.array(*[listed(r, c) for r, c in cells.items()]))


def literature(spark: SparkSession, path: str, source_url: str = "") -> Pair:
    """Mention groups: each term on its own, as context and never as a target."""
    df = read_csv(spark, path, ("ID", "heavy_sequence", "light_sequence", "targets_mentioned"), "literature")
    df = df.where(cell(df, "targets_mentioned") != "")
    kind = F.when(cell(df, "light_sequence") != "", "paired antibody").otherwise("antibody")
    meta = F.create_map(F.lit("pairing"), cell(df, "pairing"), F.lit("update_date"), cell(df, "update_date"))
    obs = observe(df, "plabdab", F.col("ID"), F.col("ID"), source_url, heavy=F.col("heavy_sequence"), light=F.col("light_sequence"), organism=cell(df, "organism"), format=kind, reference=cell(df, "reference_title"), metadata=meta)
    terms = T.split_values("targets_mentioned", ";")
    return obs, claims(obs, F.transform(terms, lambda t: _edge(t, F.lit("mentioned_with"), "LITERATURE_METADATA")))


def is_multispecific(df: DataFrame) -> Column:
    """By format, by a second chain set, or by several listed targets."""
    second = (cell(df, "HeavySequence(ifbispec)") != "") | (cell(df, "LightSequence(ifbispec)") != "")
    return cell(df, "Format").rlike(r"(?i)\b(?:bi|tri|tetra|multi|quadri|penta)spec") | second | (F.size(T.split_values(cell(df, "Target"))) > 1)


def therapeutic(spark: SparkSession, path: str, source_url: str = "", summary_url: str = "") -> Pair:
    """Therapeutic constructs; a multispecific one gives an observation for each arm.

    Arms get targets only where every arm has an explicit target column.
    """
    df = read_csv(spark, path, ("Therapeutic", "HeavySequence", "LightSequence", "Target"), "therapeutic")
    df = df.withColumn("_name", cell(df, "Therapeutic")).where("_name <> ''")
    pick = lambda *names: F.coalesce(*[F.nullif(cell(df, n), F.lit("")) for n in names], F.lit(""))
    arm = lambda role, h, li, target: F.struct(F.lit(role).alias("role"), S.residues(cell(df, h)).alias("heavy"), S.residues(cell(df, li)).alias("light"), target.alias("target"))
    arms = F.filter(
        F.array(
            arm("primary", "HeavySequence", "LightSequence", pick("Target (HeavySequence)", "Target (primary)")),
            arm("ifbispec", "HeavySequence(ifbispec)", "LightSequence(ifbispec)", pick("Target (HeavySequence(ifbispec))", "Target (ifbispec)")),
        ),
        lambda a: a["heavy"].isNotNull() & a["light"].isNotNull() & ((a["heavy"] != "") | (a["light"] != "")),
    )
    tiers = F.create_map(F.lit("100%"), T.structure_ids(cell(df, "100% SI Structure")), F.lit("99%"), T.structure_ids(cell(df, "99% SI Structure")), F.lit("95-98%"), T.structure_ids(cell(df, "95-98% SI Structure")))
    status = F.array_join(F.filter(F.array(cell(df, "Est. Status"), cell(df, "Highest_Clin_Trial (Feb '25)")), lambda x: x != ""), "; ")
    df = df.withColumns({"_multi": is_multispecific(df), "_arms": arms, "_tiers": tiers, "_status": status, "_targets": T.split_values(cell(df, "Target")), "_aliases": T.split_values(cell(df, "Alternative Therapeutic Names"))})
    mapped = (F.size("_arms") > 0) & F.forall("_arms", lambda a: a["target"] != "")
    empty = F.array(F.struct(F.lit("unavailable").alias("role"), F.lit("").alias("heavy"), F.lit("").alias("light"), F.lit("").alias("target")))
    whole = F.array(F.struct(F.lit("").alias("role"), cell(df, "HeavySequence").alias("heavy"), cell(df, "LightSequence").alias("light"), F.lit("").alias("target")))
    df = df.withColumns({"_mapped": F.col("_multi") & mapped, "_use": F.when(~F.col("_multi"), whole).when(F.size("_arms") == 0, empty).otherwise(F.col("_arms"))})
    df = df.select("*", F.posexplode("_use").alias("_i", "_arm"))
    label = F.concat(F.lit("arm_"), F.col("_i") + 1)
    construct = F.concat(F.lit("construct_"), T.digest(F.lit("therasabdab"), "_name"))
    name = F.when(F.col("_multi") & (F.col("_i") > 0), F.concat("_name", F.lit(" ["), label, F.lit("]"))).otherwise(F.col("_name"))
    alone = ~F.col("_multi")
    none = F.array().cast("array<string>")
    state = F.when(F.col("_mapped"), "arm_mapped_explicit_source_field").when(F.col("_multi"), "unavailable_no_arm_mapping").otherwise("construct_level")
    meta = F.create_map(
        *[x for k, c in (("companies", "Companies"), ("year_proposed", "Year Proposed"), ("genetics", "Genetics (Bispecifics delimited with semicolon)"), ("conditions_approved", "Conditions Approved")) for x in (F.lit(k), cell(df, c))],
        F.lit("multispecific"), F.when(F.col("_multi"), "true").otherwise(""),
        F.lit("target_assignment_status"), state,
        F.lit("arm_role"), F.when(F.col("_multi"), F.col("_arm.role")).otherwise(""),
    )
    obs = observe(
        df, "therasabdab", F.col("_name"), name, source_url,
        heavy=F.col("_arm.heavy"), light=F.col("_arm.light"), format=cell(df, "Format"), metadata=meta,
        therapeutic_status=F.when(alone, F.col("_status")).otherwise(""),
        aliases=F.when(F.col("_multi") & (F.col("_i") > 0), F.concat(F.array("_name"), F.col("_aliases"))).otherwise(F.col("_aliases")),
        structures=F.when(alone, F.element_at("_tiers", "100%")).otherwise(none),
        structure_tiers=F.when(alone, F.col("_tiers")).otherwise(F.create_map().cast("map<string,array<string>>")),
        record_url=F.concat(F.lit(summary_url), T.percent_encode("_name")),
        construct_id=construct, arm_id=F.when(F.col("_multi"), F.concat(construct, F.lit(":"), label)).otherwise(""),
    )
    targets = F.when(F.col("_mapped"), F.array("_arm.target")).when(alone, F.col("_targets")).otherwise(none)
    return obs, claims(obs, F.transform(targets, lambda t: _edge(t, F.lit("targets"))))


_COV_RELATIONS = {"Binds to": "binds", "Doesn't Bind to": "does_not_bind", "Neutralising Vs": "neutralizes", "Not Neutralising Vs": "does_not_neutralize"}


def coronavirus(spark: SparkSession, path: str, source_url: str = "") -> Pair:
    """Four relation columns; binding ones also assert what the epitope names."""
    df = read_csv(spark, path, ("Name", "Binds to", "VHorVHH", "VL"), "coronavirus")
    df = df.where(cell(df, "Name") != "")
    meta = F.create_map(F.lit("date_added"), cell(df, "Date Added"), F.lit("last_updated"), cell(df, "Last Updated"))
    obs = observe(
        df, "covabdab", F.col("Name"), F.col("Name"), source_url, heavy=F.col("VHorVHH"), light=F.col("VL"), cdrh3=cell(df, "CDRH3"), cdrl3=cell(df, "CDRL3"),
        organism=cell(df, "Origin"), format=cell(df, "Ab or Nb"), heavy_v=cell(df, "Heavy V Gene"), heavy_j=cell(df, "Heavy J Gene"), light_v=cell(df, "Light V Gene"), light_j=cell(df, "Light J Gene"),
        structures=T.structure_ids(cell(df, "Structures")), reference=cell(df, "Sources"), metadata=meta,
    )
    epitope = cell(df, "Protein + Epitope")
    entity = lambda x: T.without_tail(x["raw"])
    plain = lambda x: F.array(F.struct(F.replace(entity(x), F.lit("_"), F.lit(" ")).alias("target"), F.lit("source").alias("origin")))
    fan = lambda x: F.transform(
        F.when(x["relationship"].contains("bind"), R.epitope_targets(entity(x), epitope)).otherwise(plain(x)),
        lambda t: _edge(t["target"], x["relationship"], epitope=epitope, note=F.when(x["raw"] != entity(x), x["raw"]).otherwise(""), assertion_origin=t["origin"]),
    )
    return obs, claims(obs, F.flatten(F.transform(unpivot(_COV_RELATIONS, df), fan)))


_POX = "(virus[-clade]_strain{})"
_POX_RELATIONS = {
    "Binds to" + _POX.format("_location_protein"): "binds",
    "Does not bind to" + _POX.format("_location_protein"): "does_not_bind",
    "Neutralises" + _POX.format("_location"): "neutralizes",
    "Does not neutralise" + _POX.format("_location"): "does_not_neutralize",
    "Protects against" + _POX.format(""): "protects",
    "Does not protect against" + _POX.format(""): "does_not_protect",
}


def orthopox(spark: SparkSession, path: str, source_url: str = "") -> Pair:
    """Six relation columns of coded entities; every token after the virus stays."""
    df = read_csv(spark, path, ("Name", "Binds to" + _POX.format("_location_protein"), "VH or VHH", "VL"), "orthopox")
    df = df.where(cell(df, "Name") != "")
    meta = F.create_map(F.lit("added"), cell(df, "Added"), F.lit("modified"), cell(df, "Modified"), F.lit("epitope_type"), cell(df, "Epitope type"))
    obs = observe(
        df, "poxabdab", F.col("Name"), F.col("Name"), source_url, heavy=F.col("`VH or VHH`"), light=F.col("VL"), cdrh3=cell(df, "CDRH3"), cdrl3=cell(df, "CDRL3"),
        organism=cell(df, "Species origin"), format=cell(df, "Construct"), heavy_v=cell(df, "Heavy V gene"), heavy_j=cell(df, "Heavy J gene"), light_v=cell(df, "Light V gene"), light_j=cell(df, "Light J gene"),
        structures=T.structure_ids(cell(df, "Solved structures")), reference=cell(df, "Sources"), metadata=meta,
    )
    fan = lambda x: _edge(R.virus_entity(x["raw"])["target"], x["relationship"], epitope=cell(df, "Epitope type"), note=R.virus_entity(x["raw"])["note"])
    return obs, claims(obs, F.transform(unpivot(_POX_RELATIONS, df), fan))


def _chain(df: DataFrame, role: str, part: Callable[[str], Column]) -> Column:
    """A value of the first chain that has the role."""
    first = R.chain_role(cell(df, "chain_1__type")) == role
    second = R.chain_role(cell(df, "chain_2__type")) == role
    return F.when(first, part("chain_1")).when(second, part("chain_2")).otherwise("")


def _chain_struct(df: DataFrame, role: str) -> Column:
    """The annotation of the chain of a role: regions and genes, chosen, calculated and curated; null without such a chain."""

    def of(p: str) -> Column:
        c = lambda name: cell(df, f"{p}__{name}")
        choice = lambda calculated, curated: F.struct(F.when(calculated != "", calculated).otherwise(curated).alias("chosen"), calculated.alias("calculated"), curated.alias("curated"))
        regions = [choice(c(f"cdr{n}_calculated"), c(f"cdr{n}_curated")).alias(f"CDR{n}") for n in (1, 2, 3)]
        spans = [F.concat_ws("-", c(f"cdr{n}_start_{kind}"), c(f"cdr{n}_end_{kind}")).alias(f"CDR{n}_{kind}_span") for n in (1, 2, 3) for kind in ("calculated", "curated")]
        genes = [choice(c(f"calculated_{g}_gene"), c(f"curated_{g}_gene")).alias(g.upper()) for g in "vdj"]
        calculated = (c("cdr1_calculated") != "") | (c("cdr2_calculated") != "") | (c("cdr3_calculated") != "")
        return F.struct(
            c("type").alias("chain_type"), c("organism_iri").alias("organism_iri"), c("protein_iri").alias("protein_iri"), c("protein_sequence").alias("source_full_protein"),
            c("v_domain_calculated").alias("calculated_v_domain"), c("nucleotide_sequence").alias("source_nucleotide"), F.when(calculated, "IMGT").otherwise("").alias("numbering_scheme"),
            F.when(calculated, "IEDB calculated").otherwise("IEDB curated").alias("annotation_origin"), F.struct(*regions, *spans).alias("regions"), F.struct(*genes).alias("genes"),
        )

    first, second = (R.chain_role(cell(df, f"chain_{n}__type")) == role for n in (1, 2))
    return F.when(first, of("chain_1")).when(second, of("chain_2"))


def receptors(spark: SparkSession, path: str, source_url: str = "", links_path: str | None = None, assays_path: str | None = None) -> Pair:
    """Receptor groups joined to their assays; no assay rows, no interactions."""
    df = read_csv(spark, path, ("receptor_group_id", "receptor__type", "epitope__name", "chain_1__type", "chain_2__type"), "receptors")
    df = df.withColumn("receptor_group_id", cell(df, "receptor_group_id")).where("receptor_group_id <> ''")
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    region = lambda n: lambda p: either(cell(df, f"{p}__cdr{n}_calculated"), cell(df, f"{p}__cdr{n}_curated"))
    gene = lambda g: lambda p: either(cell(df, f"{p}__calculated_{g}_gene"), cell(df, f"{p}__curated_{g}_gene"))
    both = lambda role: F.to_json(_chain_struct(df, role))
    fields = {f"cdr{c}{n}": _chain(df, role, region(n)) for c, role in (("h", "VH"), ("l", "VL")) for n in (1, 2, 3)}
    fields |= {f"heavy_{g}": _chain(df, "VH", gene(g)) for g in "vdj"} | {f"light_{g}": _chain(df, "VL", gene(g)) for g in "vj"}
    meta = F.create_map(*[x for k, c in (("iedb_receptor_id", "receptor__iedb_receptor_id"), ("epitope_iri", "epitope__iedb_iri"), ("epitope_name", "epitope__name"), ("epitope_source_organism", "epitope__source_organism")) for x in (F.lit(k), cell(df, c))])
    name = either(cell(df, "receptor__reference_name"), F.concat(F.lit("IEDB BCR "), F.col("receptor_group_id")))
    obs = observe(
        df, "iedb", F.col("receptor_group_id"), name, source_url,
        heavy=_chain(df, "VH", lambda p: cell(df, f"{p}__v_domain_calculated")), light=_chain(df, "VL", lambda p: cell(df, f"{p}__v_domain_calculated")),
        vh_nt_source=_chain(df, "VH", lambda p: cell(df, f"{p}__nucleotide_sequence")), vl_nt_source=_chain(df, "VL", lambda p: cell(df, f"{p}__nucleotide_sequence")),
        format=F.trim(F.concat(F.lit("IEDB "), cell(df, "receptor__type"))), reference=cell(df, "reference__iedb_iri"), record_url=cell(df, "receptor__group_iri"), metadata=meta, **fields,
    )
    # both the curated and the calculated values stay, whichever was chosen
    obs = obs.withColumn("chain_annotations", F.map_filter(F.create_map(F.lit("VH"), both("VH"), F.lit("VL"), both("VL")), lambda k, v: v.isNotNull()))
    obs = obs.withColumn("nucleotide_scope", F.lit("full_length_bcr"))
    if not links_path or not assays_path:
        return obs, claims(obs, F.filter(F.array(_edge(F.lit(""), F.lit(""))), lambda e: e["target_raw"] != ""))
    groups = read_csv(spark, links_path, ("receptor_group_id", "iedb_assay_ids"), "receptor links")
    assays = read_csv(spark, assays_path, ("assay_id", "assay__method"), "assays")
    linked = groups.select(cell(groups, "receptor_group_id").alias("receptor_group_id"), F.explode(T.array_literal("iedb_assay_ids")).alias("assay_id")).distinct()
    found = linked.join(assay_claims(assays), "assay_id")
    joined = obs.where(F.size("quarantine") == 0).select("antibody_id", "source", "record_id", "receptor_group_id").join(found, "receptor_group_id")
    out = joined.select("antibody_id", "source", F.col("record_id").alias("source_record_id"), F.col("reference"), F.col("record_url"), F.lit("record").alias("link_scope"), "e.*")
    return obs, out.dropDuplicates(["antibody_id", "source_record_id", "assay_ids", "target_external_id", "measurements"])


def assay_claims(assays: DataFrame) -> DataFrame:
    """``(assay_id, reference, record_url, e)`` of assay rows that support a claim."""
    require(assays, ("assay_id", "assay__method"), "assays")
    c = lambda n: cell(assays, n)
    parent = c("epitope__molecule_parent") != ""
    target = F.when(parent, c("epitope__molecule_parent")).otherwise(c("epitope__source_molecule"))
    external = F.when(parent, c("epitope__molecule_parent_iri")).otherwise(c("epitope__source_molecule_iri"))
    response, method, quality = c("assay__response_measured"), c("assay__method"), F.lower(c("assay__qualitative_measure"))
    negative, positive = quality.startswith("negative"), quality.startswith("positive")
    metric, raw = R.metric(response), c("assay__quantitative_measurement")
    functional = F.lower(F.concat_ws(" ", response, method)).contains("neutral")
    # a quantity that is no measurement is not measured evidence
    m = R.measurement(raw, c("assay__measurement_inequality"))
    measured = (metric != "") & m.isNotNull()
    relationship = F.when(functional, F.when(negative, "does_not_neutralize").otherwise("neutralizes")).when(R.is_binding_assay(method, response, metric), F.when(negative, "does_not_bind").otherwise("binds"))
    one = F.struct(metric.alias("metric"), m["value"].alias("value"), c("assay__units").alias("unit"), m["qualifier"].alias("qualifier"), m["raw_value"].alias("raw_value"), c("assay_id").alias("assay_id"))
    unmapped = F.when((raw != "") & (metric == ""), F.concat(F.lit("Unmapped quantitative response: "), response, F.lit(" "), raw, F.lit(" "), c("assay__units"))).otherwise("")
    edge = _edge(
        target, relationship, F.when(measured, "MEASURED").otherwise("CURATED"),
        epitope=c("epitope__name"), assay=F.array_join(F.filter(F.array(method, response), lambda x: x != ""), " · "),
        note=F.array_join(F.filter(F.array(c("assay__comments"), unmapped), lambda x: x != ""), "; "),
        target_external_id=external, assay_ids=F.array(c("assay_id")),
        measurements=F.when(measured, F.array(one)).otherwise(F.array().cast(_MEASUREMENTS)),
    )
    kept = assays.where((target != "") & (external != "") & relationship.isNotNull() & (negative | positive | measured) & (c("assay_id") != ""))
    return kept.select(c("assay_id").alias("assay_id"), c("reference__iedb_iri").alias("reference"), c("assay_id__iedb_iri").alias("record_url"), edge.alias("e"))


#: The plug-in point: a source key and its adapter.
ADAPTERS: dict[str, Callable[..., Pair]] = {"plabdab": literature, "therasabdab": therapeutic, "covabdab": coronavirus, "poxabdab": orthopox, "iedb": receptors}

"""Integrity rules over built tables: ``(rule, subject, message)`` rows; none means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequor.functions import relations as R
from sequor.functions import sequences as S
from sequor.functions import text as T
from sequor.operators.exports import shard
from sequor.operators.similarity import POSTING_ROWS, capped, signatures
from sequor.operators.storage import tasks
from sequor.operators.targets import descendants

SCHEMA = "rule string, subject string, message string"
# What a source nucleotide may cover.
NUCLEOTIDE_SCOPES = ("variable_domain", "full_length_bcr", "unknown")


def found(rows: DataFrame, rule: str, subject: Column | str, message: str) -> DataFrame:
    s = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(F.lit(rule).alias("rule"), s.cast("string").alias("subject"), F.lit(message).alias("message"))


def duplicates(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return found(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), rule, key, "duplicate id")


def dangling(rows: DataFrame, col: str, other: DataFrame, key: str, rule: str, message: str) -> DataFrame:
    return found(rows.where(F.col(col).isNotNull()).join(other.select(F.col(key).alias(col)).distinct(), col, "left_anti"), rule, col, message)


def counts_agree(declared: dict[str, int], tables: dict[str, DataFrame]) -> DataFrame:
    """V1: a manifest's counts against the tables."""
    parts = [t.agg(F.count("*").alias("n")).where(F.col("n") != declared.get(k, -1)).select(F.lit("V1").alias("rule"), F.lit(k).alias("subject"), F.lit("count differs from manifest").alias("message")) for k, t in tables.items()]
    return _union(parts)


def entities(antibodies: DataFrame) -> DataFrame:
    """V2, V3: unique ids, right shard, direct target list, lengths recomputed."""
    parts = [duplicates(antibodies, "antibody_id", "V2")]
    if "shard" in antibodies.columns:
        parts.append(found(antibodies.where(F.col("shard") != shard("antibody_id")), "V2", "antibody_id", "wrong shard"))
    if "direct_targets" in antibodies.columns:
        parts.append(found(antibodies.where("direct_targets is null"), "V3", "antibody_id", "no direct target list"))
    if "quality" in antibodies.columns:
        again = S.quality("heavy", "light", F.col("quality.explicit_vhh"), F.col("quality.source_format_quarantined"), F.col("quality.source_nucleotide_available"))
        parts.append(found(antibodies.where(F.to_json(again) != F.to_json("quality")), "V3", "antibody_id", "sequence quality differs"))
    return _union(parts)


def nucleotides(records: DataFrame, sources: DataFrame) -> DataFrame:
    """V4: alphabet, and a source record for every nucleotide record."""
    bad = records.where(F.col("sequence").rlike("[^ACGTRYSWKMBDHVN]") | (F.col("sequence") == ""))
    keys = ["source", "source_record_id"]
    lost = records.join(sources.select("source", F.col("record_id").alias("source_record_id")).distinct(), keys, "left_anti")
    parts = [found(bad, "V4", "source_record_id", "nucleotide alphabet"), found(lost, "V4", "source_record_id", "no source record")]
    if "scope" in records.columns:
        parts.append(found(records.where(~F.col("scope").isin(*NUCLEOTIDE_SCOPES)), "V4", "source_record_id", "scope vocabulary"))
    if "chain" in records.columns:
        parts.append(found(records.where(~F.col("chain").isin("VH", "VL")), "V4", "source_record_id", "chain vocabulary"))
    return _union(parts)


def contexts(observations: DataFrame, claims: DataFrame) -> DataFrame:
    """V5: record links have a url; arms without a mapping make no claim."""
    parts = [found(observations.where("link_scope = 'record' and record_url = ''"), "V5", "record_id", "record link without url")]
    unmapped = observations.where(F.try_element_at("metadata", F.lit("target_assignment_status")) == "unavailable_no_arm_mapping").select("antibody_id").distinct()
    parts.append(found(claims.join(unmapped, "antibody_id", "left_semi"), "V5", "antibody_id", "claim on an unassigned arm"))
    if "construct_id" in observations.columns:
        multi = observations.where(F.coalesce(F.try_element_at("metadata", F.lit("multispecific")), F.lit("")) != "")
        parts.append(found(multi.where((F.col("construct_id") == "") | (F.col("arm_id") == "")), "V5", "record_id", "multispecific without construct or arm"))
    if "chain_annotations" in observations.columns:
        odd = observations.where(F.size(F.array_except(F.map_keys("chain_annotations"), F.array(F.lit("VH"), F.lit("VL")))) > 0)
        parts.append(found(odd, "V5", "record_id", "chain annotations"))
    return _union(parts)


def pages(paged: DataFrame, claims: DataFrame, antibodies: DataFrame, size: int = 100) -> DataFrame:
    """V6: page sizes, families, referenced antibodies, and every row backed by a claim of its family."""
    over = paged.groupBy("target_id", "family", "page").agg(F.count("*").alias("n")).where(F.col("n") > size)
    backed = claims.select("target_id", R.family("relationship").alias("family"), "antibody_id").distinct()
    loose = paged.join(backed, ["target_id", "family", "antibody_id"], "left_anti")
    gone = backed.where(F.col("family").isin("direct", "functional", "negative")).join(paged, ["target_id", "family", "antibody_id"], "left_anti")
    return _union(
        [
            found(over, "V6", "target_id", "page too long"),
            found(loose, "V6", "antibody_id", "row without claim of its family"),
            found(gone, "V6", "antibody_id", "claim without row"),
            dangling(paged, "antibody_id", antibodies, "antibody_id", "V6", "unknown antibody"),
        ]
    )


def measurements(rows: DataFrame) -> DataFrame:
    """V7: vocabulary, finite values, each (interaction, metric, assay) once, and assays that the interaction names."""
    bad = rows.where(~F.col("metric").isin(*R.METRICS) | ~F.col("qualifier").isin(*R.QUALIFIERS))
    wild = rows.where(F.isnan("value") | (F.abs("value") == float("inf")))
    twice = rows.groupBy("interaction_id", "metric", "assay_id", "raw_value").agg(F.count("*").alias("n")).where("n > 1")
    parts = [found(bad, "V7", "interaction_id", "vocabulary"), found(wild, "V7", "interaction_id", "not finite"), found(twice, "V7", "interaction_id", "duplicate measurement")]
    if "assay_ids" in rows.columns:
        parts.append(found(rows.where(~F.array_contains("assay_ids", F.col("assay_id"))), "V7", "interaction_id", "assay not linked"))
    return _union(parts)


def hierarchy(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """V8: parents exist, and no target is its own ancestor."""
    below = descendants(edges, edges.select(F.col("parent")).distinct())
    return _union([dangling(edges, "parent", targets, "id", "V8", "unknown parent"), found(below.where("root = id"), "V8", "id", "cycle")])


def children(targets: DataFrame) -> DataFrame:
    """V8: a target is among its parent's children, and a child names its parent."""
    up = targets.where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("target_id").alias("child"))
    down = targets.select(F.col("target_id").alias("parent"), F.explode("children").alias("child"))
    return _union([found(up.join(down, ["parent", "child"], "left_anti"), "V8", "child", "not among its parent's children"), found(down.join(up, ["parent", "child"], "left_anti"), "V8", "child", "child of another parent")])


def names(index: DataFrame, terms: DataFrame) -> DataFrame:
    """V9: terms normal, in the right bucket, and the index and the names agree both ways."""
    flat = index.select("bucket", "term", F.explode("ids").alias("id"))
    odd = index.where((F.col("term") != T.search_term("term", False)) | (F.col("bucket") != T.search_bucket("term")))
    return _union(
        [
            found(odd, "V9", "term", "not normal or in the wrong bucket"),
            found(flat.join(terms, ["bucket", "term", "id"], "left_anti"), "V9", "term", "indexed but not named"),
            found(terms.join(flat, ["bucket", "term", "id"], "left_anti"), "V9", "term", "named but not indexed"),
        ]
    )


def sequences(index: DataFrame, rows: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """V10: hashes and lengths recomputed."""
    real = rows.where(F.col(field) != "").select(F.col(id_col).alias("id"), F.sha2(field, 256).alias("sha"), F.length(field).cast("long").alias("length"))
    held = index.where(F.col("field") == field).select("id", "sha", "length")
    keys = ["id", "sha", "length"]
    return _union([found(held.join(real, keys, "left_anti"), "V10", "id", "hash or length differs"), found(real.join(held, keys, "left_anti"), "V10", "id", "not indexed")])


def regions(index: DataFrame, rows: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """V11: region buckets hold their length, and their members have the region."""
    odd = index.where(F.length("sequence") != F.col("len"))
    real = rows.where(F.col(field) != "").select(F.col(id_col).alias("id"), F.col(field).alias("sequence"))
    held = index.select("id", "sequence")
    return _union([found(odd, "V11", "sequence", "wrong length bucket"), found(held.join(real, ["id", "sequence"], "left_anti"), "V11", "id", "member without the region"), found(real.join(held, ["id", "sequence"], "left_anti"), "V11", "id", "region not indexed")])


def postings(index: DataFrame, rows: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """V12: postings recomputed, none twice.

    Both sides meet in one grouping by hash and id, whose tasks grow with them.
    """
    side = lambda df, held, real: df.select("hash", "id", F.lit(held).alias("h"), F.lit(real).alias("r"))
    real = capped(signatures(rows, field, id_col))
    both = side(index, 1, 0).union(side(real, 0, 1))
    n = tasks(real.sparkSession, real.count(), POSTING_ROWS // 2)
    met = both.repartition(n, "hash", "id").groupBy("hash", "id").agg(F.sum("h").alias("h"), F.sum("r").alias("r")).where("h <> r or h > 1 or hash is null or id is null")
    # a null equals nothing, and each posting that is wrong is told
    alone = F.col("hash").isNull() | F.col("id").isNull()
    times = lambda c, m: F.array_repeat(F.lit(m), c.cast("int"))
    odd = F.when(alone | (F.col("r") == 0), times(F.col("h"), "posting without hash")).otherwise(F.array())
    gone = F.when(alone | (F.col("h") == 0), times(F.col("r"), "hash without posting")).otherwise(F.array())
    twice = F.when(F.col("h") > 1, F.array(F.lit("duplicate posting"))).otherwise(F.array())
    return met.select(F.lit("V12").alias("rule"), F.col("id").cast("string").alias("subject"), F.explode(F.concat(odd, gone, twice)).alias("message"))


def cluster_members(members: DataFrame) -> DataFrame:
    """V13: two members at least, the least id represents, one cluster for an id, sizes true."""
    groups = members.groupBy("representative_id").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.max("size").alias("size"))
    bad = groups.where("n < 2 or least <> representative_id or n <> size")
    return _union([found(bad, "V13", "representative_id", "cluster shape"), duplicates(members, "id", "V13")])


def not_empty(tables: dict[str, DataFrame]) -> DataFrame:
    """V14: tables that must have rows."""
    return _union([t.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("V14").alias("rule"), F.lit(k).alias("subject"), F.lit("empty").alias("message")) for k, t in tables.items()])


def linked_assays(claims: DataFrame, source: str) -> DataFrame:
    """V14: a source whose claims are linked to assays must have some that are."""
    linked = claims.where(F.col("source") == source).agg(F.count("*").alias("n"), F.count_if(F.size(F.coalesce("assay_ids", F.array().cast("array<string>"))) > 0).alias("linked"))
    return linked.where("n > 0 and linked = 0").select(F.lit("V14").alias("rule"), F.lit(source).alias("subject"), F.lit("no claim is linked to an assay").alias("message"))


def normal_chains(rows: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """Chains that normalising would change or reject."""
    again = S.residues(field)
    return found(rows.where(again.isNull() | (again != F.col(field))), "V10", id_col, "not in normal form")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out

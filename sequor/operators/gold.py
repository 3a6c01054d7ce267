"""Reviewed cases against a built table: what each expects must be among what is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists that a case expects, and the list of the entity that must contain each.
LISTS = {"direct_targets": "direct_targets", "exact_structures": "exact_structures", "negative_targets": "negative_targets", "literature_targets": "literature_targets", "source_records": "source_records"}


def check_cases(cases: DataFrame, entities: DataFrame, id_col: str = "antibody_id", lists: dict[str, str] = LISTS) -> DataFrame:
    """``(case_id, check, missing)``: members that a case expects of its entity and that are not found; no rows if all hold.

    ``cases`` has ``case_id``, the entity's id, lists as in ``lists`` and may have
    ``chains`` (paired, heavy_only or light_only).  An entity that is not there
    misses itself and nothing else.  Null lists expect nothing.  It is a division
    of relations: expected members less found ones, by joins.
    """
    named = [c for c in lists if c in cases.columns]
    members = [F.struct(F.lit(c).alias("check"), F.coalesce(c, F.array().cast("array<string>")).alias("members")) for c in named]
    expected = cases.select("case_id", id_col, F.explode(F.array(*members)).alias("e")).select("case_id", id_col, "e.check", F.explode(F.array_distinct("e.members")).alias("member"))
    held = [F.struct(F.lit(c).alias("check"), F.coalesce(lists[c], F.array().cast("array<string>")).alias("members")) for c in named]
    found = entities.join(cases.select(id_col).distinct(), id_col, "left_semi").select(id_col, F.explode(F.array(*held)).alias("e")).select(id_col, "e.check", F.explode(F.array_distinct("e.members")).alias("member"))
    there = entities.select(id_col)
    absent = cases.join(there, id_col, "left_anti").select("case_id", F.lit("entity").alias("check"), F.col(id_col).alias("missing"))
    out = expected.join(there, id_col, "left_semi").join(found, [id_col, "check", "member"], "left_anti").select("case_id", "check", F.col("member").alias("missing")).union(absent)
    if "chains" in cases.columns:
        state = F.when((F.col("heavy") != "") & (F.col("light") != ""), "paired").when(F.col("heavy") != "", "heavy_only").otherwise("light_only")
        known = cases.join(entities.select(id_col, state.alias("state")), id_col).where(F.col("chains").isNotNull() & (F.col("chains") != F.col("state")))
        out = out.union(known.select("case_id", F.lit("chains").alias("check"), F.col("chains").alias("missing")))
    return out

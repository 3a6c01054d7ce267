"""Merging observations into entities: one shuffle on the entity id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scalar fields of an entity, in which the first non-empty value wins.
SCALARS = (
    "name heavy light vh_nt_source vl_nt_source cdrh3 cdrl3 cdrh1 cdrh2 cdrl1 cdrl2 organism format heavy_v heavy_d heavy_j light_v light_j therapeutic_status"
).split()
RECORD_DATES = ("date_added", "added", "update_date")


def first_filled(value: Column | str, order: Column | str) -> Column:
    """Aggregate: the first non-empty value in arrival order, else empty."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    return F.coalesce(F.min_by(F.when(v != "", v), F.when(v != "", o)), F.lit(""))


def union_sorted(value: Column | str) -> Column:
    """Aggregate: the sorted union of arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(value))))


def merge(observations: DataFrame, key: str = "antibody_id", order: tuple[str, ...] = ("source_ord", "row_ord")) -> DataFrame:
    """One row for each entity: first-filled scalars, unions of lists, sources and record count."""
    at = F.struct(*order)
    scalars = [first_filled(c, at).alias(c) for c in SCALARS if c in observations.columns]
    extra = []
    if "structures" in observations.columns:
        extra.append(union_sorted("structures").alias("structures"))
    if "aliases" in observations.columns:
        extra.append(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.col("aliases"))))).alias("aliases"))
    for c in ("construct_id", "arm_id"):
        if c in observations.columns:
            extra.append(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(f"{c}s"))
    sources = F.array_sort(F.collect_set("source")).alias("sources")
    records = F.count_distinct("source", "record_id").alias("source_record_count")
    out = observations.groupBy(key).agg(*scalars, *extra, sources, records)
    if "aliases" in observations.columns:
        other = F.filter("aliases", lambda a: (a != F.col("name")) & (a != ""))
        # folded order, the text itself breaking ties
        ranked = F.array_sort(F.transform(other, lambda a: F.struct(F.lower(a).alias("k"), a.alias("a"))))
        out = out.withColumn("aliases", F.transform(ranked, lambda x: x["a"]))
    return out


def merge_metadata(observations: DataFrame, key: str = "antibody_id", order: tuple[str, ...] = ("source_ord", "row_ord")) -> DataFrame:
    """``(key, metadata)``: for each name of the map the first non-empty value."""
    each = observations.select(key, F.struct(*order).alias("at"), F.explode("metadata").alias("k", "v")).where("v <> ''")
    first = each.groupBy(key, "k").agg(F.min_by("v", "at").alias("v"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))


def merge_tiers(observations: DataFrame, key: str = "antibody_id") -> DataFrame:
    """``(key, structure_tiers)``: the sorted union of ids in each tier."""
    each = observations.select(key, F.explode("structure_tiers").alias("tier", "ids")).select(key, "tier", F.explode("ids").alias("id"))
    sets = each.groupBy(key, "tier").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return sets.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "ids")))).alias("structure_tiers"))


def merge_contexts(observations: DataFrame, field: str, key: str = "antibody_id", order: tuple[str, ...] = ("source_ord", "row_ord")) -> DataFrame:
    """``(key, field s)``: an entity's constructs or arms, distinct by id, the first description of each, in order of arrival."""
    each = observations.where(F.col(f"{field}_id") != "").select(key, F.col(f"{field}_id").alias("id"), F.struct(*order).alias("at"), F.coalesce(F.try_element_at("metadata", F.lit("target_assignment_status")), F.lit("")).alias("status"))
    first = each.groupBy(key, "id").agg(F.min("at").alias("at"), F.min_by("status", "at").alias("status"))
    listed = F.array_sort(F.collect_list(F.struct("at", "id", "status")))
    return first.groupBy(key).agg(F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["status"].alias("target_assignment_status"))).alias(f"{field}s"))


def nucleotide_records(observations: DataFrame, key: str = "antibody_id", order: tuple[str, ...] = ("source_ord", "row_ord"), scope: str = "nucleotide_scope") -> DataFrame:
    """``(key, source, source_record_id, chain, sequence, scope, source_field)``: distinct source nucleotides of an entity, first ones kept."""
    told = F.col(scope) if scope in observations.columns else F.lit("unknown")
    each = F.array(*[F.struct(F.lit(c).alias("chain"), F.col(f).alias("sequence"), F.lit(f).alias("source_field")) for c, f in (("VH", "vh_nt_source"), ("VL", "vl_nt_source"))])
    rows = observations.select(key, "source", F.col("record_id").alias("source_record_id"), F.coalesce(told, F.lit("unknown")).alias("scope"), *order, F.explode(each).alias("e")).select("*", "e.*").where("sequence <> ''")
    kept = distinct_first(rows, (key, "source", "source_record_id", "chain", "sequence", "scope"), order)
    return kept.select(key, "source", "source_record_id", "chain", "sequence", "scope", "source_field")


def summaries(antibodies: DataFrame, id_col: str = "antibody_id", names: int = 6, structures: int = 12) -> DataFrame:
    """The short form of an entity on result rows: the first aliases and structures, lengths and shard."""
    tiers = F.coalesce("structure_tiers", F.create_map().cast("map<string,array<string>>"))
    other = F.map_filter(tiers, lambda t, _: ~t.isin("100%", "exact", "exact_100"))
    return antibodies.select(
        id_col, "name", F.slice("aliases", 1, names).alias("aliases"), "organism", "format",
        (F.col("heavy") != "").alias("has_heavy"), (F.col("light") != "").alias("has_light"), F.length("heavy").alias("heavy_length"), F.length("light").alias("light_length"),
        F.slice("structures", 1, structures).alias("exact_structures"), F.transform_values(tiers, lambda _, v: F.slice(v, 1, structures)).alias("structure_tiers"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.map_values(other)))), 1, structures).alias("homologous_structures"),
        "therapeutic_status", F.substring(id_col, 4, 2).alias("shard"),
    )


def structure_collections(tiers: Column | str, exact: Column | str, homologous: Column | str, legacy: Column | str) -> Column:
    """``struct<exact, homologous, unknown>`` lists of structure ids.

    Tiers, where there are any, are the only authority; else the lists are.  An
    id takes its first tier that is not unknown.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    none = F.array().cast("array<string>")
    named = lambda values, tier: F.transform(F.coalesce(values, none), lambda v: F.struct(v.alias("id"), tier.alias("tier")))
    number = lambda t: F.regexp_extract(t, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    tier_of = lambda t: F.when(number(t) == 100, "exact").when(number(t).isNotNull(), "homologous").otherwise("unknown")
    tiered = F.flatten(F.transform(F.map_entries(F.coalesce(c(tiers), F.create_map().cast("map<string,array<string>>"))), lambda e: named(e["value"], tier_of(e["key"]))))
    listed = F.concat(named(c(exact), F.lit("exact")), named(c(homologous), F.lit("homologous")), named(c(legacy), F.lit("unknown")))
    every = F.filter(F.when(F.size(tiered) > 0, tiered).otherwise(listed), lambda x: x["id"] != "")
    ids = F.array_distinct(F.transform(every, lambda x: x["id"]))
    first = lambda i: F.coalesce(F.try_element_at(F.filter(every, lambda x: (x["id"] == i) & (x["tier"] != "unknown")), F.lit(1))["tier"], F.lit("unknown"))
    of = lambda tier: F.filter(ids, lambda i: first(i) == tier).alias(tier)
    return F.struct(*map(of, ("exact", "homologous", "unknown")))


def source_records(observations: DataFrame, key: str = "antibody_id", order: tuple[str, ...] = ("source_ord", "row_ord")) -> DataFrame:
    """Distinct (source, record) of each entity, the first observation's details, and the record date that is filled first."""
    rank = F.row_number().over(Window.partitionBy(key, "source", "record_id").orderBy(*order))
    out = observations.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    if "metadata" not in observations.columns:
        return out
    dates = [F.nullif(F.coalesce(F.try_element_at("metadata", F.lit(d)), F.lit("")), F.lit("")) for d in RECORD_DATES]
    field = F.coalesce(*[F.when(d.isNotNull(), F.lit(n)) for d, n in zip(dates, RECORD_DATES)], F.lit(""))
    return out.withColumns({"record_date": F.coalesce(*dates, F.lit("")), "record_date_field": field})


def conflicts(observations: DataFrame, fields: tuple[str, ...] = ("vh_nt_source", "vl_nt_source"), key: str = "antibody_id", order: tuple[str, ...] = ("source_ord", "row_ord")) -> DataFrame:
    """Later values of a field that differ from the entity's first: each (field, value, source, record) once."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    each = observations.select(key, "source", "record_id", F.struct(*order).alias("at"), F.explode(values).alias("p")).select(key, "source", "record_id", "at", "p.*").where("value <> ''")
    first = each.groupBy(key, "field").agg(F.min_by("value", "at").alias("existing_value"))
    return (
        each.join(first, [key, "field"])
        .where("value <> existing_value")
        .select(key, "field", "existing_value", F.col("value").alias("incoming_value"), F.col("source").alias("incoming_source"), F.col("record_id").alias("incoming_source_record_id"))
        .distinct()
    )


def distinct_first(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Rows distinct by ``keys``, the first one kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

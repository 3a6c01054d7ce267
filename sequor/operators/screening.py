"""Batch screening: every query row gets an outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.functions import sequences as S
from sequor.operators.exports import screening_rows
from sequor.operators.search import exact_sequences, sequence_index
from sequor.operators.similarity import near_regions, similar


_NO_SCORE = ("cast(null as double) as identity", "cast(null as double) as coverage")


def screen(queries: DataFrame, rows: DataFrame, field: str = "heavy", regions: DataFrame | None = None, with_similar: bool = False) -> DataFrame:
    """``(query_id, status, id, distance, identity, coverage)``: EXACT and NEAR hits, SIMILAR chains, else NO MATCH or INVALID.

    ``queries`` has ``query_id`` and ``raw``.  ``regions(id, sequence)`` are short
    regions for near matches.  A query with an exact hit is not searched further.
    """
    asked = queries.select("query_id", S.residues("raw").alias("sequence"))
    valid = asked.where("sequence is not null and sequence <> ''")
    exact = exact_sequences(sequence_index(rows, (field,)), valid, field).select("query_id", "id", F.lit("EXACT").alias("status"), F.lit(0).cast("long").alias("distance"), *map(F.expr, _NO_SCORE))
    hits = exact
    left = valid.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    if regions is not None:
        near = near_regions(left.select(F.col("sequence").alias("query")), regions)
        near = left.join(near, left.sequence == near["query"]).select("query_id", near["sequence"].alias("region"), "distance").join(regions.withColumnRenamed("sequence", "region"), "region")
        near = near.select("query_id", "id", F.when(F.col("distance") == 0, "EXACT").otherwise("NEAR").alias("status"), "distance", *map(F.expr, _NO_SCORE))
        hits = hits.union(near)
        left = left.join(near.select("query_id").distinct(), "query_id", "left_anti")
    if with_similar:
        like = similar(left, rows, field, mode="loose").select("query_id", "id", F.lit("SIMILAR").alias("status"), F.lit(None).cast("long").alias("distance"), "identity", "coverage")
        hits = hits.union(like)
    out = asked.join(hits, "query_id", "left")
    bad = F.col("sequence").isNull() | (F.col("sequence") == "")
    return out.select("query_id", F.when(bad, "INVALID").when(F.col("status").isNull(), "NO MATCH").otherwise(F.col("status")).alias("status"), "id", "distance", "identity", "coverage")


def report(queries: DataFrame, rows: DataFrame, field: str = "heavy", snapshot: str = "", **options) -> DataFrame:
    """The 22 columns of the report on screening ``queries(query_id, raw)``; options are those of :func:`screen`.

    ``rows`` may have ``name``, ``sources`` and ``direct_targets``.  Percentages
    have three places; they are those of similar chains.
    """
    asked = queries.select("query_id", S.residues("raw").alias("query_sequence"))
    lists = [F.array_join(c, "; ").alias(c) for c in ("sources", "direct_targets") if c in rows.columns]
    facts = rows.select("id", F.col(field).alias("matched_sequence"), *([F.col("name").alias("antibody_name")] if "name" in rows.columns else []), *lists)
    out = screen(queries, rows, field, **options).join(asked, "query_id").join(facts, "id", "left")
    scores = {f"{field}_{c}": F.round(c, 3) for c in ("identity", "coverage")}
    out = out.withColumns({**scores, "query_type": F.lit(field)})
    return screening_rows(out.withColumnsRenamed({"status": "match_type", "distance": "edit_distance", "id": "antibody_id"}), snapshot)

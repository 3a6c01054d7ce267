"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.operators.skew import hot_limit, join_hot
from sequor.operators.storage import materialize, release

_MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _met(rows: DataFrame, least: DataFrame, limit: int | None) -> DataFrame:
    return rows.join(least, "u") if limit is None else join_hot(rows, least, "u", limit)


def _large_star(edges: DataFrame, limit: int | None) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _met(both, least, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, limit: int | None) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(edges, least, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its smallest node.

    Edges are undirected; loops, repeats and nulls are ignored.  Each round is
    two joins on node with map-side minima and ends in the shared folder, so
    lineage stays short and a lost executor costs one round.  The edges of a node
    that has very many stay where they are and learn its minimum by a bounded
    broadcast, so a giant component is nobody's single key.  An empty table
    gives an empty result.  Nodes may be of any orderable type.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(_MAX_ROUNDS):
        if not mark[0]:
            break
        limit = hot_limit(2 * mark[0])
        # a node has no more smaller neighbours after a large star than it had neighbours before
        degree = _both_ways(now).groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if degree <= limit:
            then = materialize(_small_star(_large_star(now, None), None), "edges")
        else:
            stars = materialize(_large_star(now, limit), "stars")
            then = materialize(_small_star(stars, limit), "edges")
            release(stars)
        last, mark = mark, _mark(then)
        release(now)
        now = then
        if mark == last:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it is hot; hot keys are at most rows / this, and never more than ``MOST_HOT``.
HOT_ROWS = 2_000
MOST_HOT = 50_000


def hot_limit(rows: int) -> int:
    """Rows of a key beyond which it is hot, so that of ``rows`` no more than ``MOST_HOT`` keys are."""
    return max(HOT_ROWS, rows // MOST_HOT)


def join_hot(rows: DataFrame, facts: DataFrame, key: str, limit: int, how: str = "inner") -> DataFrame:
    """``rows`` with the one row that ``facts`` has for their ``key``; inner or left.

    Rows of keys that more than ``limit`` rows have stay where they are and meet
    a broadcast of those keys' facts, which are bounded as ``hot_limit`` says;
    the rest goes by a shuffle, in which no key is large.  Null keys have no facts.
    """
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(key)
    hot = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    more = [c for c in facts.columns if c != key]
    columns = [*rows.columns, *more]
    met = rows.join(hot, key).select(columns)
    left = rows.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti")
    out = met.union(left.join(facts, key, how).select(columns))
    if how == "left":
        none = [F.lit(None).cast(t).alias(c) for c, t in facts.dtypes if c != key]
        out = out.union(rows.where(F.col(key).isNull()).select(*rows.columns, *none))
    return out

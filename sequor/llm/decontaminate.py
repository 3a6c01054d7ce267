"""Benchmark decontamination by size-partitioned MinHash containment search, in built-in functions only.

An item's signature is the ``n - ceil(n * t) + 1`` least hashes among its ``n``
shingles: a document that holds the share ``t`` of the shingles holds at least
one of those, so the search misses nothing.  Items are partitioned by size (its
power of two; items of fewer words than a shingle apart).  A partition has a
hash bound that all its signatures lie under, and a least size of document that
can contain an item of it.  A document looks its shingles up in the partitions
that it is large enough for, each under that partition's bound; as bounds nest,
one look-up under the greatest of them serves all.  A document that meets a
signature of such a partition is verified by exact containment of shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequor.operators.storage import materialize

#: Rows of signatures or candidates up to which they may be broadcast (at most 40 bytes each), and bytes of item shingles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SPACE), lambda w: w != "")


def _shingle_texts(w: str, size: int) -> Column:
    """Distinct shingles as texts; fewer words than ``size`` make one shingle, none make none."""
    return F.expr(
        f"case when size({w}) = 0 then array() when size({w}) < {size} then array(array_join({w}, ' '))"
        f" else array_distinct(transform(sequence(1, size({w}) - {size - 1}), i -> array_join(slice({w}, i, {size}), ' '))) end"
    ).cast("array<string>")


def _shingle_hashes(w: str, size: int) -> Column:
    parts = ", ".join(f"{w}[i + {j}]" for j in range(size))
    return F.expr(
        f"case when size({w}) = 0 then array() when size({w}) < {size} then array(xxhash64({w}))"
        f" else transform(sequence(0, size({w}) - {size}), i -> xxhash64({parts})) end"
    ).cast("array<bigint>")


def signatures(items: DataFrame, percent: int, size: int) -> DataFrame:
    """``(item_id, part, n, h)``: the least hashes of each item; part is its size's power of two, -1 for fewer words than ``size``."""
    one = items.select("item_id", _words(F.col("text")).alias("w")).withColumn("hs", F.array_sort(F.array_distinct(_shingle_hashes("w", size))))
    n = F.size("hs")
    keep = F.expr(f"size(hs) - cast(ceil(size(hs) * {percent} / 100) as int) + 1")
    part = F.when(F.size("w") < size, -1).otherwise(F.floor(F.log2(n)).cast("int"))
    return one.where(n > 0).select("item_id", part.alias("part"), n.alias("n"), F.explode(F.slice("hs", F.lit(1), keep)).alias("h"))


def bounds(sign: DataFrame, percent: int) -> list[tuple[int, int, int]]:
    """``(part, least shingles of a document, greatest hash)`` of each partition; at most one for each bit of a size."""
    rows = sign.groupBy("part").agg(F.min("n").alias("n"), F.max("h").alias("h")).collect()
    return sorted((r.part, -(-r.n * percent // 100), r.h) for r in rows)


def _limit(parts: list[tuple[int, int, int]], size: int) -> Column:
    """The greatest hash that a document looks up, by its number of ``words``; null for none."""
    none = F.lit(None).cast("long")
    short = [h for part, _, h in parts if part < 0]
    fits = [F.when(F.col("words") - (size - 1) >= least, F.lit(h)).otherwise(none) for part, least, h in parts if part >= 0]
    return F.when(F.col("words") < size, F.lit(short[0]) if short else none).otherwise(F.greatest(*fits, none) if len(fits) > 1 else (fits or [none])[0])


def containments(docs: DataFrame, items: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, doc_key, item_id, n_common, n_item)`` for each document and item it contains.

    An item is contained when at least ``percent`` of its distinct shingles
    (``size`` words, letters A-Z lower-cased) are in the document.  An item of
    fewer words is one shingle and is contained only in a document that has just
    those words.  Empty or null items and texts match nothing.  ``doc_key`` is a
    hash of id and text: rows that repeat both give one result, ids shared by
    different texts keep theirs apart.  Repeated items each give their hit once;
    items that share an id count as far as each is contained.  Very long texts
    are searched whole.  Other columns of the tables are not read.  Empty tables
    give no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    # an item is its id and text, so that ids may repeat
    items = items.select(F.struct("item_id", F.xxhash64("text").alias("key")).alias("item_id"), "text").dropDuplicates(["item_id"])
    sign = materialize(signatures(items, percent, size), "signatures")
    parts, n_sign = bounds(sign, percent), sign.count()
    words = docs.select("doc_key", "doc_id", _words(F.col("text")).alias("w"))
    # the greatest bound of all is a constant; a document's own limit is cheaper to apply to rows than within arrays
    most = max((h for _, _, h in parts), default=-(1 << 63))
    low = F.filter(_shingle_hashes("w", size), lambda h: h <= most)
    low = words.select("doc_key", "doc_id", F.size("w").alias("words"), F.explode(low).alias("h")).where(F.col("h") <= _limit(parts, size))
    probe = sign.select("h").distinct()
    hits = low.join(F.broadcast(probe) if n_sign <= BROADCAST_ROWS else probe, "h")
    # a document meets few signatures, so what is shuffled here is small
    fits = F.when(F.col("part") < 0, F.col("words") < size).otherwise(F.col("words") - (size - 1) >= F.ceil(F.col("n") * percent / 100))
    met = hits.distinct().join(F.broadcast(sign) if n_sign <= BROADCAST_ROWS else sign, "h").where(fits)
    met = materialize(met.select(F.col("doc_key").alias("k"), F.col("doc_id").alias("id"), "item_id").distinct(), "candidates")
    same = (F.col("doc_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))
    found, few = met.select("k", "id").distinct(), met.count() <= BROADCAST_ROWS
    found = F.broadcast(found) if few else found.hint("merge")
    held = docs.join(found, same, "left_semi").select("doc_key", "doc_id", _words(F.col("text")).alias("w"))
    held = held.select("doc_key", "doc_id", _shingle_texts("w", size).alias("ds"))
    asked = items.select("item_id", _words(F.col("text")).alias("w")).select("item_id", _shingle_texts("w", size).alias("qs"))
    room = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    both = held.join(F.broadcast(met) if few else met.hint("merge"), same).join(F.broadcast(asked) if room * size <= BROADCAST_BYTES else asked.hint("merge"), "item_id")
    out = both.select("doc_id", "doc_key", F.col("item_id.item_id").alias("item_id"), F.size(F.array_intersect("qs", "ds")).cast("long").alias("n_common"), F.size("qs").cast("long").alias("n_item"))
    return out.where(F.col("n_common") * 100 >= F.col("n_item") * percent).distinct()

"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's documents lie end to end, in seeded order, in shards of bounded
rows; a shard is cut into blocks of equal words (its last may be shorter).  A
small source has smaller blocks of its own.  The highest quotients ``target / (2
a + 1)`` hand whole blocks to the sources of equal blocks, and again to each
source's shards, so every shard has an integer quota.  A quota of ``q``
over ``n`` blocks takes all blocks ``q // n`` times and, at even seeded spacing,
``q % n`` of them once more; as quotas are at most ``2 n``, no word is taken more
than twice.  A document takes the words that selected blocks share with it.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequor.operators.storage import materialize

#: Words of a block; smaller in a source that would have fewer than ``MIN_BLOCKS``.
BLOCK_WORDS = 2048
MIN_BLOCKS = 2048
#: Rows of a shard of a source; more where a source would have more than ``MAX_SHARDS``, as one task deals their seats.
SHARD_ROWS = 1000
MAX_SHARDS = 1 << 16
#: The driver holds a row for each source; more sources than this are an error.
MAX_SOURCES = 1_000_000
_WORD = r"[^\x20\x09-\x0D]+"


def fill_targets(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[Fraction]:
    """``share`` of all sizes by weight; what passes ``most`` times a size is shared again among the rest."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] >= most * sizes[i] * total}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def sainte_lague(votes: list, caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients ``votes / (2 a + 1)``, at most ``caps``; ties go to the first.

    The quotient at which nearly all seats are given is found by bisection, and
    only the last seats, at most a few for each party, are dealt one by one.
    """
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    given = lambda q: [0 if v <= 0 else min(c, int((v / q + 1) // 2)) for v, c in zip(votes, caps)]
    if seats <= 0:
        return [0] * len(votes)
    votes = [Fraction(v) for v in votes]
    low, high = Fraction(0), max(votes) * 2
    while sum(given(high)) > seats:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if sum(given(mid)) > seats:
            low = mid
        else:
            high = mid
        high, low = Fraction(high).limit_denominator(1 << 80), Fraction(low).limit_denominator(1 << 80)
        if sum(given(high)) >= seats - len(votes) and sum(given(high)) <= seats:
            break
    out = given(high)
    heap = [(-v / (2 * a + 1), i) for i, (v, a, c) in enumerate(zip(votes, out, caps)) if a < c and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def source_quotas(sizes: list[int], targets: list, blocks: list[int], shards: list[int], most: int) -> list[int]:
    """Blocks for each source; those of equal blocks share the seats of their targets."""
    out, groups = [0] * len(sizes), {}
    for i, block in enumerate(blocks):
        groups.setdefault(block, []).append(i)
    for block, same in groups.items():
        caps = [most * (-(-sizes[i] // block) + shards[i]) for i in same]
        seats = sainte_lague([targets[i] for i in same], caps, round(sum(targets[i] for i in same) / block))
        for i, q in zip(same, seats):
            out[i] = q
    return out


def _shard_quotas(most: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        words, block = [int(x) for x in group["words"]], int(group["block"].iloc[0])
        blocks = [-(-w // block) for w in words]
        quota = sainte_lague(words, [most * b for b in blocks], int(group["quota"].iloc[0]))
        return pd.DataFrame({"src": group["src"], "shard": group["shard"], "blocks": blocks, "quota": quota})

    return run


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of a row by id and text, as :func:`mix` returns it."""
    return F.xxhash64(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit(""))))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: int = 20240501,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, row_key, size, source, source_size, target, taken, times, spans)`` for every row.

    ``taken`` words are ``times`` whole repeats and once the ``spans(start, end)``
    of words from 0, end exclusive, that selected blocks share with the row; a
    row that they cover is one repeat more.  ``size`` counts words (null or empty text: 0).  Sources by code point, null
    last, weigh ``weights`` in turn and share ``share`` of all sizes, none above
    ``most`` times its own.  ``taken`` is at most ``most`` times ``size`` and each
    source's sum is within a block for each of its shards of its target.  The
    same rows give the same result in any order; repeated rows share a place by
    equal sizes.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"),
        row_key(id_col, text_col).alias("row_key"),
    )
    base = materialize(base.withColumn("at", F.xxhash64(F.lit(seed), "row_key")).withColumn("src", F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit("")))), "mix")
    totals = base.groupBy("source", "src").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"]) for r in totals]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    blocks = [max(1, min(block_words, s // MIN_BLOCKS)) for s in sizes]
    shards = [min(MAX_SHARDS, -(-r["docs"] // SHARD_ROWS)) for r in totals]
    quotas = source_quotas(sizes, targets, blocks, shards, most)
    rows = [(r["src"], s, float(t), q, n, b) for r, s, t, q, n, b in zip(totals, sizes, targets, quotas, shards, blocks)]
    per_source = spark.createDataFrame(rows, "src string, source_size long, target double, quota long, shards int, block long")
    placed = base.join(F.broadcast(per_source), "src").withColumn("shard", F.pmod(F.xxhash64("at", F.lit(1)), "shards"))
    held = placed.groupBy("src", "shard", "quota", "block").agg(F.sum("size").alias("words"))
    quota = held.groupBy("src").applyInPandas(_shard_quotas(most), "src string, shard long, blocks long, quota long")
    order = Window.partitionBy("src", "shard").orderBy("at", "doc_id", "size")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    laid = placed.drop("quota").withColumn("end", end).join(quota.withColumnRenamed("quota", "q"), ["src", "shard"])
    # words of selected blocks before x: floor((j + s) r / n) steps up at the selected blocks j, evenly from a seeded start
    start = F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), F.greatest("blocks", F.lit(1)))
    laid = laid.withColumns({"s": start, "r": F.expr("if(blocks > 0, q % blocks, 0)"), "whole": F.expr("if(blocks > 0, q div blocks, 0)"), "n": F.expr("greatest(blocks, 1)")})

    def before(x: str) -> str:
        j = f"(({x}) div block)"
        up = lambda k: f"((({k}) + s) * r div n)"
        return f"(block * ({up(j)} - {up('0')}) + (({x}) % block) * ({up(j + ' + 1')} - {up(j)}))"

    laid = laid.withColumn("part", F.expr(f"{before('end')} - {before('end - size')}"))
    chosen = "filter(sequence((end - size) div block, (end - 1) div block), j -> ((j + 1 + s) * r div n) > ((j + s) * r div n))"
    cut = "struct(cast(greatest(j * block - (end - size), 0) as int) as start, cast(least((j + 1) * block - (end - size), size) as int) as end)"
    laid = laid.withColumns({
        "taken": F.expr("cast(whole * size + part as long)"),
        "times": F.expr("cast(if(size > 0, whole + part div size, 0) as int)"),
        "spans": F.expr(f"if(part > 0 and part < size, transform({chosen}, j -> {cut}), null)"),
    })
    return laid.select("doc_id", "row_key", "size", "source", "source_size", "target", "taken", "times", "spans")

"""Near chains met through all their signature hashes, however often one occurs.

Classes of equal chains lie in blocks of like length, and couples of blocks are
dealt out.  A task holds two blocks and yields couples as it finds them, so its
memory is bounded; its work grows with the product of their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.functions import sequences as S
from sequor.operators.components import connected_components
from sequor.operators.storage import materialize, release, tasks

LEAST_SHARED = 5
#: Width of a band of lengths: chains that may be alike (90 %) lie in one band or in neighbours.
BAND = log(1 / 0.89)
#: Classes of a block: bands are cut in up to four of the lesser number, and in more only beyond the greater.
BLOCK_ROWS = (5_000, 50_000)
#: Cells, meetings and profiles that are held at once.
CELLS = 1 << 21
MEETINGS = 1 << 22
PROFILES = 1 << 16
#: Couples that one task compares letter by letter.
COMPARED_ROWS = 20_000


def blocks(classes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``(k, i, j, up, side, id, n0, ..., hashes, profile)``: each class once for every couple of blocks that has its own.

    ``up`` couples a block of band ``k`` with one of the band above.
    """
    sizes = [F.length(f).alias(f"n{k}") for k, f in enumerate(fields)]
    marks = classes.select("id", *sizes, S.signature(fields[0]).alias("hashes"), S.profile(fields[0]).alias("profile"))
    marks = materialize(marks.where(F.size("hashes") >= LEAST_SHARED).withColumn("k", F.floor(F.log("n0") / BAND).cast("int")), "marks")
    least, most = BLOCK_ROWS
    cuts = marks.groupBy("k").agg(F.greatest(F.least(F.lit(4), F.ceil(F.count("*") / least)), F.ceil(F.count("*") / most)).cast("int").alias("c"))
    # a band for each ninth of growth, so cuts are few
    cuts = F.broadcast(materialize(cuts, "cuts"))
    own = marks.join(cuts, "k").withColumn("i", F.pmod(F.xxhash64("id"), "c").cast("int"))
    own = own.join(cuts.select((F.col("k") - 1).alias("k"), F.col("c").alias("above")), "k", "left").join(cuts.select((F.col("k") + 1).alias("k"), F.col("c").alias("below")), "k", "left")
    each = F.expr("""concat(transform(sequence(0, c - 1), j -> struct(k, least(i, j) as i, greatest(i, j) as j, false as up, i > j as side)),
        if(above is null, array(), transform(sequence(0, above - 1), j -> struct(k, i, j, true as up, false as side))),
        if(below is null, array(), transform(sequence(0, below - 1), j -> struct(k - 1 as k, j as i, i as j, true as up, true as side))))""")
    return own.select(F.explode(each).alias("b"), "id", *[f"n{k}" for k in range(len(fields))], "hashes", "profile").select("b.*", *marks.columns[:-1])


def _budget(longer: np.ndarray, level: int) -> np.ndarray:
    """Edits that leave ``level`` percent, and the hair by which identities are rounded."""
    return np.floor(longer * (100 - level + 1e-4) / 100 + 1e-9)


def meetings(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], rows_x: int, rows_y: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Twos of rows that share hashes enough, from ``(hash, row)`` of both sides; those of ``x`` are sorted by row."""
    order = np.argsort(y[0], kind="stable")
    held, row = y[0][order], y[1][order]
    low = np.searchsorted(held, x[0], "left")
    met = np.searchsorted(held, x[0], "right") - low
    ends = np.searchsorted(x[1], np.arange(rows_x + 1))
    total = np.concatenate([[0], np.cumsum(met)])[ends]
    at = 0
    while at < rows_x:
        # rows whose cells and meetings are held at once, one at least
        to = max(at + 1, min(at + max(1, CELLS // rows_y), int(np.searchsorted(total, total[at] + MEETINGS, "right")) - 1))
        part = slice(ends[at], ends[to])
        n = met[part]
        place = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cells = np.repeat((x[1][part] - at) * rows_y, n) + row[place]
        found = np.flatnonzero(np.bincount(cells, minlength=(to - at) * rows_y) >= LEAST_SHARED)
        yield found // rows_y + at, found % rows_y
        at = to


def meet(t: pa.Table, level: int, sparse: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a couple of blocks that may have the level of identity and are not linked yet.

    ``sparse`` gives of each row's partners the first and the one of the most
    like profile alone.
    """
    side, own = t["side"].to_numpy(), not t["up"][0].as_py() and t["i"][0] == t["j"][0]
    lengths = [t[c].to_numpy() for c in t.column_names if c[0] == "n" and c[1:].isdigit()]
    linked = t["component"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    profile = np.frombuffer(b"".join(t["profile"].to_pylist()), np.uint8).reshape(-1, S.PROFILE_SIZE)
    hashes = t["hashes"].combine_chunks()
    flat, owner = hashes.flatten().to_numpy(), np.repeat(np.arange(len(t)), hashes.value_lengths().to_numpy())
    left = np.arange(len(t)) if own else np.flatnonzero(~side)
    right = left if own else np.flatnonzero(side)
    if not len(left) or not len(right):
        return
    place = np.zeros(len(t), dtype=np.int64)
    sides = []
    for rows in (left, right):
        place[rows] = np.arange(len(rows))
        there = np.ones(len(flat), dtype=bool) if own else side[owner] == side[rows[0]]
        sides.append((flat[there], place[owner[there]]))
    for a, b in meetings(*sides, len(left), len(right)):
        a, b = left[a], right[b]
        ok = (linked[a] != linked[b]) & ((b < a) | (not own))
        a, b = a[ok], b[ok]
        edits = None
        for n in lengths:
            longer, shorter = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
            most = _budget(longer, level)
            ok = (100 * shorter / longer + 1e-9 >= 90) & (longer - shorter <= most)
            edits = most if edits is None else edits
            a, b, edits = a[ok], b[ok], edits[ok]
        apart = [np.abs(profile[a[i : i + PROFILES]].astype(np.int16) - profile[b[i : i + PROFILES]]).sum(1) for i in range(0, len(a), PROFILES)]
        apart = np.concatenate(apart) if apart else np.zeros(0)
        ok = apart <= 2 * S.PROFILE_GRAM * edits
        a, b, apart = a[ok], b[ok], apart[ok]
        if sparse and len(a):
            order = np.lexsort((b, apart, a))
            first, best = np.unique(a, return_index=True)[1], order[np.unique(a[order], return_index=True)[1]]
            kept = np.union1d(first, best)
            a, b = a[kept], b[kept]
        yield a, b


def _couples(level: int, sparse: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("id")
        ids = t["id"].combine_chunks()
        for a, b in meet(t, level, sparse):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

    return run


def _edges(classes: DataFrame, dealt: DataFrame, linked: DataFrame | None, fields: tuple[str, ...], level: int) -> DataFrame:
    """``(a, b)`` at the level between classes that ``linked(node, component)`` leaves apart; of all, without it, only some that link most."""
    spark, kind = classes.sparkSession, dict(classes.dtypes)["id"]
    rows = dealt.withColumn("component", F.col("id")) if linked is None else dealt.join(linked, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    n = tasks(spark, dealt.select("k", "i", "j", "up").distinct().count(), 2)
    found = rows.repartition(n, "k", "i", "j", "up").groupBy("k", "i", "j", "up").applyInArrow(_couples(level, linked is None), f"a {kind}, b {kind}")
    found = materialize(found, "couples")
    n = tasks(spark, found.count(), COMPARED_ROWS)
    chains = lambda c, p: classes.select(F.col("id").alias(c), *[F.col(f).alias(f"{f}_{p}") for f in fields])
    both = found.repartition(n, "a").join(chains("a", "a"), "a").repartition(n, "b").join(chains("b", "b"), "b").repartition(n, "a", "b")
    for f in fields[1:]:
        both = both.where(F.size(F.array_intersect(S.signature(f"{f}_a"), S.signature(f"{f}_b"))) >= LEAST_SHARED)
    for f in fields:
        both = both.where(S.edit_identity(f"{f}_a", f"{f}_b") + 1e-9 >= level)
    out = materialize(both.select("a", "b"), "edges")
    release(found)
    return out


def linked_classes(classes: DataFrame, fields: tuple[str, ...], level: int) -> DataFrame:
    """``(node, component)`` of classes ``(id, *fields)`` linked by any couple that shares 5 hashes on each field and has the level of identity on all.

    A few couples of each class are compared first; all others only where these
    have left two classes apart, so a group of near copies is not compared in all its couples.
    """
    dealt = materialize(blocks(classes, fields), "blocks")
    some = _edges(classes, dealt, None, fields, level)
    first = materialize(connected_components(some, "a", "b"), "linked")
    rest = _edges(classes, dealt, first, fields, level)
    release(dealt)
    if rest.isEmpty():
        return first
    return connected_components(some.union(rest), "a", "b")

"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Points are distinct texts with the bytes of all their rows and the metadata of
the least of them, so rows of equal texts share a shard; a text whose rows pass
``WHOLE`` of a shard's bytes is dealt as several points of ``PIECE`` each.  A node
that must become ``L`` leaves splits at the weighted quantile ``floor(L / 2) / L``
of its widest dimension, until every leaf is near the target bytes.  Equal values
are split further by hashes of the text and of its piece.

The driver holds one row for each node and for each bin of a histogram, of which
a round has at most ``MOST_BINS``.  Quantiles are exact to ``TOLERANCE`` of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sequor.operators.storage import materialize

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Bins of a node in a histogram round, and of all nodes of a round.
BINS = 512
MOST_BINS = 1 << 20
#: Share of a shard's bytes up to which the rows of one text stay whole, and that of a piece of more.
WHOLE = 0.25
PIECE = 1 / 32
#: Share of a leaf's bytes that a cut may miss its quantile by, unless one row is larger.
TOLERANCE = 0.002
#: The driver holds a row for each name of a source or language; more are an error.
MAX_NAMES = 1_000_000
#: Rows that number themselves in one task.
SLOT_ROWS = 50_000
_DIMS = ("source", "lang", "bytes")
_TIES = ("t_hash", "t_piece")
_TOP = 1 << 62


@dataclass
class _Node:
    """A node of the tree: leaves it must become, its first shard, and once split its cut."""

    leaves: int
    shard: int
    dim: str = ""
    at: list[int] = field(default_factory=list)


def _ranks(docs: DataFrame, col: str, out: str) -> DataFrame:
    """``(col, out)``: the place of each distinct name in the order of code points, null first."""
    names = [r[0] for r in docs.select(F.col(col).cast("string")).distinct().limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names in {col}")
    names.sort(key=lambda x: (x is not None, x or ""))
    return docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], f"{out}_name string, {out} long")


def points(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """Rows with their size, text key and metadata; ``t_row`` orders the rows of a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("t_hash"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(source_col), F.col(lang_col)), 2).alias("t_row"),
    )
    for col, out, names in (("source", "d_source", _ranks(docs, source_col, "d_source")), ("lang", "d_lang", _ranks(docs, lang_col, "d_lang"))):
        rows = rows.join(F.broadcast(names), F.col(col).eqNullSafe(F.col(f"{out}_name"))).drop(col, f"{out}_name")
    return rows


def groups(rows: DataFrame, leaf: float) -> DataFrame:
    """One point for each text, or several for one whose rows pass ``WHOLE`` of a leaf."""
    least = F.min(F.struct("d_source", "d_lang")).alias("m")
    whole = rows.groupBy("t_hash").agg(F.sum("size").alias("w"), F.max("size").alias("d_bytes"), least)
    pieces = F.when(F.col("w") > WHOLE * leaf, F.ceil(F.col("w") / F.greatest(F.lit(PIECE * leaf), F.col("d_bytes")))).otherwise(1)
    return whole.select("t_hash", pieces.cast("long").alias("pieces"), "m.d_source", "m.d_lang", "d_bytes")


def _placed(points: DataFrame, nodes: dict[int, _Node], spark) -> DataFrame:
    """Points one level further down: a broadcast join with the cuts of the level."""
    rows = [(k, n.dim, *(n.at + [None] * 3)[:3]) for k, n in nodes.items()]
    if not rows:
        return points
    cuts = spark.createDataFrame(rows, "node long, dim string, c0 long, c1 long, c2 long")
    value = F.when(F.col("dim") == "source", F.col("d_source")).when(F.col("dim") == "lang", F.col("d_lang")).otherwise(F.col("d_bytes"))
    chain = [value, *(F.col(t) for t in _TIES)]
    right = F.lit(False)
    for v, c in reversed(list(zip(chain, ("c0", "c1", "c2")))):
        right = F.when(F.col(c).isNull(), F.lit(True)).otherwise((v > F.col(c)) | ((v == F.col(c)) & right))
    joined = points.join(F.broadcast(cuts), "node", "left")
    # a key at the cut goes right, as does everything above it
    node = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + 1 + right.cast("long"))
    return joined.withColumn("node", node).drop("dim", "c0", "c1", "c2")


def _ranges(points: DataFrame) -> dict[int, dict]:
    """Per node: bytes, and the range of each dimension and tie-break."""
    cols = [f"d_{d}" for d in _DIMS]
    aggs = [F.sum("size").alias("w")] + [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    return {r["node"]: r.asDict() for r in points.groupBy("node").agg(*aggs).collect()}


def _cut(points: DataFrame, open_: dict[int, dict], spark) -> None:
    """Finds each open node's cut by histograms over ever narrower ranges, all nodes in one job a round."""
    while todo := {k: s for k, s in open_.items() if not s["done"]}:
        bins_ = max(16, min(BINS, MOST_BINS // len(todo)))
        for s in todo.values():
            s["step"] = max(1, -(-s["span"] // bins_))
        rows = [(k, s["level"], s["dim"], *(s["at"] + [None] * 2)[:2], s["lo"], s["step"]) for k, s in todo.items()]
        state = spark.createDataFrame(rows, "node long, level int, dim string, f0 long, f1 long, lo long, step long")
        value = F.when(F.col("dim") == "source", F.col("d_source")).when(F.col("dim") == "lang", F.col("d_lang")).otherwise(F.col("d_bytes"))
        chain = [value, *(F.col(t) for t in _TIES)]
        inside = F.lit(True)
        for i in range(2):
            inside &= (F.col("level") <= i) | (chain[i] == F.col(f"f{i}"))
        now = F.when(F.col("level") == 0, chain[0]).when(F.col("level") == 1, chain[1]).otherwise(chain[2])
        near = points.join(F.broadcast(state.withColumn("bins", F.lit(bins_))), "node").where(inside).withColumn("v", now)
        bin_ = F.expr("cast((v - lo) div step as long)")
        held = near.where((F.col("v") >= F.col("lo")) & (bin_ < F.col("bins"))).groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()
        bins: dict[int, list] = {}
        for r in held:
            bins.setdefault(r["node"], []).append((r["bin"], r["w"], r["n"], r["lo"], r["hi"]))
        for k, s in todo.items():
            _narrow(s, sorted(bins.get(k, [])))


def _narrow(s: dict, bins: list[tuple[int, int, int, int, int]]) -> None:
    """Goes on in the bin ``(number, bytes, points, least and greatest value)`` that the wanted bytes fall into."""
    below, found = s["below"], None
    for b in bins:
        if below + b[1] > s["want"]:
            found = b
            break
        below += b[1]
    if found is None:
        s["at"].append(s["lo"] + s["span"])
        s["done"] = True
        return
    _, w, n, least, most = found
    miss, over = s["want"] - below, below + w - s["want"]
    if n == 1 or min(miss, over) <= s["slack"] or (least == most and s["level"] == len(_TIES)):
        # cut before or after the bin, whichever is nearer
        s["at"].append(least if miss <= over else most + 1)
        s["done"] = True
    elif least < most:
        s["lo"], s["span"], s["below"] = least, most - least + 1, below
    else:
        s["at"].append(least)
        s["level"] += 1
        s["lo"], s["span"], s["below"] = 0, _TOP, below


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row; sizes of shards are near equal.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 16.  Give the
    number of shards, or the target bytes of one.  Rows of equal texts share a
    shard, unless they pass ``WHOLE`` of its bytes; then pieces of them do.  ``slot`` numbers a shard's
    rows from 0 without gaps, equal texts side by side within a numbering task.
    Nulls in any column sort first.  Repeated rows get slots of their own.  With
    fewer rows than shards some shards are empty; an empty table gives no rows.
    Columns of ``docs`` besides the four named are not read.
    """
    spark = docs.sparkSession
    rows = materialize(points(docs, id_col, text_col, source_col, lang_col), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_shards = n_shards or max(1, round(total / target_bytes))
    texts = materialize(groups(rows, total / n_shards), "texts")
    # at most n_shards / WHOLE texts have pieces
    cut = rows.join(F.broadcast(texts.where("pieces > 1").select("t_hash", "pieces")), "t_hash", "left")
    piece = F.when(F.col("pieces").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("t_row"), F.col("pieces")))
    rows = cut.withColumn("t_piece", piece).drop("pieces")
    sizes = rows.groupBy("t_hash", "t_piece").agg(F.sum("size").alias("size"))
    now = materialize(sizes.join(texts.drop("pieces"), "t_hash").withColumn("node", F.lit(0).cast("long")), "points")
    nodes = {0: _Node(n_shards, 0)}
    level, widest, depth = [0] if n_shards > 1 else [], {}, 0
    while level:
        stats, open_, below = _ranges(now), {}, []
        if stats and not widest:
            widest = {d: max(1, stats[0][f"hi_d_{d}"] - stats[0][f"lo_d_{d}"]) for d in _DIMS}
        for k in level:
            n, s = nodes[k], stats.get(k)
            left = n.leaves // 2
            nodes[2 * k + 1], nodes[2 * k + 2] = _Node(left, n.shard), _Node(n.leaves - left, n.shard + left)
            below += [c for c in (2 * k + 1, 2 * k + 2) if nodes[c].leaves > 1]
            if s is None:
                n.dim, n.at = "bytes", [0]
                continue
            n.dim = max(_DIMS, key=lambda d: (s[f"hi_d_{d}"] - s[f"lo_d_{d}"]) / widest[d])
            lo, hi = s[f"lo_d_{n.dim}"], s[f"hi_d_{n.dim}"]
            open_[k] = {"dim": n.dim, "level": 0, "at": n.at, "lo": lo, "span": hi - lo + 1, "below": 0, "want": s["w"] * left // n.leaves, "slack": TOLERANCE * s["w"] / n.leaves, "done": False}
        _cut(now, open_, spark)
        now = _placed(now, {k: nodes[k] for k in level}, spark)
        level = below
        depth += 1
        if depth % 4 == 0:
            now = materialize(now, "points")
    shard = spark.createDataFrame([(k, n.shard) for k, n in nodes.items() if n.leaves == 1], "node long, shard int")
    where = now.join(F.broadcast(shard), "node").select("t_hash", "t_piece", "shard")
    return _numbered(rows.join(where, ["t_hash", "t_piece"]).select("doc_id", "size", "text_crc32", "shard", "t_hash", "t_row"))


def _numbered(placed: DataFrame) -> DataFrame:
    """Slots without gaps: rows number themselves within slices of a shard, slices get offsets."""
    placed = materialize(placed, "placed")
    counts = placed.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / SLOT_ROWS).alias("slices"))
    # few rows: one for each shard
    sliced = placed.join(F.broadcast(counts), "shard").withColumn("slice", F.pmod(F.xxhash64("t_row", "t_hash"), "slices")).drop("slices")
    sizes = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("t_hash", "t_row"))
    return sliced.withColumn("own", own).join(offsets, ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("own") - 1).cast("long").alias("slot"))

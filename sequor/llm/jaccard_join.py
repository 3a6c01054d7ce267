"""N-gram Jaccard join by T-occurrence search.

Documents link when the Jaccard similarity of their word-shingle sets reaches a
threshold.  Shingles are 64-bit keyed hashes of their words; on those sets the
join is exact, and two different shingles share a hash with the odds of 64 bits
(some 3 in 10,000 that this happens at all among 100 million shingles):

1.  A document's class is its normalised word sequence; copies collapse there.
2.  A shingle found in one class alone cannot be shared.  Shingles travel once,
    as sorted packed blocks, to hash buckets that count classes; a class whose
    unshared shingles already exceed what the threshold allows is out.
3.  The rest are searched.  To reach ``T`` common shingles two sets must meet in
    the ``n - T + 1`` rarest of one of them: the short inverted lists.  Lists
    that meet split the classes into neighbourhoods that cannot link across.
4.  Each neighbourhood is searched by DivideSkip: merge the short lists, keep
    those counted ``T - L`` times, probe the ``L`` long lists by binary search.
    A candidate already in the query's component is skipped, so a group of
    near copies costs links in proportion to its size, not to its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequor.llm.hashing import shingle_set, trim, words
from sequor.operators.components import connected_components
from sequor.operators.skew import hot_limit, join_hot
from sequor.operators.storage import materialize, release, tasks

#: Shingles that one bucket task holds; shingles and classes that one block of a neighbourhood holds.
BUCKET_SHINGLES = 1_000_000
BLOCK_SHINGLES = 1_500_000
BLOCK_CLASSES = 256
#: Classes of a block that stand for it when blocks are tied.
HUBS = 8
#: Classes left to search up to which their ids may be broadcast (24 bytes each); beyond, texts are joined by a shuffle.
BROADCAST_CLASSES = 2_000_000
_SHARED = np.uint32(0xFFFFFFFF)
_NARROW = np.uint32(0xFFFF)


def _unshared_allowed(n, percent: int):
    """Most shingles of a set of ``n`` that may be missing in a partner: n - ceil(n * percent / 100)."""
    return n - -(-n * percent // 100)


def _class(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(hashes.tobytes()).digest()[:8], "little", signed=True)


def _meta(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, half = [], [], []
            for w in words(batch.column(2), lower=True):
                for i in range(len(w)):
                    h = w.of(i)
                    s = shingle_set(h, size)
                    cls.append(_class(h))
                    n.append(len(s))
                    half.append(int(np.count_nonzero((s & np.uint64(1)) == 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(half, pa.int64())], names=["doc_id", "text_key", "cls", "n", "half"])

    return run


def pack(hashes: np.ndarray, owners: np.ndarray, table: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their differences, with each one's owner as an index of the owners that they have."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    gaps = np.diff(h, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    index = owners[order]
    own = index != _SHARED
    here, at = np.unique(index[own], return_inverse=True)
    index[own], table = at.astype(np.uint32), table[here]
    wide = len(table) >= _NARROW
    if not wide:
        index = np.where(index == _SHARED, _NARROW, index).astype(np.uint16)
    head = np.array([len(h), len(table), wide], dtype=np.int64)
    return head.tobytes() + planes.tobytes() + index.tobytes() + table.astype(np.int64).tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, wide = np.frombuffer(blob, np.int64, 3)
    planes = np.frombuffer(blob, np.uint8, 8 * n, 24).reshape(8, n)
    hashes = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    kind = np.uint32 if wide else np.uint16
    owners = np.frombuffer(blob, kind, n, 24 + 8 * n).astype(np.uint32)
    if not wide:
        owners = np.where(owners == _NARROW, _SHARED, owners)
    return hashes, owners, np.frombuffer(blob, np.int64, m, 24 + 8 * n + n * np.dtype(kind).itemsize)


def _ship(size: int, buckets: int, flush: int):
    """Half of all shingles (the even ones), once for each class of a task, to their buckets."""

    def emit(sets: list[np.ndarray], ids: list[int]) -> Iterator[pd.DataFrame]:
        lens = np.array([len(s) for s in sets])
        # 48 bits are enough here: a clash only keeps a class in the search
        hashes, owner = np.concatenate(sets) >> np.uint64(16), np.repeat(np.arange(len(sets), dtype=np.uint32), lens)
        table = np.array(ids, dtype=np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = hashes[1:] != hashes[:-1]
        repeated = np.zeros(len(hashes), dtype=bool)
        repeated[1:] = ~first[1:]
        repeated[:-1] |= ~first[1:]
        counts = np.bincount(owner[repeated], minlength=len(table))
        owner = np.where(repeated, _SHARED, owner)[first]
        hashes = hashes[first]
        bucket = ((hashes >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        out = [(int(b), pack(hashes[i:j], owner[i:j], table)) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
        own = np.flatnonzero(counts)
        if len(own):
            head = np.array([0, len(own)], dtype=np.int64)
            out.append((-1 - int(hashes[0] % np.uint64(buckets)), head.tobytes() + table[own].tobytes() + counts[own].astype(np.int64).tobytes()))
        yield pd.DataFrame(out, columns=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ids, seen, held = [], [], set(), 0
        for batch in batches:
            for w in words(batch.column(0), lower=True):
                for i in range(len(w)):
                    h = w.of(i)
                    if not len(h) or (c := _class(h)) in seen:
                        continue
                    seen.add(c)
                    s = shingle_set(h, size)
                    s = s[(s & np.uint64(1)) == 0]
                    if not len(s):
                        continue
                    sets.append(s)
                    ids.append(c)
                    held += len(s)
                    if held >= flush:
                        for out in emit(sets, ids):
                            yield pa.RecordBatch.from_pandas(out, schema=_SHIP, preserve_index=False)
                        sets, ids, seen, held = [], [], set(), 0
        if sets:
            for out in emit(sets, ids):
                yield pa.RecordBatch.from_pandas(out, schema=_SHIP, preserve_index=False)
        del sets, ids
        trim()

    return run


_SHIP = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])


def _parts(cls: np.ndarray, n: np.ndarray, parts: int) -> pd.DataFrame:
    """Counts by class, packed by the part of the classes that they belong to."""
    part = cls.view(np.uint64) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part, cls, n = part[order], cls[order], n[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    rows = [(int(part[i]), cls[i:j].tobytes() + n[i:j].astype(np.int64).tobytes()) for i, j in zip(cut, np.append(cut[1:], len(part)))]
    return pd.DataFrame(rows, columns=["part", "counts"])


def _count_shared(parts: int):
    """For each class of a bucket, the number of its shingles that another class has too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:
            cls, n = [], []
            for blob in group["blob"]:
                m = int(np.frombuffer(blob, np.int64, 2)[1])
                cls.append(np.frombuffer(blob, np.int64, m, 16))
                n.append(np.frombuffer(blob, np.int64, m, 16 + 8 * m))
            return _parts(np.concatenate(cls), np.concatenate(n), parts)
        blobs = [unpack(b) for b in group["blob"]]
        hashes = np.concatenate([p[0] for p in blobs])
        free = np.concatenate([p[1] == _SHARED for p in blobs])
        # a repeated shingle has no owner here; its classes were counted where it was packed
        cls = np.concatenate([np.append(p[2], 0)[np.where(p[1] == _SHARED, len(p[2]), p[1])] for p in blobs])
        del blobs
        order = np.argsort(hashes, kind="stable")
        hashes, free, cls = hashes[order], free[order], cls[order]
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        run_ = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(hashes))))
        shared = np.logical_or.reduceat(free, start)
        differs = np.zeros(len(hashes), dtype=bool)
        differs[1:] = (run_[1:] == run_[:-1]) & (cls[1:] != cls[:-1])
        shared |= np.logical_or.reduceat(differs, start)
        ids, n = np.unique(cls[shared[run_] & ~free], return_counts=True)
        del hashes, free, cls, order, run_
        trim()
        return _parts(ids, n, parts)

    return run


def _sum_shared(group: pd.DataFrame) -> pd.DataFrame:
    """``(cls, shared)``: the sums over all buckets, one row for a class."""
    cls = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16) for b in group["counts"]])
    n = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in group["counts"]])
    ids, at = np.unique(cls, return_inverse=True)
    return pd.DataFrame({"cls": ids, "shared": np.bincount(at, weights=n).astype(np.int64)})


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_numpy()
            cls, sets = [], []
            for w in words(batch.column(0), lower=True):
                for i in range(len(w)):
                    h = w.of(i)
                    if _class(h) == want[w.first_row + i]:
                        cls.append(want[w.first_row + i])
                        sets.append(shingle_set(h, size).view(np.int64))
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))], names=["cls", "shingles"])

    return run


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (nxt := self.up[r] != r).any():
            r = np.where(nxt, self.up[r], r)
        self.up[at] = r
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.roots(np.array([a, b]))
        self.up[max(a, b)] = min(a, b)


def divide_skip(sets: list[np.ndarray], percent: int, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span every component of the similarity graph over ``sets`` (sorted arrays).

    With ``queries`` (a mask), only links with at least one query are searched.
    Short lists are merged as sorted runs; ``L`` follows
    ``T / (mu * log2(longest) + 1)``.
    """
    n = np.array([len(s) for s in sets])
    token = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), n)
    order = np.argsort(token, kind="stable")
    ranked, lists = token[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
    length = np.diff(np.append(start, len(ranked)))
    which = np.empty(len(token), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(start)), length)
    at = np.concatenate([[0], np.cumsum(n)])
    forest, links = Forest(len(sets)), []
    for x in range(len(sets)):
        if not n[x] or (queries is not None and not queries[x]):
            continue
        mine = which[at[x] : at[x + 1]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        floor = -(-percent * int(n[x]) // 100)
        longest = int(length[mine[-1]])
        apart = min(int(floor / (0.01 * np.log2(longest + 1) + 1)), floor - 1)
        short, long = mine[: len(mine) - apart], mine[len(mine) - apart :]
        short = short[length[short] > 1]
        if not len(short):
            continue
        merged = np.sort(np.concatenate([lists[start[k] : start[k] + length[k]] for k in short]), kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[edge], np.diff(np.append(edge, len(merged)))
        need = -(-percent * (int(n[x]) + n[found]) // (100 + percent))
        able = (count >= need - apart) & (100 * np.minimum(n[x], n[found]) >= percent * np.maximum(n[x], n[found]))
        able &= (found < x) | ((found > x) & (queries is not None and ~queries[found] if queries is not None else False))
        found, count, need = found[able], count[able], need[able]
        if len(found):
            apart_now = forest.roots(found) != forest.roots(np.array([x]))[0]
            found, count, need = found[apart_now], count[apart_now], need[apart_now]
        for k in long[::-1] if len(found) else ():
            if length[k] > 1:
                here = lists[start[k] : start[k] + length[k]]
                spot = np.searchsorted(here, found)
                count = count + (here[np.minimum(spot, len(here) - 1)] == found)
        for y in found[count >= need]:
            root = forest.roots(np.array([x, y]))
            if root[0] != root[1]:
                links.append((x, int(y)))
                forest.join(x, int(y))
    return links


def _search(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("cls").sort_values("cls")
        cls = group["cls"].to_numpy()
        ask = group["ask"].to_numpy()
        links = divide_skip([np.asarray(s) for s in group["shingles"]], percent, None if ask.all() else ask)
        return pd.DataFrame({"a": cls[[i for i, _ in links]], "b": cls[[j for _, j in links]]}, columns=["a", "b"]).astype("int64")

    return run


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(s, cls): each set's n - T + 1 rarest shingles, less those that no other set has."""
    every = sets.select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = every.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = every.join(counts, "s").groupBy("cls").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("l"))
    room = F.expr(f"n - cast(ceil(n * {percent} / 100) as int) + 1 - (n - size(l))")
    return shared.withColumn("room", room).where("room > 0").select("cls", F.explode(F.expr("slice(l, 1, room)")).alias("p")).select("cls", F.col("p.s").alias("s"))


def link_classes(docs: DataFrame, meta: DataFrame, percent: int, size: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): links that span the components of the similarity graph over classes of ``docs(text_key, text)``."""
    spark = docs.sparkSession
    classes = materialize(meta.where("n > 0").groupBy("cls").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("half").alias("half")), "classes")
    total = classes.agg(F.sum("half")).first()[0] or 0
    buckets = max(8, -(-int(total) // BUCKET_SHINGLES))
    shipped = docs.select("text").mapInArrow(_ship(size, buckets, BUCKET_SHINGLES), "bucket long, blob binary")
    shared = shipped.groupBy("bucket").applyInPandas(_count_shared(buckets), "part long, counts binary")
    shared = shared.groupBy("part").applyInPandas(_sum_shared, "cls long, shared long")
    allowed = F.expr(f"n - cast(ceil(n * {percent} / 100) as long)")
    left = materialize(classes.join(shared, "cls", "left").where(F.col("half") - F.coalesce("shared", F.lit(0)) <= allowed).select("cls", "text_key", "n"), "left")
    n_left = left.count()
    wanted = left.select("cls", "text_key")
    # texts that copies of a class share are hot keys and stay where they are
    texts = docs.join(F.broadcast(wanted), "text_key") if n_left <= BROADCAST_CLASSES else join_hot(docs, wanted.dropDuplicates(["text_key"]), "text_key", hot_limit(n_left))
    sets = texts.select("text", "cls").mapInArrow(_sets(size), "cls long, shingles array<long>")
    sets = materialize(sets.dropDuplicates(["cls"]), "sets")

    postings = materialize(_postings(sets, percent), "postings")
    heads = postings.groupBy("s").agg(F.min("cls").alias("head"), F.count("*").alias("c")).where("c > 1")
    meet = postings.join(heads, "s").where("cls <> head").select("cls", "head").distinct()
    near = connected_components(meet, "cls", "head")
    near = materialize(near.join(left, near.node == left.cls).select("cls", F.col("component").alias("area"), "n"), "near")
    release(classes)
    sizes = near.groupBy("area").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count("*") / BLOCK_CLASSES)).alias("blocks"))
    placed = materialize(near.join(sizes, "area").select("cls", "n", "area", "blocks", F.pmod(F.xxhash64("cls"), "blocks").alias("block")), "placed")
    links = _searched(placed, sets, percent)
    if not placed.where("blocks > 1").limit(1).count():
        return links
    return _across_blocks(placed, sets, postings, links, percent, block)


def _searched(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within each (area, block) of ``placed``."""
    members = placed.select("area", "block", "cls").join(sets, "cls").select("area", "block", "cls", "shingles", F.lit(True).alias("ask"))
    members = members.repartition(tasks(placed.sparkSession, 0, 1), "area", "block")
    return materialize(members.groupBy("area", "block").applyInPandas(_search(percent), "a long, b long"), "links")


def _across_blocks(placed: DataFrame, sets: DataFrame, postings: DataFrame, links: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the blocks of an area that has several.

    Blocks are first tied level by level: the best-linked classes of each block
    are dealt to new blocks, far fewer each time, until one is left.  What then
    is outside its area's largest component is searched against those blocks
    that hold one of its rare shingles, as no link goes without one.
    """
    big = level = placed.where("blocks > 1")
    while level.limit(1).count():
        ends = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("deg"))
        best = Window.partitionBy("area", "block").orderBy(F.desc("deg"), "cls")
        hubs = level.join(ends, "cls").withColumn("r", F.row_number().over(best)).where(F.col("r") <= HUBS).select("area", "cls", "n")
        sizes = hubs.groupBy("area").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count("*") / BLOCK_CLASSES)).alias("want"))
        # at most half as many blocks as before, so that the levels end
        fewer = level.groupBy("area").agg(F.greatest(F.floor(F.max("blocks") / 2), F.lit(1)).alias("most"))
        sizes = sizes.join(fewer, "area").select("area", F.least("want", "most").alias("blocks"))
        dealt = materialize(hubs.join(sizes, "area").select("cls", "n", "area", "blocks", F.pmod(F.xxhash64("cls", "blocks"), "blocks").alias("block")), "hubs")
        links = links.union(_searched(dealt, sets, percent))
        level = dealt.where("blocks > 1")
    comp = connected_components(links, "a", "b")
    at = big.join(comp, F.col("cls") == F.col("node"), "left").select("area", "block", "cls", F.coalesce("component", "cls").alias("c"))
    at = materialize(at, "at")
    main = at.groupBy("area", "c").agg(F.count("*").alias("m")).groupBy("area").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
    rest = materialize(at.join(main, "area").where("c <> main").select("area", "cls"), "rest")
    if not rest.limit(1).count():
        return links
    holders = postings.join(at.select("cls", "area", "block"), "cls").select("s", "area", "block").distinct()
    asked = materialize(postings.join(rest, "cls").select("cls", "s").join(holders, "s").select("area", "block", "cls").distinct(), "asked")
    cells = asked.groupBy("area", "block").agg(F.ceil(F.count("*") / BLOCK_CLASSES).alias("parts"))
    part = F.pmod(F.xxhash64("cls", F.lit(7)), "parts")
    asked = asked.join(cells, ["area", "block"]).select("area", "block", part.alias("part"), "cls", F.lit(True).alias("ask"))
    held = at.join(cells, ["area", "block"]).select("area", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "cls", F.lit(False).alias("ask"))
    both = asked.union(held).groupBy("area", "block", "part", "cls").agg(F.max("ask").alias("ask")).join(sets, "cls")
    more = both.groupBy("area", "block", "part").applyInPandas(_search(percent), "a long, b long")
    return links.union(materialize(more, "links"))


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, text_key, component)`` for every row of ``docs``.

    A row's set is its distinct ``size``-word shingles, letters A-Z lower-cased;
    fewer words make one shingle; none (null, empty or blank text) make an empty
    set that links with nothing.  ``component_id`` is the smallest id reachable
    over links, the row's own included; rows without an id link like others, and
    theirs is null only where nothing linked has an id.  ``component`` tells the
    groups apart whatever their ids (null for an empty set), and ``text_key`` is
    the xxhash64 of the text, which tells apart rows that share an id.  Repeated
    rows each keep their row; very long texts count whole.  Other columns of
    ``docs`` are not read.  An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    meta = materialize(docs.mapInArrow(_meta(size), "doc_id long, text_key long, cls long, n long, half long"), "meta")
    links = link_classes(docs, meta, percent, size, block)
    comp = connected_components(links, "a", "b")
    labelled = meta.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    labelled = labelled.join(comp, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("component"), "least")
    labelled = materialize(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    # a component may hold a third of all classes, and a class a third of all rows
    limit = hot_limit(meta.count())
    final = materialize(join_hot(labelled.select("cls", "component"), least, "component", limit), "final")
    own = join_hot(meta.where("n > 0").select("doc_id", "n", "text_key", "cls"), final, "cls", limit)
    own = own.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key", "component")
    return own.union(meta.where("n = 0").select("doc_id", "n", "doc_id", "text_key", F.lit(None).cast("long")))


def text_key(text_col: str = "text") -> Column:
    """Key of a text; null and empty texts share one."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

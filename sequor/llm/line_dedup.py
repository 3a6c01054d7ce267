"""Line dedup with sharded cuckoo filters backed by an exact reference-count table.

The table has one row for each line key (its 128-bit digest): the number of
documents that hold it.  Adding or deleting documents adds or subtracts counts,
so every step can be undone.  Keys at or over the threshold sit in the cuckoo
filter of their shard; counts that cross the threshold insert or delete there.
A filter may claim a key that it does not hold, so what it claims of the documents
to clean is checked against the table, and the few false claims are taken back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequor.operators.storage import materialize

#: Filters: at least so many, and one for so many keys.
SHARDS = 64
SHARD_KEYS = 100_000
#: Bytes of filters up to which they go to every task; beyond, keys travel to their filter.
BROADCAST_BYTES = 64 << 20
#: False claims (16 bytes each) up to which they go to every task.
BROADCAST_FALSE = 1_000_000
#: Keys that one task asks a filter.
SLICE_KEYS = 500_000
#: Bits of a key's mark: a filter claims about 8 in 2**32 of the keys that it does not hold.
MARK_BITS = 32
_SLOTS = 4
_KICKS = 500
_SPACES = " \t\n\x0b\x0c\r"
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class CuckooFilter:
    """Approximate set of 128-bit keys with deletion: marks of up to 32 bits, four to a bucket, two buckets to a key."""

    def __init__(self, capacity: int, bits: int = MARK_BITS) -> None:
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (_SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, _SLOTS), dtype=np.uint32)
        self.bits = bits
        self._turn = np.random.default_rng(1)

    def _split(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
        mark = (raw[:, 1] & np.uint64((1 << self.bits) - 1)).astype(np.uint32)
        return raw[:, 0], np.where(mark == 0, 1, mark).astype(np.uint32)

    def _other(self, at, mark):
        return (at ^ (np.asarray(mark).astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(self.buckets - 1)

    def insert(self, key: bytes) -> None:
        h, mark = self._split([key])
        at, mark = int(h[0]) & (self.buckets - 1), mark[0]
        for i in (at, int(self._other(np.uint64(at), mark))):
            free = np.flatnonzero(self.table[i] == 0)
            if len(free):
                self.table[i, free[0]] = mark
                return
        for _ in range(_KICKS):
            slot = int(self._turn.integers(_SLOTS))
            mark, self.table[i, slot] = self.table[i, slot], mark
            i = int(self._other(np.uint64(i), mark))
            free = np.flatnonzero(self.table[i] == 0)
            if len(free):
                self.table[i, free[0]] = mark
                return
        raise OverflowError("cuckoo filter is full")

    def delete(self, key: bytes) -> bool:
        h, mark = self._split([key])
        at = int(h[0]) & (self.buckets - 1)
        for i in (at, int(self._other(np.uint64(at), mark[0]))):
            own = np.flatnonzero(self.table[i] == mark[0])
            if len(own):
                self.table[i, own[0]] = 0
                return True
        return False

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, dtype=bool)
        h, mark = self._split(keys)
        at = h & np.uint64(self.buckets - 1)
        both = (self.table[at] == mark[:, None]) | (self.table[self._other(at, mark)] == mark[:, None])
        return both.any(axis=1)

    @classmethod
    def build(cls, keys: list[bytes], bits: int = MARK_BITS) -> CuckooFilter:
        room = len(keys)
        while True:
            out = cls(room, bits)
            try:
                for k in keys:
                    out.insert(k)
                return out
            except OverflowError:
                room = 2 * room + 8

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, bits: int = MARK_BITS) -> CuckooFilter:
        out = cls(0, bits)
        out.table = np.frombuffer(raw, dtype=np.uint32).reshape(-1, _SLOTS).copy()
        out.buckets = len(out.table)
        return out


def line_keys(text: Column, least: int = 1) -> Column:
    """Digests of the distinct keys of a text's lines, as 16 bytes; keys under ``least`` code points have none."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(F.regexp_replace(x, _TRIM, ""), _UPPER, _LOWER))
    return F.transform(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= least)), lambda k: F.unhex(F.md5(k)))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def reference_counts(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """``(key, docs)``: how many rows of ``docs`` hold each line key; counts add up before they travel."""
    return docs.select(F.explode(line_keys(F.col(text_col), least)).alias("key")).groupBy("key").agg(F.count("*").alias("docs"))


@dataclass
class LineIndex:
    """The exact table ``counts(key, docs)`` and ``filters(shard, filter)`` of the keys at or over ``threshold``."""

    counts: DataFrame
    filters: DataFrame
    threshold: int
    least: int
    shards: int = SHARDS
    bits: int = MARK_BITS

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = 10, least: int = 1, text_col: str = "text", shard_keys: int = SHARD_KEYS, bits: int = MARK_BITS) -> LineIndex:
        counts = materialize(reference_counts(docs, text_col, least), "linecounts")
        often = counts.where(F.col("docs") >= threshold).select("key")
        shards = max(SHARDS, -(-often.count() // shard_keys))
        filters = often.select(_shard(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInPandas(_build_filter(bits), "shard int, filter binary")
        return cls(counts, materialize(filters, "filters"), threshold, least, shards, bits)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._apply(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Undo the insertion of ``docs``; counts that reach zero leave the table, and one below is an error."""
        return self._apply(docs, text_col, -1)

    def _apply(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        delta = reference_counts(docs, text_col, self.least).select("key", (F.col("docs") * sign).alias("delta"))
        both = self.counts.join(delta, "key", "full").select("key", F.coalesce("docs", F.lit(0)).alias("old"), F.coalesce("delta", F.lit(0)).alias("delta"))
        both = materialize(both.withColumn("new", F.col("old") + F.col("delta")), "linecounts")
        if sign < 0 and both.where("new < 0").limit(1).count():
            raise ValueError("documents to delete hold lines that were not inserted")
        over = lambda c: F.col(c) >= self.threshold
        moved = both.where(over("old") != over("new")).select(_shard(F.col("key"), self.shards).alias("shard"), "key", over("new").alias("enters"))
        held = self.filters.select("shard", "filter")
        filters = held.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(_update_filter(self.bits), "shard int, filter binary")
        filters = materialize(filters, "filters")
        counts = both.where("new > 0").select("key", F.col("new").alias("docs"))
        # a filter that has no room left is built anew from its shard's keys
        full = filters.where("filter is null").select("shard")
        if full.limit(1).count():
            keys = counts.where(F.col("docs") >= self.threshold).select(_shard(F.col("key"), self.shards).alias("shard"), "key").join(F.broadcast(full), "shard", "left_semi")
            filters = materialize(filters.where("filter is not null").union(keys.groupBy("shard").applyInPandas(_build_filter(self.bits), "shard int, filter binary")), "filters")
        return LineIndex(counts, filters, self.threshold, self.least, self.shards, self.bits)

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, broadcast_false: int = BROADCAST_FALSE) -> DataFrame:
        """``(doc_id, n_lines, n_dropped, text)`` for every row: its lines whose key is under the threshold.

        A null or empty text is one empty line, which has no key and stays.  Lines
        of a key go in every document, repeats included; order is kept.  Documents
        that the index has not seen are cleaned by its counts too.  Repeated rows
        and ids keep their rows, very long texts are cleaned whole; other columns
        are not read; an empty table gives no rows.
        """
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        often = self.counts.where(F.col("docs") >= self.threshold).select("key")
        if size > broadcast_bytes:
            return self._clean_by_shards(docs, often)
        spark = docs.sparkSession
        # at most broadcast_bytes
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.toLocalIterator()})
        claimed = docs.select("text").mapInArrow(_claims(shared, self.shards, self.least, self.bits), "key binary").distinct()
        false = materialize(claimed.join(often, "key", "left_anti"), "falseclaims")
        if false.count() > broadcast_false:
            return self._clean_by_shards(docs, often)
        wrong = spark.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in false.toLocalIterator()))
        dtype = docs.schema["doc_id"].dataType.simpleString()
        return docs.mapInArrow(_drop_lines(shared, wrong, self.shards, self.least, self.bits), f"doc_id {dtype}, n_lines long, n_dropped long, text string")

    def _clean_by_shards(self, docs: DataFrame, often: DataFrame) -> DataFrame:
        """The same rows where filters are too large for every task: keys travel to their filter, in slices of bounded size."""
        docs = docs.withColumn("row_key", F.md5(F.coalesce("text", F.lit(""))))
        keys = line_keys(F.col("text"), self.least)
        n_keys = docs.agg(F.sum(F.size(keys))).first()[0] or 0
        slices = max(1, -(-n_keys // (self.shards * SLICE_KEYS)))
        each = docs.select("row_key", F.explode(keys).alias("key")).distinct()
        each = each.withColumns({"shard": _shard(F.col("key"), self.shards), "slice": F.pmod(F.xxhash64("row_key", "key"), F.lit(slices)).cast("int")})
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "filter")
        claimed = each.groupBy("shard", "slice").cogroup(filters.groupBy("shard", "slice")).applyInPandas(_claimed_of(self.bits), "row_key string, key binary")
        claimed = materialize(claimed, "claims")
        false = materialize(claimed.select("key").distinct().join(often, "key", "left_anti"), "falseclaims")
        hit = claimed.join(F.broadcast(false) if false.count() <= BROADCAST_FALSE else false, "key", "left_anti")
        drops = hit.groupBy("row_key").agg(F.collect_set("key").alias("drops"))
        lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
        digest = lambda x: F.unhex(F.md5(F.translate(F.regexp_replace(x, _TRIM, ""), _UPPER, _LOWER)))
        kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("drops", digest(x)), F.lit(False)))
        out = docs.join(drops, "row_key", "left").select("doc_id", lines.alias("a"), kept.alias("b"))
        return out.select("doc_id", F.size("a").cast("long").alias("n_lines"), (F.size("a") - F.size("b")).cast("long").alias("n_dropped"), F.array_join("b", "\n").alias("text"))


def _build_filter(bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(bytes(k) for k in group["key"])
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "filter": [CuckooFilter.build(keys, bits).to_bytes()]})

    return run


def _update_filter(bits: int):
    """The filter of a shard after its keys moved; null if there is no room for them."""

    def run(old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else moved)["shard"].iloc[0]
        now = CuckooFilter.from_bytes(bytes(old["filter"].iloc[0]), bits) if len(old) else CuckooFilter(len(moved), bits)
        for key in moved.loc[~moved["enters"].astype(bool), "key"]:
            now.delete(bytes(key))
        try:
            for key in moved.loc[moved["enters"].astype(bool), "key"]:
                now.insert(bytes(key))
        except OverflowError:
            return pd.DataFrame({"shard": [shard], "filter": [None]})
        return pd.DataFrame({"shard": [shard], "filter": [now.to_bytes()]})

    return run


def _claimed_of(bits: int):
    def run(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(keys) or not len(held):
            return pd.DataFrame({"row_key": pd.Series(dtype=object), "key": pd.Series(dtype=object)})
        found = CuckooFilter.from_bytes(bytes(held["filter"].iloc[0]), bits).contains([bytes(k) for k in keys["key"]])
        return keys.loc[found, ["row_key", "key"]]

    return run


def _claimed(filters: dict[int, CuckooFilter], keys: list[bytes], shards: int) -> np.ndarray:
    out = np.zeros(len(keys), dtype=bool)
    if not keys:
        return out
    shard = np.frombuffer(b"".join(k[12:16] for k in keys), dtype=">u4").astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]]))
    for i, j in zip(cut, cut[1:]):
        s = int(shard[order[i]])
        if s in filters:
            out[order[i:j]] = filters[s].contains([keys[x] for x in order[i:j]])
    return out


def _keys_of(texts: list[str | None], least: int) -> tuple[list[list[bytes]], list[bytes]]:
    """The lines of each text, and the key of every line in turn (empty for none)."""
    lines = [(t or "").encode().split(b"\n") for t in texts]
    keys = []
    spaces = _SPACES.encode()
    for own in lines:
        for x in own:
            k = x.strip(spaces).translate(_FOLD)
            short = not k or (least > 1 and len(k.decode()) < least)
            keys.append(b"" if short else hashlib.md5(k).digest())
    return lines, keys


def _claims(shared, shards: int, least: int, bits: int):
    """Keys of the documents that the filters claim, once for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: CuckooFilter.from_bytes(b, bits) for s, b in shared.value.items()}
        told: set[bytes] = set()
        for batch in batches:
            fresh = sorted(set(_keys_of(batch.column(0).to_pylist(), least)[1]) - {b""} - told)
            found = [k for k, c in zip(fresh, _claimed(filters, fresh, shards)) if c]
            if len(told) < SHARD_KEYS:
                told.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["key"])

    return run


def _drop_lines(shared, wrong, shards: int, least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: CuckooFilter.from_bytes(b, bits) for s, b in shared.value.items()}
        not_held = wrong.value
        for batch in batches:
            texts, keys = _keys_of(batch.column(1).to_pylist(), least)
            named = sorted(set(keys) - {b""})
            go = {k for k, c in zip(named, _claimed(filters, named, shards)) if c and k not in not_held}
            n_lines, n_dropped, kept, at = [], [], [], 0
            for lines in texts:
                left = [x for x, k in zip(lines, keys[at : at + len(lines)]) if k not in go]
                at += len(lines)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    return run

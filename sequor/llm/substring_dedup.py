"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words.  Its minimiser is the least hash among its
``m``-word grams.  Consecutive windows that share a minimiser travel together as
one packed string to the minimiser's bucket, where sorting finds every window
that also starts earlier.  Equal windows have equal minimisers, so buckets are
independent.  A bucket sorts windows by hash and then compares the words of those
that share one, so the result is exact whatever the hashes do.

A minimiser that one task alone meets often is hot everywhere: its windows are
dealt by their own hash instead, so a passage in a third of all documents is
spread over all buckets.  Equal strings of one task are shipped once.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.llm.hashing import Words, grams, mix64, trim, words

_NULL_ID = np.iinfo(np.int64).max
#: Raw bytes of packed strings that one bucket holds, and that a task gathers before it ships.
BUCKET_BYTES = 24 << 20
SHIP_BYTES = 24 << 20
#: A minimiser met this often in one Arrow batch run of a task is hot; more rows in a task cannot hide it.
HOT_COUNT = 64


def _tag(hashes: np.ndarray, null: bool) -> int:
    """Tells texts of one id apart, and a null id from the greatest one: it comes behind."""
    x = struct.unpack("<i", hashlib.md5(hashes.tobytes()).digest()[:4])[0]
    return x & 0x7FFFFFFF if null else x | -(1 << 31)


def _runs(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser, row) of each super-k-mer of a chunk; positions are the chunk's words."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    g = grams(w.hashes, m)
    row = np.repeat(np.arange(len(w)), np.diff(w.offsets))
    valid = np.flatnonzero(row[:n] == row[k - 1 :])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    low = np.lib.stride_tricks.sliding_window_view(g, k - m + 1).argmin(axis=1) + np.arange(n)
    low = low[valid]
    cut = np.ones(len(valid), dtype=bool)
    cut[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1] + 1) | (row[valid[1:]] != row[valid[:-1]])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(valid)) - 1
    return valid[first], valid[last], g[low[first]], row[valid[first]]


def _hot(k: int, m: int, limit: int):
    """Minimisers met at least ``limit`` times by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for w in words(batch.column(0), lower=False):
                least, n = np.unique(_runs(w, k, m)[2], return_counts=True)
                for x, c in zip(least[n > 1].tolist(), n[n > 1].tolist()):
                    seen[x] = seen.get(x, 0) + c
        hot = [x for x, c in seen.items() if c >= limit]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(hot, np.uint64).view(np.int64))], names=["g"])

    return run


_COLUMNS = {"bucket": pa.int64(), "blob": pa.binary(), "doc_id": pa.int64(), "tag": pa.int32(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}
_SHIPPED = "bucket long, blob binary, doc_id long, tag int, starts array<int>, ends array<int>"
_CUT = "doc_id long, tag int, starts array<int>, ends array<int>"


def _ship(k: int, m: int, buckets: int, hot: np.ndarray):
    """Packed super-k-mers by bucket; what a task finds removed by itself has a bucket below 0."""

    class Load:
        def __init__(self) -> None:
            self.seen: dict[bytes, tuple] = {}
            self.size = 0
            self.cut: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def add(self, bucket: int, text: bytes, at: tuple[int, int, int], n: int) -> None:
            old = self.seen.get(text)
            if old is None:
                self.seen[text] = (bucket, at, n)
                self.size += len(text) + 40
                return
            if at < old[1]:
                self.seen[text] = (bucket, at, n)
                at = old[1]
            elif at == old[1]:
                return
            self.cut.setdefault(at[:2], []).append((at[2], at[2] + n))

        def out(self) -> Iterator[pa.RecordBatch]:
            rows: dict[int, list] = {}
            for text, (bucket, at, _) in self.seen.items():
                rows.setdefault(bucket, []).append((text, at))
            pack = zstandard.ZstdCompressor(level=5)
            for bucket, items in rows.items():
                lens = np.array([len(t) for t, _ in items], dtype=np.uint32)
                ids = np.array([a[0] for _, a in items], dtype=np.int64)
                tags = np.array([a[1] for _, a in items], dtype=np.int32)
                starts = np.array([a[2] for _, a in items], dtype=np.int32)
                raw = struct.pack("<q", len(items)) + lens.tobytes() + ids.tobytes() + tags.tobytes() + starts.tobytes() + b"".join(t for t, _ in items)
                yield _batch([(bucket, pack.compress(raw), None, None, None, None)])
            cuts = [(-1 - i % buckets, None, i, t, [s for s, _ in v], [e for _, e in v]) for (i, t), v in self.cut.items()]
            if cuts:
                yield _batch(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = Load()
        for batch in batches:
            ids, null = batch.column(0).fill_null(_NULL_ID).to_numpy(), batch.column(0).is_null().to_pylist()
            for w in words(batch.column(1), lower=False):
                first, last, least, row = _runs(w, k, m)
                if not len(first):
                    continue
                if len(hot) and (is_hot := np.isin(least, hot)).any():
                    n = last[is_hot] - first[is_hot] + 1
                    single = np.repeat(first[is_hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    own = grams(w.hashes, k)[single]
                    first, last = np.concatenate([first[~is_hot], single]), np.concatenate([last[~is_hot], single])
                    row = np.concatenate([row[~is_hot], np.repeat(row[is_hot], n)])
                    least = np.concatenate([least[~is_hot], own])
                # minimisers are small hashes by nature, so they are mixed again before they are dealt
                to = ((mix64(~least) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64).tolist()
                text = w.data.tobytes()
                tags = {r: _tag(w.of(r), null[w.first_row + r]) for r in np.unique(row).tolist()}
                begin, end = w.starts[first].tolist(), w.ends[last + k - 1].tolist()
                at = (first - w.offsets[row]).tolist()
                span = (last - first + k).tolist()
                who = (ids[w.first_row + row]).tolist()
                for b, x, y, i, r, s, n in zip(to, begin, end, who, row.tolist(), at, span):
                    load.add(b, text[x:y], (i, tags[r], s), n)
                if load.size >= SHIP_BYTES:
                    yield from load.out()
                    load = Load()
        yield from load.out()
        del load
        trim()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COLUMNS.values())], names=list(_COLUMNS))


def _count(k: int):
    """Windows of a bucket that also start earlier, as runs of words by document."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:
            return group[["doc_id", "tag", "starts", "ends"]]
        unpack = zstandard.ZstdDecompressor()
        hashes, ids, tags, starts, datas, begins, ends, size = [], [], [], [], [], [], [], 0
        for blob in group["blob"]:
            raw = unpack.decompress(blob)
            n = struct.unpack_from("<q", raw)[0]
            lens = np.frombuffer(raw, np.uint32, n, 8)
            doc = np.frombuffer(raw, np.int64, n, 8 + 4 * n)
            tag = np.frombuffer(raw, np.int32, n, 8 + 12 * n)
            at = np.frombuffer(raw, np.int32, n, 8 + 16 * n)
            offsets = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
            column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[8 + 20 * n :]))
            for w in words(column, lower=False):
                g = grams(w.hashes, k)
                row = np.repeat(np.arange(len(w)), np.diff(w.offsets))
                ok = np.flatnonzero(row[: len(g)] == row[k - 1 :])
                r = row[ok]
                hashes.append(g[ok])
                ids.append(doc[w.first_row + r])
                tags.append(tag[w.first_row + r])
                starts.append(at[w.first_row + r] + (ok - w.offsets[r]).astype(np.int32))
                datas.append(w.data.tobytes())
                begins.append(w.starts[ok] + size)
                ends.append(w.ends[ok + k - 1] + size)
                size += len(w.data)
        h, i, t, s = (np.concatenate(x) for x in (hashes, ids, tags, starts))
        begin, end, data = np.concatenate(begins), np.concatenate(ends), b"".join(datas)
        del hashes, ids, tags, starts, begins, ends, datas
        order = np.argsort(h, kind="stable")
        edge = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        many = ~edge
        many[:-1] |= ~edge[1:]
        order = order[many]
        h, i, t, s, begin, end = h[order], i[order], t[order], s[order], begin[order], end[order]
        h = _told_apart(h, data, begin, end)
        del data, begin, end
        order = np.lexsort((s, t, i, h))
        h, i, t, s = h[order], i[order], t[order], s[order]
        later = np.zeros(len(h), dtype=bool)
        later[1:] = h[1:] == h[:-1]
        # rows with the id and the text of the first one are that document
        head = np.maximum.accumulate(np.where(later, 0, np.arange(len(h)))) if len(h) else np.zeros(0, int)
        later &= ~((i == i[head]) & (t == t[head]) & (s == s[head]))
        out = _intervals(i[later], t[later], s[later], k)
        trim()
        return out

    return run


def _told_apart(h: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of windows (spans of ``data``), among those of one hash equal just where all their words are; ``h`` is sorted."""
    first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    out = np.cumsum(first) - 1
    head = np.flatnonzero(first)[out] if len(h) else out
    begins, ends, later = begin.tolist(), end.tolist(), np.flatnonzero(~first).tolist()
    odd = []
    for x, y in zip(later, head[~first].tolist()):
        a, b = data[begins[x] : ends[x]], data[begins[y] : ends[y]]
        # white space between words may differ
        if a != b and a.split() != b.split():
            odd.append(x)
    seen: dict[tuple, int] = {}
    for x in odd:
        words_ = (int(out[x]), *data[begins[x] : ends[x]].split())
        out[x] = len(h) + seen.setdefault(words_, len(seen))
    return out


def _intervals(i: np.ndarray, t: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    order = np.lexsort((s, t, i))
    i, t, s = i[order], t[order], s[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1])
    cut = new.copy()
    cut[1:] |= s[1:] > s[:-1] + 1
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(i)) - 1 if len(i) else first
    begin, end = s[first], s[last] + k
    doc = np.flatnonzero(new[first])
    parts = zip(doc, np.append(doc[1:], len(first)) if len(doc) else doc)
    rows = [(i[first[a]], t[first[a]], begin[a:b].tolist(), end[a:b].tolist()) for a, b in parts]
    return pd.DataFrame(rows, columns=["doc_id", "tag", "starts", "ends"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        null, text, cuts = batch.column(0).is_null().to_pylist(), batch.column(1), batch.column(2)
        n_words, n_removed, kept = [], [], []
        for w in words(text, lower=False):
            for r in range(len(w)):
                h = w.of(r)
                own = (text[w.first_row + r].as_py() or "").encode().split()
                gone = np.zeros(len(own) + 1, dtype=np.int64)
                found = cuts[w.first_row + r].as_py()
                if found:
                    tag = _tag(h, null[w.first_row + r])
                    for c in found:
                        if c["tag"] == tag:
                            np.add.at(gone, c["starts"], 1)
                            np.add.at(gone, c["ends"], -1)
                    out = np.cumsum(gone[:-1]) > 0
                    own = [x for x, y in zip(own, out.tolist()) if not y]
                n_words.append(len(h))
                n_removed.append(len(h) - len(own))
                kept.append(b" ".join(own).decode())
        trim()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame, k: int = 20, m: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT_COUNT) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)`` for every row: its words less those in a window seen earlier.

    Earlier is a smaller id, or the same document and an earlier start; a null
    id comes last.  Rows that repeat an id and a text are one document and get
    one result; different texts of one id are ordered by a hash.  Texts that are
    null, empty or shorter than ``k`` words lose nothing.  ``text`` has the kept
    words joined by one space.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-int(size * (3 * k - m) // (k - m + 2)) // bucket_bytes))
    often = docs.select("text").mapInArrow(_hot(k, m, hot), "g long").distinct()
    # at most one minimiser for each ``hot`` super-k-mers of a task
    hot_list = np.array([r.g for r in often.toLocalIterator()], dtype=np.int64).view(np.uint64)
    shipped = docs.mapInArrow(_ship(k, m, buckets, np.sort(hot_list)), _SHIPPED)
    cuts = shipped.groupBy("bucket").applyInPandas(_count(k), _CUT)
    cuts = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "starts", "ends")).alias("cuts"))
    key = F.coalesce("doc_id", F.lit(int(_NULL_ID)))
    whole = docs.withColumn("key", key).join(cuts.withColumnRenamed("doc_id", "key"), "key", "left").select("doc_id", "text", "cuts")
    return whole.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, text string")

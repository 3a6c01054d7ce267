"""Importance resampling toward a target corpus by hashed n-gram features.

The dictionary of distinct features is built once for the whole corpus:

1.  The runs of one and two words of a chunk of documents leave it once each, as
    strings with their counts, for the part of the dictionary that owns them.
2.  A part meets each distinct string of all chunks once, hashes it once, adds
    the counts up by bucket, and tells each chunk the buckets of its features.
3.  Buckets of the corpus and of the target give a gain each (as many numbers as
    there are buckets, whatever the corpus).  Gains join back to the chunk's
    per-document feature counts, which gives each document's weight.

Strings are compared as strings throughout; a hash only deals them to parts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequor.llm.chunks import Chunks, opened
from sequor.llm.hashing import _LOWER, mix64, trim
from sequor.llm.packing import packed, unpacked
from sequor.operators.storage import materialize, release

#: Bytes of text of a chunk, and of the corpus for each part of the dictionary.
RUN_BYTES = 6 << 20
PART_BYTES = 10 << 20
#: Documents of fewer words are weighed but never drawn.
LEAST_WORDS = 20
_WORD = np.ones(256, dtype=bool)
_WORD[:0x80] = False
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and each word's number among them and its text's place."""
    data = _LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    # the last byte is a separator, so every word has an end
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = every.dictionary_encode()
    bounds = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), per_text)


def _features(texts: list[bytes]) -> tuple[pa.Array, int, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and of each occurrence its feature (a word's number, or ``(first + 1) << bits | second``) and its text's place; words a text."""
    words, code, row = _tokens(texts)
    bits = max(1, len(words).bit_length())
    pair = np.flatnonzero(row[1:] == row[:-1])
    feature = np.concatenate([code, ((code[pair] + 1) << bits) | code[pair + 1]])
    return words, bits, feature, np.concatenate([row, row[pair]]), np.bincount(row, minlength=len(texts))


def _dealt(words: pa.Array, bits: int, distinct: np.ndarray, parts: int) -> np.ndarray:
    """The part that owns each feature: by the hashes of its words, so alike in every chunk."""
    own = mix64(np.array([zlib.crc32(w) for w in words.to_pylist()], dtype=np.uint64))
    single = np.searchsorted(distinct, 1 << bits)
    mark = np.empty(len(distinct), dtype=np.uint64)
    mark[:single] = own[distinct[:single]]
    first, second = distinct[single:] >> bits, distinct[single:] & ((1 << bits) - 1)
    mark[single:] = mix64(own[first - 1] * np.uint64(0x9E3779B97F4A7C15) + own[second])
    return ((mark >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _strings(words: pa.Array, bits: int, features: np.ndarray) -> pa.Array:
    """The features' strings; single words come first."""
    single = np.searchsorted(features, 1 << bits)
    one = pc.take(words, pa.array(features[:single]))
    first, second = pc.take(words, pa.array((features[single:] >> bits) - 1)), pc.take(words, pa.array(features[single:] & ((1 << bits) - 1)))
    return pa.concat_arrays([one, pc.binary_join_element_wise(first, second, pa.scalar(b" ", pa.binary()))])


def _told_order(words: pa.Array, bits: int, distinct: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk sends its features, part by part, and where each part begins."""
    part = _dealt(words, bits, distinct, parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _sent(parts: int):
    """A chunk's distinct features by part: ``(part, chunk, counts and strings)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                words, bits, feature, _, _ = _features(opened(batch.column(1)[at].as_py()).texts)
                feature.sort()
                first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]])[: len(feature)])
                times, distinct = np.diff(np.append(first, len(feature))).astype(np.uint32), feature[first]
                del feature
                order, cut = _told_order(words, bits, distinct, parts)
                out = []
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    own = order[cut[p] : cut[p + 1]]
                    strings = _strings(words, bits, distinct[own])
                    data = np.frombuffer(strings.buffers()[2], np.uint8)[: pc.sum(pc.binary_length(strings)).as_py()]
                    out.append((p, packed(times[own], pc.binary_length(strings).to_numpy().astype(np.uint16 if len(data) < 1 << 16 else np.uint32), data)))
                if out:
                    part, blob = zip(*out)
                    chunk = pa.array([batch.column(0)[at].as_py()] * len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), chunk, pa.array(blob, pa.binary())], names=["part", "chunk", "blob"])
        trim()

    return run


_NAMED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("told", pa.binary()), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def _named(buckets: int):
    """A part of the dictionary: each distinct string hashed once, its count added up, its bucket told to each chunk."""

    def run(table: pa.Table) -> pa.Table:
        part, chunks = table.column("part")[0].as_py(), table.column("chunk").to_pylist()
        totals, lens, data = zip(*(unpacked(b.as_py()) for b in table.column("blob")))
        del table
        sizes = [len(x) for x in lens]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lens), dtype=np.int64)])
        every = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))])
        coded = every.dictionary_encode()
        del every, data, lens, offsets
        code = coded.indices.to_numpy()
        bucket = np.fromiter((zlib.crc32(s.as_py()) % buckets for s in coded.dictionary), dtype=np.uint32, count=len(coded.dictionary))
        count = np.bincount(code, weights=np.concatenate(totals), minlength=len(bucket))
        # whole numbers far below 2**53, so sums of doubles are exact
        held = np.bincount(bucket, weights=count, minlength=buckets).astype(np.int64)
        full = np.flatnonzero(held)
        at = np.concatenate([[0], np.cumsum(sizes)])
        narrow = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket
        told = [packed(narrow[code[i:j]]) for i, j in zip(at, at[1:])]
        rows = [(c, part, b, None, None) for c, b in zip(chunks, told)] + [(None, part, None, full.tolist(), held[full].tolist())]
        out = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _NAMED.types)], schema=_NAMED)
        trim()
        return out

    return run


def _weighed(gains: np.ndarray, parts: int):
    """Weights of a chunk's documents: gains of its features, joined to the per-document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = opened(batch.column(1)[at].as_py())
                words, bits, feature, place, n_words = _features(rows.texts)
                distinct, number = np.unique(feature, return_inverse=True)
                order, _ = _told_order(words, bits, distinct, parts)
                told = sorted(batch.column(2)[at].as_py() or [], key=lambda x: x["part"])
                gain = np.zeros(len(distinct), dtype=np.int64)
                if told:
                    gain[order] = gains[np.concatenate([unpacked(x["told"])[0] for x in told])]
                # per-document counts, one for each feature of a text
                shift = max(1, len(distinct).bit_length())
                pair = (place << shift) | number
                pair.sort()
                first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
                times, pair = np.diff(np.append(first, len(pair))), pair[first]
                text = pair >> shift
                value = np.zeros(len(n_words), dtype=np.int64)
                np.add.at(value, text, gain[pair & ((1 << shift) - 1)] * times)
                features = np.zeros(len(n_words), dtype=np.int64)
                np.add.at(features, text, times)
                weight = np.where(features > 0, value // np.maximum(features, 1), 0)
                row = pa.array(np.arange(len(n_words), dtype=np.int64) + batch.column(0)[at].as_py())
                ids = pa.array(rows.ids, mask=rows.null.astype(bool))
                yield pa.RecordBatch.from_arrays([row, ids, *(pa.array(x.astype(np.int64)) for x in (n_words, features, weight))], names=["row", "doc_id", "n_words", "n_features", "weight"])
        trim()

    return run


def _dictionary(chunks: Chunks, buckets: int, parts: int) -> DataFrame:
    """The dictionary by part: what each chunk is told, and how many features each bucket holds."""
    sent = chunks.table.mapInArrow(_sent(parts), "part int, chunk long, blob binary")
    return materialize(sent.groupBy("part").applyInArrow(_named(buckets), "chunk long, part int, told binary, bucket array<int>, n array<long>"), "features")


def _by_bucket(named: DataFrame) -> dict[int, int]:
    """Features in each bucket; as many rows as buckets at most."""
    each = named.where("bucket is not null").select(F.explode(F.arrays_zip("bucket", "n")).alias("e"))
    return {r.bucket: r.n for r in each.groupBy(F.col("e.bucket").alias("bucket")).agg(F.sum("e.n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))`` of each bucket."""
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratio = lambda b: float(target.get(b, 0) + 1) * float(s_all) / (float(corpus.get(b, 0) + 1) * float(t_all))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def _noise(seed: int) -> Column:
    """Gumbel noise of a document's id, in thousandths."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, 1 for the highest score: sorted by range, counted by partition, numbered from where each starts."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    part = F.shiftrightunsigned("at", 33)
    # one row for each partition
    counts = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "p long, start long"))
    nth = F.col("at") - F.shiftleft(F.col("p"), 33) + F.col("start") + 1
    return placed.withColumn("p", part).join(start, "p").withColumn("place", nth).drop("at", "p", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = 10_000, seed: int = 7, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = RUN_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``.

    Words are runs of letters a-z, digits and characters beyond ASCII, A-Z
    lower-cased.  A document's features are its runs of one and two words, with
    repeats; its weight is the floored mean of their buckets' gains.  Of the
    ``N`` rows of ``least_words`` words at least, ``percent * N // 100`` of the
    highest scores are drawn without replacement and ranked from 1; others have
    no rank.  Ties go to the smaller id; rows that repeat an id and tie go in
    the order of the table, and a null id (noise of ``null``) comes last.  Null
    or empty texts have no features and weight 0.  A text is counted whole by
    one task.  Other columns are not read; an empty table gives no rows, an
    empty target counts as one without features.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    goal = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks, asked = Chunks(docs, "corpus", chunk_bytes), Chunks(goal, "target", chunk_bytes)
    parts = max(4, -(-chunks.bytes // part_bytes))
    named = _dictionary(chunks, buckets, parts)
    gain = gains(_by_bucket(named), _by_bucket(_dictionary(asked, buckets, 1)), buckets)
    joined = chunks.joined(named.where("chunk is not null").select("chunk", "part", "told"), "told")
    weighed = joined.mapInArrow(_weighed(gain, parts), "row long, doc_id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + _noise(seed)), "scored")
    for done in (chunks, asked):
        done.release()
    release(named)
    able = scored.where(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    rank = F.when(F.col("place") <= draw, F.col("place"))
    drawn = _ranked(able).withColumn("rank", rank).drop("place")
    out = drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")

"""Texts packed by chunk, for operators that meet the corpus several times.

A chunk is a run of rows of bounded bytes, compressed as one row of a table that
is bucketed by chunk.  What an operator finds out about a chunk joins back to
its texts by chunk, and only the findings travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.llm.hashing import trim
from sequor.llm.packing import packed, unpacked
from sequor.operators.storage import materialize_bucketed, release, tasks

#: Bytes of text of a chunk; a longer single text is a chunk of its own.
CHUNK_BYTES = 10 << 20


@dataclass
class Texts:
    """The rows of a chunk: ids (0 where ``null`` is set), bytes, and what else was kept, one array a column."""

    null: np.ndarray
    ids: np.ndarray
    texts: list[bytes]
    more: list[np.ndarray]


def opened(blob: bytes) -> Texts:
    null, ids, lens, data, *more = unpacked(blob)
    ends = np.cumsum(lens, dtype=np.int64)
    raw = data.tobytes()
    return Texts(null, ids, [raw[e - n : e] for e, n in zip(ends.tolist(), lens.tolist())], more)


def _chunk(first: int, rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, *more = zip(*rows)
    null = np.array([i is None for i in ids], np.uint8)
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"".join([*texts, b"\0"]), np.uint8)[:-1]
    blob = packed(null, np.array([i or 0 for i in ids], np.int64), np.array([len(t) for t in texts], np.uint32), data, *(np.array(x, np.int64) for x in more))
    return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "texts"])


def _packed_rows(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, first = [], 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                number, *row = (c[at].as_py() for c in batch.columns)
                first = number if first is None else first
                rows.append(tuple(row))
                held += len(row[1] or b"") + 16
                if held >= chunk_bytes:
                    yield _chunk(first, rows)
                    rows, held, first = [], 0, None
        if rows:
            yield _chunk(first, rows)
        trim()

    return run


class Chunks:
    """The bucketed table ``(chunk, texts)`` of ``docs(doc_id, text)`` with ``more`` columns of longs; a chunk's name is the number of its first row."""

    def __init__(self, docs: DataFrame, label: str, chunk_bytes: int = CHUNK_BYTES, more: tuple[str, ...] = ()) -> None:
        self.rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        self.bytes = int(size or 0)
        self.buckets = tasks(docs.sparkSession, self.bytes, 2 * chunk_bytes)
        rows = docs.select(F.monotonically_increasing_id().alias("row_number"), "doc_id", F.col("text").cast("binary").alias("text"), *more)
        self.table = materialize_bucketed(rows.mapInArrow(_packed_rows(chunk_bytes), "chunk long, texts binary"), "chunk", self.buckets, label)

    def joined(self, found: DataFrame, column: str) -> DataFrame:
        """``(chunk, texts, column)``: the texts with all rows of ``found(chunk, ...)`` as an array; only ``found`` is dealt out."""
        rest = [c for c in found.columns if c != "chunk"]
        own = found.repartition(self.buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct(*rest)).alias(column))
        return self.table.join(own.hint("shuffle_hash"), "chunk", "left").select("chunk", "texts", column)

    def release(self) -> None:
        release(self.table)

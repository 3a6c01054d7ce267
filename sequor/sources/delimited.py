"""Delimited text with multi-line cells, read in parallel.

A line break ends a record only outside quotes, and whether a block of a file
starts within quotes depends on all that is before it.  So files are read by
block, twice: the first pass finds for each block how it leaves the quotes if it
was entered outside or inside of them, and how many records then start in it.
One row for each block comes to the driver, where the true entry of each and the
number of its first record follow by composition, as in a prefix sum.  In the
second pass each block gives its records, numbered in the order of the file; what
continues a record of the block before is joined to it by its number.
"""

from __future__ import annotations

import csv
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest cell, in characters.
MOST_CELL = 50 << 20
_GZIP = b"\x1f\x8b"


def leaves_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a line that is entered inside or outside a quoted cell ends inside one; a quote opens a cell only where a cell starts."""
    at, start = 0, True
    while True:
        if not inside:
            if start and line.startswith('"', at):
                at += 1
            else:
                found = line.find(delimiter + '"', at)
                if found < 0:
                    return False
                at = found + 2
            inside = True
        closing = line.find('"', at)
        if closing < 0:
            return True
        at = closing + 1
        if line.startswith('"', at):
            at += 1
        else:
            inside, start = False, False


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, int, str]]:
    files, blocks, lines = (c.to_pylist() for c in batch.columns)
    for file, block, line in zip(files, blocks, lines):
        yield file, block, line.decode("utf-8", "replace")


def _effects(delimiter: str):
    """``(file, block, out0, out1, n0, n1)``: how a block is left and how many records start in it, entered outside or inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for file, block, line in _texts(batch):
                own = held.setdefault((file, block), [False, True, 0, 0])
                for k in (0, 1):
                    own[2 + k] += not own[k]
                    if '"' in line:
                        own[k] = leaves_inside(line, own[k], delimiter)
        rows = [(*key, *own) for key, own in held.items()]
        if rows:
            types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "block", "out0", "out1", "n0", "n1"])

    return run


def _records(entries: dict[tuple[str, int], tuple[bool, int]], delimiter: str):
    """``(file, number, block, whole, text)``: records of each block, and pieces of those that reach beyond it."""
    names = ["file", "number", "block", "whole", "text"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, number, begun, lines, rows = None, False, 0, False, [], []
        for batch in batches:
            for file, block, line in _texts(batch):
                if key != (file, block):
                    if lines:
                        rows.append((*key[:1], number, key[1], False, "\n".join(lines)))
                    key, lines = (file, block), []
                    inside, number = entries[key]
                    # a block entered inside quotes starts with the rest of the record before
                    begun = not inside
                    number -= inside
                lines.append(line)
                inside = leaves_inside(line, inside, delimiter) if inside or '"' in line else False
                if not inside:
                    rows.append((file, number, block, begun, "\n".join(lines)))
                    number, begun, lines = number + 1, True, []
            if len(rows) >= 5000:
                yield out(rows)
                rows = []
        if lines:
            rows.append((key[0], number, key[1], False, "\n".join(lines)))
        if rows:
            yield out(rows)

    return run


def _parsed(width: int, delimiter: str):
    """Cells of each record; missing and empty ones are null, those beyond the header are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(MOST_CELL)
        for batch in batches:
            order, cells = [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
                    order.append(number)
                    cells.append([c or None for c in row[:width]] + [None] * (width - len(row)))
            columns = list(zip(*cells)) if cells else [()] * width
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["row_ord", *(f"c{i}" for i in range(width))])

    return run


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of files whose name does not tell whether they are gzip."""
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = gzip.open(io.BytesIO(content)) if content[:2] == _GZIP else io.BytesIO(content)
            lines: list[bytes] = []
            for line in raw:
                lines.append(line.removesuffix(b"\n"))
                if len(lines) == 20_000:
                    yield _lines(file, lines)
                    lines = []
            if lines:
                yield _lines(file, lines)


def _lines(file: str, lines: list[bytes]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([0] * n, pa.int64()), pa.array(lines, pa.binary())], names=["file", "block", "line"])


def _heads(spark: SparkSession, path: str) -> dict[str, bytes]:
    """The first two bytes of each file of a path, through the file system that Spark reads it by."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for status in fs.globStatus(at) or []:
        for file in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            name = file.getPath().getName()
            if file.isFile() and not name.startswith(("_", ".")):
                stream = fs.open(file.getPath())
                try:
                    out[file.getPath().toString()] = bytes(x for x in (stream.read(), stream.read()) if x >= 0)
                finally:
                    stream.close()
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line)`` in the order of each block; a file is gzip if its first bytes say so.

    Plain files split into blocks and named gzip files are read by Spark; a file
    whose name says otherwise than its bytes is one block.
    """
    odd = [f for f, head in _heads(spark, path).items() if (head == _GZIP) != f.endswith(".gz")]
    if odd:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return files.mapInArrow(_unzipped, "file string, block long, line binary")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _entries(effects: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """For each block whether it is entered inside quotes, and the number of the first record that starts in it."""
    out, file, inside, number = {}, None, False, 0
    for r in sorted(effects, key=lambda r: (r.file, r.block)):
        if r.file != file:
            file, inside, number = r.file, False, 0
        out[r.file, r.block] = inside, number
        inside, number = (r.out1, number + r.n1) if inside else (r.out0, number + r.n0)
    return out


def read_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(file, number, text)``: records of each file in order, line breaks within quotes kept; blank records have numbers too.

    What the driver holds is one row for each block of a file.  A record that
    reaches over blocks is put together from a piece of each.
    """
    lines = read_lines(spark, path)
    entries = _entries(lines.mapInArrow(_effects(delimiter), "file string, block long, out0 boolean, out1 boolean, n0 long, n1 long").collect())
    pieces = lines.mapInArrow(_records(entries, delimiter), "file string, number long, block long, whole boolean, text string")
    split = pieces.where("not whole").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    # a record that ends where its block ends is whole in it, and another's rest is not its own
    return pieces.where("whole").select("file", "number", "text").union(split.select("file", "number", "text"))


def read_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """The rows of delimited files with a header, all cells text, and ``row_ord`` in the order of the file.

    Marks of byte order are dropped, bad bytes replaced, blank records left out.
    The header is the first file's; other files' first records are headers too.
    """
    records = read_records(spark, path, delimiter)
    first = records.where("number = 0").orderBy("file").select("text").first()
    if first is None:
        raise ValueError(f"{path}: no header")
    header = next(csv.reader(io.StringIO(first.text.lstrip("﻿"), newline=""), delimiter=delimiter))
    body = records.where(F.col("number") > 0).where(~F.col("text").isin("", "\r"))
    parsed = ["row_ord long", *(f"c{i} string" for i in range(len(header)))]
    out = body.select("number", "text").mapInArrow(_parsed(len(header), delimiter), ", ".join(parsed))
    # a repeated name keeps its place by it
    names = [c if header.count(c) == 1 else f"{c}{i}" for i, c in enumerate(header)]
    return out.toDF("row_ord", *names).select(*[f"`{c}`" for c in names], "row_ord")

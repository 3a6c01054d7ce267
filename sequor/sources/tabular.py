"""Scans of delimited text, and parsers of pasted batches."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequor.functions.text import fold_missing
from sequor.sources.delimited import read_table

# Spellings of batch columns, and the longest batch.
SYNONYMS = {
    "name": ("name", "id", "label", "query"),
    "heavy": ("heavy", "vh", "vhh", "heavy_sequence", "vh_sequence"),
    "light": ("light", "vl", "light_sequence", "vl_sequence"),
    "sequence": ("sequence", "seq", "aa", "amino_acids"),
}


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...], label: str) -> DataFrame:
    """A CSV with header, multi-line cells and RFC quoting, split over tasks; gzip by its first bytes; all columns text.

    ``row_ord`` follows the order of the file.  Missing required columns are an error.
    """
    df = read_table(spark, path)
    require(df, required, label)
    return df


def require(df: DataFrame, required: tuple[str, ...], label: str) -> None:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{label}: missing columns {', '.join(missing)}")


def cell(df: DataFrame, name: str) -> Column:
    """A folded cell; empty where the file has no such column."""
    return fold_missing(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def limit_groups(df: DataFrame, source: str, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` record groups of each source, whole groups, in order of appearance."""
    firsts = df.groupBy(source, group).agg(F.min(order).alias("first_ord"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy("first_ord", group))).where(F.col("rank") <= most)
    return df.join(ranked.select(source, group), [source, group], "left_semi")


def fasta_records(lines: DataFrame, batch: str = "batch", order: str = "line_no", line: str = "line") -> DataFrame:
    """``(batch, record, name, sequence)`` of FASTA lines; unnamed records are ``sequence_N``."""
    header = F.col(line).startswith(">")
    number = F.sum(header.cast("int")).over(Window.partitionBy(batch).orderBy(order))
    body = F.sort_array(F.collect_list(F.when(~header, F.struct(order, line))))
    out = lines.withColumn("record", number).where("record > 0").groupBy(batch, "record")
    out = out.agg(F.max(F.when(header, F.trim(F.expr(f"substring({line}, 2)")))).alias("name"), F.array_join(F.transform(body, lambda x: F.regexp_replace(x[line], r"\s+", "")), "").alias("sequence"))
    return out.withColumn("name", F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("sequence_"), F.col("record"))).otherwise(F.col("name")))


def _parsed(raw: str) -> list[tuple[int, str, str, str, str]]:
    """``(record, name, heavy, light, sequence)`` of one pasted text."""
    text = raw.lstrip("\ufeff").strip("\n\r")
    first = text.split("\n", 1)[0]
    if text.startswith(">"):
        out: list[list] = []
        for line in text.splitlines():
            if line.startswith(">"):
                out.append([line[1:].strip() or f"sequence_{len(out) + 1}", ""])
            else:
                out[-1][1] += "".join(line.split()).upper()
        return [(i, name, "", "", s) for i, (name, s) in enumerate(out, 1)]
    delimiter = max("\t,;", key=first.count)
    names = [c.strip().strip('"').lower() for c in first.split(delimiter)]
    known = {k: next((names.index(s) for s in v if s in names), None) for k, v in SYNONYMS.items()}
    if first.count(delimiter) and any(known[k] is not None for k in ("heavy", "light", "sequence")):
        if text.count('"') % 2:
            raise ValueError("unclosed quote in table")
        table = [r for r in list(csv.reader(io.StringIO(text), delimiter=delimiter))[1:] if any(c.strip() for c in r)]
        get = lambda r, k: r[known[k]].strip() if known[k] is not None and known[k] < len(r) else ""
        return [(i, get(r, "name") or f"sequence_{i}", get(r, "heavy").upper(), get(r, "light").upper(), get(r, "sequence").upper()) for i, r in enumerate(table, 1)]
    return [(i, f"sequence_{i}", "", "", "".join(x.split()).upper()) for i, x in enumerate((x for x in text.splitlines() if x.strip()), 1)]


_RECORD = "record int, name string, heavy string, light string, sequence string"


def parse_batch(spark: SparkSession, raw: str) -> DataFrame:
    """``(record, name, heavy, light, sequence)`` of a pasted batch: a table, FASTA, or one sequence a line.

    The kind is told by the first line; a table's delimiter is the tab, comma or
    semicolon that its header has most of.  An open quote at the end is an error.
    """
    return spark.createDataFrame(_parsed(raw), _RECORD)


def parse_batches(batches_: DataFrame, key: str = "batch", raw: str = "raw") -> DataFrame:
    """``(batch, record, name, heavy, light, sequence, error)`` of many batches, each read as :func:`parse_batch` does.

    A batch that is in error gives one row that says so; null and empty ones give none.
    """
    kind = dict(batches_.dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            for own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                try:
                    rows += [(own, *r, None) for r in _parsed(text or "")]
                except ValueError as e:
                    rows.append((own, *[None] * 5, str(e)))
            types = (part.schema.field(0).type, pa.int32(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=["batch", "record", "name", "heavy", "light", "sequence", "error"])

    return batches_.select(F.col(key).alias("batch"), F.col(raw).alias("raw")).mapInArrow(run, f"batch {kind}, {_RECORD}, error string")


def links(pages: DataFrame, pattern: str) -> DataFrame:
    """``(page_id, link)`` of every ``href`` that matches; SQL regular expression."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(hrefs).alias("link")).where(F.col("link").rlike(pattern))


def batches(ids: DataFrame, id_col: str, size: int = 100) -> DataFrame:
    """Distinct ids in numbered batches of ``size``, by id within hash ranges so that no task numbers them all."""
    keyed = ids.select(id_col).distinct().withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(64)))
    counts = keyed.groupBy("part").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy(id_col))
    return keyed.withColumn("own", own).join(F.broadcast(counts.select("part", offset.alias("offset"))), "part").select(id_col, F.floor((F.col("offset") + F.col("own") - 1) / size).alias("batch"))

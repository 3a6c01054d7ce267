"""Fetches that depend on another table: delimited answers for batches of its ids."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.sources.paged import ATTEMPTS, fetch
from sequor.sources.tabular import batches

#: Ids of a request, and requests at a time.
BATCH = 100
AT_ONCE = 4


def fetch_linked(ids: DataFrame, id_col: str, url: str, columns: tuple[str, ...], answer_id: str | None = None, size: int = BATCH, at_once: int = AT_ONCE, attempts: int = ATTEMPTS) -> DataFrame:
    """Rows that an endpoint gives for the distinct ids of a table, all columns text.

    ``url`` holds ``{ids}``, for which a batch of up to ``size`` ids joined by
    commas stands, or ``{batch}``, its number.  A batch is one request, and
    ``at_once`` tasks make one at a time, so no more are under way.  Only ids in
    digits are asked; null and other ids are left out.  A batch that cannot be
    read, a header without one of ``columns`` and, if ``answer_id`` names the
    column of ids, a row for an id that was not asked are errors, so the result
    is whole or not there.  Ids are numbered in the cluster; none come to the
    driver.
    """
    asked = ids.select(F.col(id_col).cast("string").alias("id")).where(F.col("id").rlike("^[0-9]+$"))
    grouped = batches(asked, "id", size).groupBy("batch").agg(F.array_sort(F.collect_list("id")).alias("ids")).repartition(at_once)
    schema = pa.schema([(c, pa.string()) for c in columns])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = fetch(url.format(ids=quote(",".join(own), safe=","), batch=batch), attempts)
                rows = csv.DictReader(io.StringIO(text, newline=""))
                if missing := [c for c in columns if c not in (rows.fieldnames or ())]:
                    raise ValueError(f"batch {batch}: missing columns {', '.join(missing)}")
                kept = list(rows)
                if answer_id and (odd := {r[answer_id] for r in kept} - set(own)):
                    raise ValueError(f"batch {batch}: rows of ids that were not asked: {', '.join(sorted(odd)[:5])}")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] or "" for r in kept], pa.string()) for c in columns], schema=schema)

    return grouped.select("batch", "ids").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))

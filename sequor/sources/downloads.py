"""Fetching source files: link discovery, atomic download, inspection of what is there."""

from __future__ import annotations

import hashlib
import os
import re
import time
from urllib.parse import urljoin
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.sources.delimited import read_records
from sequor.sources.paged import ATTEMPTS, TIMEOUT


def discover(page: str, base_url: str, pattern: str, required: bool = True, fallback: str = "") -> str:
    """The first link of a page that matches; without one the fallback, unless discovery is required."""
    for href in re.findall(r"""href\s*=\s*["']([^"']+)["']""", page, re.IGNORECASE):
        url = urljoin(base_url, href)
        if re.search(pattern, url):
            return url
    if required or not fallback:
        raise LookupError(f"no link matches {pattern!r} on {base_url}")
    return fallback


def download(url: str, dest: str, accept: str = "*/*", attempts: int = ATTEMPTS) -> dict:
    """Fetch to ``dest``, whole or not at all; returns bytes, sha256 and the last change."""
    part = f"{dest}.part"
    for n in range(attempts):
        try:
            sha, size = hashlib.sha256(), 0
            with urlopen(Request(url, headers={"Accept": accept}), timeout=TIMEOUT) as answer, open(part, "wb") as out:  # noqa: S310
                changed = answer.headers.get("Last-Modified", "")
                while chunk := answer.read(1 << 20):
                    sha.update(chunk)
                    size += len(chunk)
                    out.write(chunk)
            os.replace(part, dest)
            return {"bytes": size, "sha256": sha.hexdigest(), "last_modified": changed}
        except OSError:
            if os.path.exists(part):
                os.remove(part)
            if n == attempts - 1:
                raise
            time.sleep(min(8, 2**n))
    raise AssertionError


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256, rows)`` of cached delimited files; a header is no row."""
    files = spark.read.format("binaryFile").load(path)
    counts = read_records(spark, path).where(~F.col("text").isin("", "\r")).groupBy("file").agg(F.count("*").alias("n"))
    told = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return told.join(counts, name("path") == name("file"), "left").select("path", "bytes", "sha256", F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).alias("rows"))

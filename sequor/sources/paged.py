"""A paged CSV endpoint as a data source: one partition for each page.

``spark.dataSource.register(PagedCsv)`` and then
``spark.read.format("paged_csv").schema(...).option("url", "file:///x/page-{page}.csv")``.
The driver finds the last page, the first of fewer rows than ``page_size``, by
doubling and bisection, so it reads twice the logarithm of their number; ``pages``
may say how many there are instead.  A page that cannot be read, a changed header, a
short page before the last and more than ``max_pages`` pages are errors, so a table
is whole or not there.
"""

from __future__ import annotations

import csv
import io
import time
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The download budget.
PAGE_SIZE = 10_000
MAX_PAGES = 100
ATTEMPTS = 4
TIMEOUT = 120


def fetch(url: str, attempts: int = ATTEMPTS) -> str:
    """Text of a url, tried again after 1, 2, 4 (at most 8) seconds."""
    for n in range(attempts):
        try:
            with urlopen(url, timeout=TIMEOUT) as answer:  # noqa: S310
                return answer.read().decode("utf-8-sig", "replace")
        except OSError:
            if n == attempts - 1:
                raise
            time.sleep(min(8, 2**n))
    raise AssertionError


class PagedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_csv"

    def schema(self) -> str:
        """The header of the first page, all columns text."""
        first = fetch(_url(self.options, 0)).split("\n", 1)[0]
        return ", ".join(f"`{c}` string" for c in next(csv.reader([first])))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def _url(options: dict, page: int) -> str:
    size = int(options.get("page_size", PAGE_SIZE))
    return options["url"].format(page=page, limit=size, offset=page * size)


def _rows(text: str) -> tuple[list[str] | None, Iterator[list[str]]]:
    rows = csv.reader(io.StringIO(text))
    return next(rows, None), rows


class _Page(InputPartition):
    def __init__(self, value: int, last: bool) -> None:
        super().__init__(value)
        self.last = last


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.columns = [f.name for f in schema]
        self.options = options
        self.size = int(options.get("page_size", PAGE_SIZE))
        self.most = int(options.get("max_pages", MAX_PAGES))

    def _page(self, page: int) -> tuple[list[str] | None, Iterator[list[str]]]:
        return _rows(fetch(_url(self.options, page), int(self.options.get("attempts", ATTEMPTS))))

    def _end(self) -> int:
        """The first page that is not full.

        Pages before it are full and pages behind it are empty or not there; that
        it can be read is made sure, so an outage is an error and not the end.
        """
        failed: dict[int, OSError] = {}

        def full(page: int) -> bool:
            try:
                return sum(1 for _ in self._page(page)[1]) >= self.size
            except OSError as e:
                failed[page] = e
                return False

        low, high = -1, 0
        while full(high):
            if high >= self.most:
                return high + 1
            low, high = high, min(2 * high + 1, self.most)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if full(middle) else (low, middle)
        if high in failed:
            raise failed[high]
        return high

    def partitions(self) -> list[InputPartition]:
        """One for each page."""
        n = int(self.options["pages"]) if "pages" in self.options else self._end() + 1
        if n > self.most:
            raise ValueError(f"more than {self.most} pages")
        return [_Page(p, p == n - 1) for p in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        header, rows = self._page(partition.value)
        if header is None and partition.last and partition.value:
            return
        if header != self.columns:
            raise ValueError(f"page {partition.value}: the header changed")
        n = 0
        for row in rows:
            n += 1
            yield tuple(row)
        if n > self.size or n < self.size and not partition.last:
            raise ValueError(f"page {partition.value} has {n} rows, not {self.size}")

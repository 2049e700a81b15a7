"""Pages of files as a Spark data source: ``spark.read.format("leafmill_pages").option("path", ...).load()``.

Each partition is a range of pages of one file, so one long file is read by many tasks. Filters on ``file`` leave out files before
they are opened, filters on ``page_no`` leave out pages before they are parsed; what is pushed is not filtered again. For folders
that every executor mounts; ``Engine.convert_files`` reads any store that Spark reads.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from leafmill.sources import backends, formats

#: Bytes of a file from which its pages are counted and dealt to several tasks.
LARGE = 1 << 20


class PageRange(InputPartition):
    def __init__(self, path: str, first: int, last: int | None):
        self.path, self.first, self.last = path, first, last


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k: v for k, v in options.items() if k != "path"}
        self.path = options["path"].removeprefix("file://")
        self.step = int(options.get("pagesperpartition", options.get("pagesPerPartition", "64")))
        self.names: set[str] | None = None
        self.first, self.last = 1, 2**31 - 1
        self.pages_only = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("file",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            elif column == ("page_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.pages_only = True  # a file without pages has no page number, which no comparison lets through
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _files(self) -> list[str]:
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        found = [f for f in found if not os.path.basename(f).startswith((".", "_"))]
        return found if self.names is None else [f for f in found if os.path.basename(f) in self.names]

    def partitions(self) -> list[PageRange]:
        out: list[PageRange] = []
        for path in self._files():
            if os.path.getsize(path) < LARGE:
                out.append(PageRange(path, self.first, None))
                continue
            try:
                count = self._opened(path).page_count()
            except Exception:  # the task that reads it says why
                out.append(PageRange(path, self.first, None))
                continue
            last = min(count, self.last)
            out += [PageRange(path, k, min(k + self.step - 1, last)) for k in range(self.first, last + 1, self.step)]
        return out or [PageRange("", 1, 0)]

    def _opened(self, path: str) -> backends.Backend:
        with open(path, "rb") as f:
            return backends.backend_of(formats.format_of_name(os.path.basename(path)))(f.read(), self.options)

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if not partition.path:
            return
        name = os.path.basename(partition.path)
        fmt = formats.format_of_name(name)
        with open(partition.path, "rb") as f:
            content = f.read()
        last = self.last if partition.last is None else partition.last
        for row in backends.rows_of(name, backends.known(fmt), fmt, content, self.options, partition.first, last):
            if row[1] is not None or not self.pages_only:
                yield row


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafmill_pages"

    def schema(self) -> str:
        return backends.PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)

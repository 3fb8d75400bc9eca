"""Archives of fetched pages: text files with a JSON record {url, status, html} a line.

page_archive is a data source: files are cut into ranges of bytes by their size, and a range's reader begins at the first
line that starts in it. The options url (a prefix), status and error (lists; none for no error) are tests that rows must
pass before they leave the reader. They are options as filters that Spark pushes into a Python reader stay with it: a later
query on the same frame, with no filter to push, was answered from the filtered reader (Spark 4.1). Every record is a row. What a fetcher would raise is told by error: limited (status 403 or 429), http (another status than 200 to 299),
blocked (a page that stands in for another), broken (a line that is no record); such rows have no html, broken ones
neither url nor status. Readers open files themselves, so the folder must be on a file system that all machines mount;
rows_of gives the same rows from any store that Spark reads, in column expressions.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed, urls

SCHEMA = "url string, status int, html string, error string"
#: Bytes of a range, unless the option says otherwise, and of the rows that a reader sends at once.
RANGE, SENT = 64 << 20, 4 << 20


def write_archive(pages: DataFrame, folder: str) -> None:
    """pages (url, status, html) as an archive."""
    pages.select(F.to_json(F.struct("url", "status", "html"), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)


def local(path: str) -> str:
    """A path without its scheme; ValueError if files can't be opened there."""
    for scheme in ("file://", "file:"):
        path = path.removeprefix(scheme)
    if "://" in path:
        raise ValueError(f"{path} is not on a mounted file system; use rows_of")
    return path


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def record(line: bytes) -> tuple[str | None, int | None, str | None, str | None]:
    """url, status, html and error of a line."""
    try:
        x = json.loads(line)
        url, status, html = x["url"], x["status"], x["html"]
        if not (isinstance(url, str) and isinstance(status, int) and not isinstance(status, bool) and isinstance(html, str | None) and -(1 << 31) <= status < 1 << 31):
            raise TypeError
    except (ValueError, KeyError, TypeError, RecursionError):
        return None, None, None, "broken"
    if status in (403, 429):
        return url, status, None, "limited"
    if not 200 <= status < 300:
        return url, status, None, "http"
    low = (html or "").lower()
    if sum(s in low for s in fixed.BLOCK_SIGNALS) >= 2:
        return url, status, None, "blocked"
    return url, status, html or "", None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes, self.prefix = local(options["path"]), int(options.get("bytes", RANGE)), options.get("url", "")
        if self.bytes < 1:
            raise ValueError("bytes must be positive")
        lists = lambda name, kind: {kind(x.strip()) for x in options[name].split(",")} if options.get(name) else None
        self.statuses, self.errors = lists("status", int), lists("error", lambda x: None if x == "none" else x)

    def passes(self, url: str | None, status: int | None, error: str | None) -> bool:
        return (self.statuses is None or status in self.statuses) and (self.errors is None or error in self.errors) and (not self.prefix or url is not None and url.startswith(self.prefix))

    def partitions(self) -> list[Range]:
        files = sorted(f for f in (glob(f"{self.path}/**", recursive=True) if os.path.isdir(self.path) else glob(self.path)) if os.path.isfile(f) and os.path.basename(f)[0] not in "._")
        if not files and not os.path.isdir(self.path):
            raise FileNotFoundError(self.path)
        sizes = [(f, os.path.getsize(f)) for f in files]
        return [Range(f, a, min(a + self.bytes, size)) for f, size in sizes for a in range(0, size, self.bytes)] or [Range("", 0, 0)]

    def lines(self, part: Range) -> Iterator[bytes]:
        """Lines that begin within the range, wherever they end."""
        if not part.file:
            return
        with open(part.file, "rb") as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < part.end and (line := f.readline()):
                at += len(line)
                if line := line.removesuffix(b"\n").removesuffix(b"\r"):
                    yield line

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("error", pa.string())])
        rows, size = [], 0
        for line in self.lines(part):
            row = record(line)
            if self.passes(row[0], row[1], row[3]):
                rows.append(row)
                size += len(line)
            if size >= SENT or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE, **tests: str) -> DataFrame:
    """Rows of an archive by the data source, those that pass tests: url, status, error."""
    spark.dataSource.register(PageArchive)
    return spark.read.format("page_archive").option("bytes", range_bytes).options(**tests).load(path)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The same rows by Spark's own reader of lines."""
    x, status = F.from_json("value", "url string, status int, html string, _bad string", {"columnNameOfCorruptRecord": "_bad"}), F.col("x.status")
    df = spark.read.text(path).filter("value <> ''").select(x.alias("x"))
    broken = F.col("x.url").isNull() | status.isNull() | F.col("x._bad").isNotNull()
    error = F.when(broken, "broken").when(status.isin(403, 429), "limited").when((status < 200) | (status >= 300), "http").when(urls.blocked(F.col("x.html")), "blocked")
    df = df.select("x", error.alias("error"))
    known = F.coalesce(F.col("error") != "broken", F.lit(True))
    return df.select(F.when(known, F.col("x.url")).alias("url"), F.when(known, F.col("x.status")).alias("status"), F.when(F.col("error").isNull(), F.coalesce("x.html", F.lit(""))).alias("html"), "error")

"""WARC files and a salvage reader.

Each page is a record, compressed as a gzip member of its own. Pages whose payloads are equal and of some length are
stored once: the one with the smallest page_id is the response, the others revisit it. The reader checks lengths and
digests; where a check fails it looks for the next place at which a member inflates to a record or a version line
begins one that holds, goes on from there, and logs the bytes between as quarantined. Records of one member are checked
one by one, and what a broken member holds before its damage is kept. Time grows with the bytes, not with the number of
version lines; only names of members that never end are read again for each.

Spark's text writer writes the files and ends each row with a zero byte. As the last byte of a gzip member is the high one
of its size, rows are members without that byte, so a file is nothing but gzip members, which any reader takes.

Defined results: null html is an empty payload; a page without page_id is never what others refer to, and revisits the
page that has one if their payloads are equal; pages that repeat the smallest page_id are all responses; null urls are
left out of the header; payloads and headers of any length are written and read whole; an empty table gives no records;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, give_back, scratch, slices, stored, views

LEAST = 100
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
#: Where a record may start.
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d+\r\n")
_VERSION = re.compile(rb"WARC/1\.\d+\r\n")
_COUNT = re.compile(r"[0-9]{1,18}")
_LINE = re.compile(rb"([^\n]*?)\r?\n")
_HEADER_END = re.compile(rb"\r\n\r\n")
#: Bytes of a row of members, about, and rows of a file: a reader's task holds one file.
FRAME_BYTES, FRAMES = 256 << 10, 128


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; a revisit has the payload's length and digest but not the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.insert(3, ("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))))
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def row(members: list[bytes]) -> bytes:
    """Members without the zero byte at their end; an empty member follows one of 16 MB or more, which ends otherwise."""
    return b"".join(members if members[-1][-1] == 0 else [*members, member(b"")])[:-1]


class Damaged(ValueError):
    pass


class Headers:
    """Headers of the places at which records may start. Places before the same end of a header share its lines, so that
    each byte is looked at once, however many version lines stand before it."""

    def __init__(self, data: bytes | memoryview, digested: bool = False):
        self.data, self.digested = data, digested
        self.first = self.stop = -1  # the lines that are known, and where the blank line begins
        #: The last line of each field: where it begins, and its value.
        self.lines: dict[str, tuple[int, str]] = {}
        self.bad = -1
        #: Fields of the last record that failed a check of its block, and how.
        self.failed: tuple[tuple, str] = ((), "")

    def at(self, at: int) -> tuple[dict[str, str], int]:
        """The fields of the record that starts here and where its header's blank line begins."""
        version = _VERSION.match(self.data, at)
        if not version:
            raise Damaged("no version line")
        if not self.first <= at < self.stop:
            self._read(version.end())
            self.first = at
        if self.stop == len(self.data):
            raise Damaged("header without end")
        if self.bad >= version.end():
            raise Damaged("header line without colon")
        return {k: v for k, (p, v) in self.lines.items() if p >= version.end()}, self.stop

    def _read(self, start: int) -> None:
        end = _HEADER_END.search(self.data, start - 2)
        self.stop, self.lines, self.bad = end.start() if end else len(self.data), {}, -1
        if not end:
            return
        for m in _LINE.finditer(self.data, start, end.start() + 2):
            name, colon, value = m[1].partition(b":")
            if colon:
                self.lines[name.decode("latin-1").lower()] = m.start(), value.strip().decode("utf-8", "replace")
            else:
                self.bad = m.start()


def parse(data: bytes | memoryview, at: int = 0, headers: Headers | None = None) -> tuple[dict, int]:
    """The record that starts here and where it ends; Damaged if a check fails."""
    headers = headers or Headers(data)
    head, stop = headers.at(at)
    key = (stop, *(head.get(k) for k in ("content-length", "warc-block-digest", "warc-payload-digest", "warc-type")))
    if headers.failed[0] == key:
        raise Damaged(headers.failed[1])
    try:
        return _checked(data, head, stop, headers.digested)
    except Damaged as e:
        headers.failed = key, str(e)
        raise


def _checked(data: bytes | memoryview, head: dict[str, str], stop: int, digested: bool) -> tuple[dict, int]:
    size = head.get("content-length", "")
    if not _COUNT.fullmatch(size):
        raise Damaged("no content length")
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record cut off or of another length")
    block = bytes(data[begin:end])
    if digested and head.get("warc-type") != "response" and not head.get("warc-block-digest", "").startswith("sha1:"):
        raise Damaged("no digest")
    if head.get("warc-block-digest", "").startswith("sha1:") and head["warc-block-digest"][5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise Damaged("block digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    lines = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise Damaged("payload digest differs")
    number = lambda k: int(x) if _COUNT.fullmatch((x := head.get(k, "").removeprefix("<urn:page:").removesuffix(">")).removeprefix("-")) else None
    told = lines.get(b"content-length", b"").decode("latin-1")
    length = int(told) if _COUNT.fullmatch(told) else len(payload)
    return {
        "page_id": number("warc-record-id"), "url": unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None, "payload_bytes": length if kind == "revisit" else len(payload),
        "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to"), "payload": payload if kind == "response" else None,
    }, end + 4


def inflate(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """What the member that starts here inflates to, where it ends, and what is wrong with it; a broken one is read as far as it goes."""
    z, parts = zlib.decompressobj(31), []
    while not z.eof:
        if at >= len(data):
            return b"".join(parts), at, "member cut off"
        before = z.copy()
        try:
            parts.append(z.decompress(data[at : at + (1 << 16)]))
        except zlib.error as e:
            for p in range(at, at + (1 << 16), 64):
                try:
                    parts.append(before.decompress(data[p : p + 64]))
                except zlib.error:
                    break
            return b"".join(parts), p, f"member doesn't inflate: {e}"
        at += 1 << 16
    return b"".join(parts), min(at, len(data)) - len(z.unused_data), ""


def salvage(content: bytes | memoryview, members: bool = True, digested: bool = False) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, fields) and ("gap", start, end, reason), in order and covering all bytes but line ends and empty members.

    A member's records are checked one by one: those that hold have the member's place, and what lies between them is a gap
    of that place, whose reason names the bytes within. Of a member that doesn't inflate a record is kept if its digest holds
    and another begins behind it; the member's bytes are a gap all the same. Without members only plain records are looked
    for; digested: only those with a digest hold.
    """
    data = memoryview(content).cast("B")
    headers, at, bad, why = Headers(data, digested), 0, None, ""
    told = 0  # up to here plain records may be those of a member that was read
    while at < len(data):
        if bad is None and data[at] in (10, 13):
            at += 1
            continue
        found, end, wrong = [], at, ""
        if members and data[at : at + 3] == MEMBER:
            plain, end, wrong = inflate(data, at)
            found = [x for x in salvage(plain, False, bool(wrong)) if not wrong or (x[0] == "record" and plain.startswith(b"WARC/1.", x[2]))]
            if wrong and found:
                told = end
        elif at < told:
            wrong = "member broken before"
        else:
            try:
                r, end = parse(data, at, headers)
                found = [("record", at, end, r)]
            except Damaged as e:
                wrong = str(e)
        if bad is not None and (found or not wrong):
            yield "gap", bad, at, why
            bad = None
        for kind, a, b, what in found:
            yield kind, at, end, what if kind == "record" or (a, b) == (at, end) else f"bytes {a} to {b} of the member: {what}"
        if not wrong:
            at = end
            continue
        if bad is None:
            bad, why = at, wrong
        start = (_START if members else _VERSION).search(data, at + 1)
        at = start.start() if start else len(data)
    if bad is not None:
        yield "gap", bad, len(data), why


def with_responses(pages: DataFrame, html: str = "html", least: int = LEAST) -> DataFrame:
    """pages with digest, size and refers_to. Only digests with several rows are looked up, hot ones dealt among salts."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.withColumns({"_body": body, "_digest": F.sha2(F.encode(body, "UTF-8"), 256), "_size": F.octet_length(body).cast("long")})
    keys = pages.select("page_id", F.sha2(F.encode(body, "UTF-8"), 256).alias("_digest"), F.octet_length(body).alias("n")).filter(F.col("n") >= least)
    first = keys.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return dealt(rows, stored(first, "firsts"), "_digest", ["page_id", "url"]).withColumn("_refers_to", refers)


def write(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """pages (page_id, url, html) as files of gzip members, one for each record; full files are followed by more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([row(parts)], pa.binary())], names=["frame"])
        for b in slices(batches, "_body"):
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "_digest", "_size", "_refers_to")]
            for page_id, url, digest, n, refers, payload in zip(*columns, views(b.column("_body")), strict=True):
                parts.append(member(record(page_id, url, bytes(payload), digest, n, refers)))
                size += len(parts[-1])
                if size >= FRAME_BYTES:
                    yield done()
                    parts, size = [], 0
        if parts:
            yield done()

    rows = with_responses(pages.select("page_id", F.col("url").cast("string").alias("url"), "html"), least=least)
    rows = rows.select("page_id", "url", "_digest", "_size", "_refers_to", "_body")
    frames = rows.mapInArrow(build, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", "\0").option("maxRecordsPerFile", FRAMES).text(folder)


SCHEMA = "file string, kind string, start long, stop long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read(spark: SparkSession, folder: str, payloads: bool = True, pattern: str = "part-*") -> DataFrame:
    """All records, and the gaps with their reasons, of the files in a folder; each file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(path: str, content: memoryview) -> Iterator[dict]:
        for kind, start, stop, what in salvage(content):
            row = dict.fromkeys(names) | {"file": path, "kind": kind, "start": start, "stop": stop}
            if kind == "gap":
                row["reason"] = what
            else:
                row |= {k: v for k, v in what.items() if k != "payload"}
                if payloads and what["payload"] is not None:
                    row["html"] = what["payload"].decode("utf-8", "replace")
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "long": pa.int64()}
        schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, SCHEMA.split(", "), strict=True)])
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), views(b.column("content")), strict=True):
                some = []
                for r in rows(path, content):
                    some.append(r)
                    if len(some) == 1000:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)
        give_back()

    return files.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and reads their records back."""
    folder = scratch(pages.sparkSession, "warc")
    write(pages, folder)
    whole = F.when(F.col("kind") != "record", F.raise_error(F.concat(F.lit("gap in a fresh archive: "), F.coalesce("reason", F.lit(""))))).otherwise(F.lit(True))
    return read(pages.sparkSession, folder, payloads=False).filter(whole)

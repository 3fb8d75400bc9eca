"""Server-sent events out of streams that arrive in chunks, cut anywhere: within a line, an event or a character.

A batch of chunks is decoded without bringing a stream together, by prefix scans over blocks of chunks, so that a task holds
a line or a row, whatever its stream's length. For events a block's chunks are read once, in order: events between its
first and last line end whose type it tells are done; its edges, its number of lines and the type that is pending behind
it are one row, and these rows meet by stream. For lines, counts of line ends are added up over blocks and within them,
and only the first and last piece of a chunk move, to meet the rest of their line. Chunks as they come are decoded with state: the tail that no line end has closed, the
pending type, and chunks that came before their turn.

A stream's chunks are numbered from 0 without gaps, each once. Lines end in a line feed, and a carriage return before it
goes; `event: ` sets the type, `data: ` is an event if it and the type that is pending aren't empty, and takes the type;
other lines change nothing. What no line end has closed is left out. Null chunks are empty; broken characters become the
replacement character.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.storage import kept

#: Rows of a block of a prefix scan.
BLOCK = 4096


def sums_before(df: DataFrame, key: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with the sum of value over the key's rows of smaller order (a number from 0). Rows of a block stay together, blocks meet by their sums."""
    df = df.withColumn("_block", F.expr(f"{order} DIV {block}"))
    blocks = df.groupBy(key, "_block").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return df.join(blocks, [key, "_block"]).withColumn(name, F.col("_ahead") + F.col("_own")).drop("_block", "_ahead", "_own")


def last_before(df: DataFrame, key: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with the value of the key's last row of smaller order whose value isn't null."""
    df = df.withColumn("_block", F.expr(f"{order} DIV {block}"))
    blocks = df.filter(F.col(value).isNotNull()).groupBy(key, "_block").agg(F.max_by(value, order).alias("_last"))
    every = df.select(key, "_block").distinct().join(blocks, [key, "_block"], "left")
    ahead = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(key, "_block", F.last("_last", ignorenulls=True).over(ahead).alias("_ahead"))
    own = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.last(value, ignorenulls=True).over(own))
    return df.join(every, [key, "_block"]).withColumn(name, F.coalesce("_own", "_ahead")).drop("_block", "_ahead", "_own")


def _text(line: Column) -> Column:
    """A line of bytes, which are characters of their value, as the text that they encode; without its carriage return."""
    return F.make_valid_utf8(F.encode(F.regexp_replace(line, "\r$", ""), "ISO-8859-1").cast("string"))


def lines(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """stream, line (from 0) and text of all whole lines of chunks (stream, seq, chunk as bytes or text)."""
    raw = F.decode(F.coalesce(F.col("chunk").cast("binary"), F.lit(b"")), "ISO-8859-1")  # a character for each byte, so cuts within one of several bytes don't matter
    df = chunks.select("stream", F.col("seq").cast("long").alias("seq"), raw.alias("raw")).withColumn("ends", F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit(""))))
    df = sums_before(df, "stream", "seq", "ends", "first", block)
    parts = df.select("stream", "seq", "first", "ends", F.posexplode(F.split("raw", "\n", -1)).alias("nth", "piece"))
    parts = parts.withColumn("line", F.col("first") + F.col("nth"))
    inner = parts.filter("nth > 0 AND nth < ends").select("stream", "line", "piece")
    edges = parts.filter("nth = 0 OR nth = ends").groupBy("stream", "line").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("pieces"), F.bool_or(F.col("nth") < F.col("ends")).alias("closed"))
    edges = edges.filter("closed").select("stream", "line", F.array_join(F.col("pieces.piece"), "").alias("piece"))
    return inner.unionByName(edges).select("stream", "line", _text(F.col("piece")).alias("text"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's chunks in order: the events whose type the block tells, and a row for what it leaves open, its edges and the first event without a type."""
    key, out = None, []

    def begin() -> None:
        nonlocal head, tail, ends, pending, early
        head, tail, ends, pending, early = None, [], 0, None, (None, None)

    def take(line: bytes) -> None:
        nonlocal pending, early
        if line.startswith(b"event: "):
            pending = _decoded(line)[7:]
        elif line.startswith(b"data: "):
            data = _decoded(line)[6:]
            if pending is None:
                early = ends, data
            elif pending and data:
                out.append((*key, ends, pending, data, *[None] * 6))
            pending = ""

    def finish() -> None:
        out.append((*key, None, None, None, head, b"".join(tail), ends, pending, *early))

    head, tail, ends, pending, early = None, [], 0, None, (None, None)
    schema = None
    for b in batches:
        schema = schema or pa.schema([pa.field("stream", b.schema.field("stream").type), *_OPEN])
        own = [b.column(c).to_pylist() for c in ("stream", "block", "chunk")]
        for k, rows in groupby(zip(*own, strict=True), key=lambda r: r[:2]):
            if k != key:
                if key is not None:
                    finish()
                key = k
                begin()
            data = b"".join([r[2] or b"" for r in rows])
            if b"\n" not in data:
                tail.append(data)
                continue
            *whole, last = (b"".join(tail) + data).split(b"\n")
            tail = [last]
            for line in whole:
                if head is None:
                    head = line
                else:
                    take(line)
                ends += 1
        if out:
            yield _batch(out, schema)
            out = []
    if key is not None:
        finish()
        yield _batch(out, schema)


_LONG, _TEXT, _BYTES = pa.int64(), pa.string(), pa.binary()
_OPEN = [pa.field(n, t) for n, t in (("block", _LONG), ("nth", _LONG), ("event", _TEXT), ("data", _TEXT), ("head", _BYTES), ("tail", _BYTES), ("ends", _LONG), ("pending", _TEXT), ("early", _LONG), ("early_data", _TEXT))]
_MET = [pa.field(n, t) for n, t in (("block", _LONG), ("first", _LONG), ("line", _LONG), ("event", _TEXT), ("data", _TEXT))]


def _decoded(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stream's blocks in order: the number of each one's first line, and the events that their edges make."""
    stream, some = None, False
    tail, pending, first = [], "", 0
    for b in batches:
        schema, out = pa.schema([pa.field("stream", b.schema.field("stream").type), *_MET]), []
        for own, block, head, rest, ends, last, early, early_data in zip(*(b.column(c).to_pylist() for c in ("stream", "block", "head", "tail", "ends", "pending", "early", "early_data")), strict=True):
            if not some or own != stream:
                stream, some, tail, pending, first = own, True, [], "", 0
            out.append((own, block, first, None, None, None))
            if ends:
                line = _decoded(b"".join(tail) + head)
                if line.startswith("data: "):
                    if pending and line[6:]:
                        out.append((own, None, None, first, pending, line[6:]))
                    pending = ""
                elif line.startswith("event: "):
                    pending = line[7:]
                if early is not None and pending and early_data:
                    out.append((own, None, None, first + early, pending, early_data))
                pending, tail, first = pending if last is None else last, [], first + ends
            tail.append(rest)
        if out:
            yield _batch(out, schema)


def events(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """stream, line, event and data of all whole events of chunks (stream, seq, chunk).

    Chunks move once, to their block, which is read from its first to its last; what blocks leave open is a row each.
    """
    df = chunks.select("stream", F.expr(f"CAST(seq AS BIGINT) DIV {block}").alias("block"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    typed = lambda fields: T.StructType([chunks.schema["stream"], *(T.StructField(f.name, {_LONG: T.LongType(), _TEXT: T.StringType(), _BYTES: T.BinaryType()}[f.type]) for f in fields)])
    found = kept(df.repartition("stream", "block").sortWithinPartitions("stream", "block", "seq").mapInArrow(_scan, typed(_OPEN)), "scanned")
    blocks = found.filter("ends IS NOT NULL").select("stream", "block", "head", "tail", "ends", "pending", "early", "early_data")
    met = kept(blocks.repartition("stream").sortWithinPartitions("stream", "block").mapInArrow(_meet, typed(_MET)), "met")
    inner = found.filter("event IS NOT NULL").join(met.filter("block IS NOT NULL").select("stream", "block", "first"), ["stream", "block"])
    return inner.select("stream", (F.col("first") + F.col("nth")).alias("line"), "event", "data").unionByName(met.filter("line IS NOT NULL").select("stream", "line", "event", "data"))


class Decoder(StatefulProcessor):
    """Chunks (stream, seq, chunk) of streams as they come; what comes too early waits for its turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "seq long, line long, event string, tail binary")
        self.early = handle.getMapState("early", "seq long", "chunk binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        seq, line, event, tail = self.state.get() if self.state.exists() else (0, 0, "", b"")
        tail, out = bytearray(tail), []
        for batch in rows:
            for s, c in zip(batch["seq"].tolist(), batch["chunk"].tolist(), strict=True):
                if s > seq:
                    self.early.updateValue((s,), (bytes(c or b""),))
                while s == seq:
                    tail += c or b""
                    *whole, last = tail.split(b"\n")
                    tail = bytearray(last)
                    for x in whole:
                        text = bytes(x).removesuffix(b"\r").decode("utf-8", "replace")
                        if text.startswith("event: "):
                            event = text[7:]
                        elif text.startswith("data: "):
                            if event and text[6:]:
                                out.append((key[0], line, event, text[6:]))
                            event = ""
                        line += 1
                    seq += 1
                    if self.early.containsKey((seq,)):
                        s, c = seq, self.early.getValue((seq,))[0]
                        self.early.removeKey((seq,))
        self.state.update((seq, line, event, bytes(tail)))
        yield pd.DataFrame(out, columns=["stream", "line", "event", "data"])

    def close(self) -> None:
        pass


def decoded(chunks: DataFrame) -> DataFrame:
    """events of a stream of chunks (stream as text, seq, chunk), in any order and over any number of batches."""
    df = chunks.select(F.col("stream").cast("string").alias("stream"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    return df.groupBy("stream").transformWithStateInPandas(Decoder(), "stream string, line long, event string, data string", "append", "none")

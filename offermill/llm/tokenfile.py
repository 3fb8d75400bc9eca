"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A file holds frames; a frame holds the ids of consecutive documents one after another, and their boundaries and doc_ids
as Elias-Fano sequences: the low bits of each number in an array, the high ones in unary in a bit vector, with the place
of every 256th one sampled, so that any boundary is found in near-minimal space without a table of 64-bit offsets. Each
frame says in which part it is and how many ids come before it there, and ends with a checksum. Frames are short, line
feeds in them are escaped and one ends each frame, so Spark's readers split files of any size and no task holds a file.
Spark's own writers and readers are used, so files go wherever the cluster keeps files, and a task that is lost and run
again leaves one file.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows that repeat, or share a doc_id,
are each written, in order of their ids; a text of any length is one document, in a frame of its own if it is long; an
empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ENCODE_BYTES, decoded, encoder, vocabulary
from .common import give_back, scratch, slices, views

MAGIC = b"EFTOKEN1"
SAMPLE = 256
#: Ids in a frame, about; a longer document is a frame by itself.
FRAME_IDS = 1 << 17
#: Text bytes whose ids go to one part, about, and the parts, at most: their borders are quantiles of doc_id.
PART_BYTES, PARTS = 64 << 20, 4096


class EliasFano:
    """A sequence of n numbers that do not fall, from 0 to the universe."""

    HEAD = struct.Struct("<QQBQQ")

    def __init__(self, buffer: bytes | memoryview, at: int = 0):
        self.n, self.universe, self.low, self.low_bytes, self.high_bytes = self.HEAD.unpack_from(buffer, at)
        at += self.HEAD.size
        self.lows = np.frombuffer(buffer, np.uint8, self.low_bytes, at)
        at += self.low_bytes
        self.highs = np.frombuffer(buffer, np.uint8, self.high_bytes, at)
        at += self.high_bytes
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(buffer, "<u8", count, at)
        self.end = at + 8 * count

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n, universe = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        lows = b""
        if low:
            bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
            lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (universe >> low) + 1, np.uint8)
        bits[ones] = 1
        highs = np.packbits(bits, bitorder="little").tobytes()
        return cls.HEAD.pack(n, universe, low, len(lows), len(highs)) + lows + highs + ones[::SAMPLE].astype("<u8").tobytes()

    def _lows(self, start: int, stop: int) -> np.ndarray:
        if not self.low:
            return np.zeros(stop - start, np.uint64)
        first = start * self.low // 8
        bits = np.unpackbits(self.lows[first : (stop * self.low + 7) // 8], bitorder="little")
        bits = bits[start * self.low - first * 8 :][: (stop - start) * self.low].reshape(-1, self.low)
        return (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        return (((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | self._lows(0, self.n)).astype(np.int64)

    def select(self, i: int) -> int:
        """Number i, from the sampled one before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, need, width = int(self.samples[i // SAMPLE]), i % SAMPLE, 64
        base = at
        while True:
            bits = np.unpackbits(self.highs[base // 8 : base // 8 + width], bitorder="little")[base % 8 :]
            ones = np.flatnonzero(bits)
            if len(ones) > need:
                return (base + int(ones[need]) - i << self.low) | int(self._lows(i, i + 1)[0])
            width *= 4


HEAD = struct.Struct("<8sQIQQQQqB")


def frame(part: int, first: int, ids: list[np.ndarray], keys: list[int | None], width: int) -> bytes:
    """One frame: documents in order, null keys first. first: the ids of the part before it."""
    none = sum(k is None for k in keys)
    real = np.array([k for k in keys if k is not None], np.int64)
    least = int(real[0]) if len(real) else 0
    ends = np.cumsum([len(x) for x in ids])
    body = EliasFano.encode(ends) + EliasFano.encode((real - least).astype(np.uint64)) + np.concatenate(ids).astype(f"<u{width}").tobytes()
    head = HEAD.pack(MAGIC, HEAD.size + len(body) + 4, part, first, len(ids), int(ends[-1]), none, least, width)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def escaped(data: bytes) -> bytes:
    """Without line feeds."""
    return data.replace(b"\x1b", b"\x1b\x01").replace(b"\n", b"\x1b\x02")


def plain(line: bytes) -> bytes:
    return line.replace(b"\x1b\x02", b"\n").replace(b"\x1b\x01", b"\x1b")


class Frame:
    """A frame as it was read: boundaries are found on demand, ids are a view."""

    def __init__(self, buffer: bytes | memoryview, at: int = 0):
        magic, self.size, self.part, self.first, self.n_docs, self.n_ids, self.n_null, self.least, self.width = HEAD.unpack_from(buffer, at)
        if magic != MAGIC or zlib.crc32(buffer[at : at + self.size - 4]) != struct.unpack_from("<I", buffer, at + self.size - 4)[0]:
            raise ValueError("damaged frame")
        self.ends = EliasFano(buffer, at + HEAD.size)
        self._keys = EliasFano(buffer, self.ends.end)
        self.ids = np.frombuffer(buffer, f"<u{self.width}", self.n_ids, self._keys.end)

    def keys(self) -> list[int | None]:
        return [None] * self.n_null + (self._keys.all().astype(np.int64) + self.least).tolist()

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i's ids start and end, without reading the others'."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def counted(line: bytes) -> tuple[int, int]:
    """The part and the number of ids of a frame, from its escaped head."""
    head = HEAD.unpack_from(plain(line))
    return head[2], head[5]


def write(docs: DataFrame, folder: str, end: int = 2, text: str = "text", doc_id: str = "doc_id", path: str | None = None, parts: int | None = None) -> None:
    """Files of the ids of every text with the end id, in ascending order of doc_id over all files.

    Texts are encoded where they are read; only ids move, two bytes each for vocabularies that fit. parts: by the bytes
    of all texts unless given.
    """
    path = path or vocabulary()
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    parts = parts or min(PARTS, 1 + (source.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // PART_BYTES)
    at = source.agg(F.percentile_approx("d", [(i + 1) / parts for i in range(parts - 1)], 20 * parts)).first()[0] if parts > 1 else None
    borders = np.array(at or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        width = 2 if max(e.library.get_vocab_size(), end + 1) <= 1 << 16 else 4
        tail = np.array([end], f"<u{width}").tobytes()
        for b in slices(batches, "t", ENCODE_BYTES):
            flat, at = e.encode(decoded(views(b.column("t"))))
            flat, at = flat.astype(f"<u{width}"), at.tolist()
            key = b.column("d")
            part = np.where(np.asarray(key.is_null()), 0, np.searchsorted(borders, key.fill_null(0).to_numpy(), "left"))
            ids = [flat[x:y].tobytes() + tail for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([key, pa.array(part.astype(np.int32)), pa.array(ids, pa.binary())], names=["d", "part", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if max(encoder(path).library.get_vocab_size(), end + 1) <= 1 << 16 else 4
        ids, keys, size, part, before = [], [], 0, 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([escaped(frame(part, before, ids, keys, width))], pa.binary())], names=["frame"])
        for b in slices(batches, "ids", 2 * FRAME_IDS):
            for d, p, x in zip(b.column("d").to_pylist(), b.column("part").to_pylist(), views(b.column("ids")), strict=True):
                x = np.frombuffer(x, f"<u{width}")
                if ids and (size + len(x) > FRAME_IDS or p != part):
                    yield done()
                    before = before + size if p == part else 0
                    ids, keys, size = [], [], 0
                ids.append(x.copy())
                keys.append(d)
                size, part = size + len(x), p
        if ids:
            yield done()

    ids = source.mapInArrow(encode, "d long, part int, ids binary")
    ordered = ids.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("d"), "ids")
    ordered.mapInArrow(build, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(folder).select(F.col("value").cast("binary").alias("frame"))


def manifest(spark: SparkSession, folder: str) -> dict[int, int]:
    """How many ids come before each part, from the heads of the frames; the driver learns one number a part."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counted(x.tobytes()) for x in views(b.column("head"))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], names=["part", "n"])

    found = _lines(spark, folder).select(F.substring("frame", 1, 2 * HEAD.size).alias("head")).mapInArrow(heads, "part int, n long")
    sizes = sorted(map(tuple, found.groupBy("part").agg(F.sum("n")).collect()))
    return dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))


def read(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    before = manifest(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for line in views(b.column("frame")):
                f = Frame(plain(line.tobytes()))
                base = before[f.part] + f.first
                ends = f.ends.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = f.ids.astype("<u4")
                crc = [zlib.crc32(wide[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(f.keys(), pa.int64()), pa.array(base + starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.array([wide[x:y].astype(np.int32) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        give_back()

    return _lines(spark, folder).mapInArrow(decode, schema)


def round_trip(docs: DataFrame, end: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    folder = scratch(docs.sparkSession, "tokens")
    write(docs, folder, end, path=path)
    return read(docs.sparkSession, folder)

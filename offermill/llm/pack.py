"""Best-fit packing by minimum bin slack.

Pieces of equal length are alike, so a plan needs only how many there are of each length, at most as many numbers as a
sequence has places, whatever the corpus. Per bin the longest piece left is set, and subset sums over the lengths left,
as bits of one integer, find the fullest feasible combination with it, longer pieces first; it is removed as many times
as it fits whole. A piece then finds its sequence and offset from its length and its rank within that length.

Defined results: a null or empty text is the end id alone; only documents longer than a sequence are cut, their first
piece taking what is left over; repeated rows are packed each; an empty table gives no rows. Null doc_ids are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ENCODE_BYTES, decoded, encoder, vocabulary
from .common import slices, stored, views, without

CAPACITY = 2048
#: Rows that are ranked in one group, about: a length that many pieces share is ranked in so many parts.
RANKED = 500_000


def cut_tokens(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, text: str = "text", doc_id: str = "doc_id", path: str | None = None, ids: bool = False) -> DataFrame:
    """Each document's ids with the end id, in pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = path or vocabulary()
    key = docs.schema[doc_id]
    fields = [T.StructField("doc_id", key.dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in slices(batches, "t", ENCODE_BYTES):
            flat, at = encode(decoded(views(b.column("t"))))
            n = np.diff(at) + 1
            pieces = np.maximum(1, -(-n // capacity))
            first = n - (pieces - 1) * capacity
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            crc, own = [], []
            flat = flat.astype("<u4")
            tail = np.array([end], "<u4")
            for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                x = flat[at[d] + s : min(at[d] + s + m, at[d + 1])]
                if s + m == n[d]:
                    x = np.concatenate([x, tail])
                crc.append(zlib.crc32(x.tobytes()))
                if ids:
                    own.append(x.astype(np.int32))
            columns = [b.column("d").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                columns.append(pa.array(own, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(run, T.StructType(fields))


class Plan:
    """Which lengths go together: each pattern is so many sequences that hold the same lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        left = {n: c for n, c in counts.items() if c > 0}
        if left and not 0 < min(left) <= max(left) <= capacity:
            raise ValueError("a piece is longer than a sequence, or empty")
        order = sorted(left, reverse=True)
        taken = dict.fromkeys(order, 0)
        self.sequences, rows = 0, []
        while order:
            used = _fullest(order, left, capacity)
            times = min(left[n] // k for n, k in used)
            offset = 0
            for n, k in used:
                rows.append((n, taken[n], k, self.sequences, offset))
                taken[n] += k * times
                left[n] -= k * times
                offset += n * k
            self.sequences += times
            if any(not left[n] for n, _ in used):
                order = [n for n in order if left[n]]
        rows.sort()
        self.length, self.rank, self.each, self.base, self.offset = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [[]] * 5))
        self.key = (self.length << np.int64(44)) | self.rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of the piece with each rank among those of its length."""
        at = np.searchsorted(self.key, (length << np.int64(44)) | rank, "right") - 1
        copy, slot = np.divmod(rank - self.rank[at], self.each[at])
        return self.base[at] + copy, self.offset[at] + slot * length


def _fullest(order: list[int], left: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The longest length left, and of the others what fills the sequence most; longer ones are preferred."""
    seed = order[0]
    room = capacity - seed
    mask, reach, states = (1 << (room + 1)) - 1, 1, []
    for n in order:
        if n > room or reach >> room & 1:
            if n > room:
                continue
            break
        before = reach
        c = min(left[n] - (n == seed), room // n)
        step = 1
        while c > 0:
            k = min(step, c)
            reach |= reach << (k * n) & mask
            c -= k
            step *= 2
        states.append((n, before))
    total = reach.bit_length() - 1
    used = {seed: 1}
    for n, before in reversed(states):
        while not before >> total & 1:
            used[n] = used.get(n, 0) + 1
            total -= n
    return sorted(used.items(), reverse=True)


NEW = [("sequence_id", T.LongType()), ("offset", T.LongType())]


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read twice, so it should be a stored table.

    The driver gets one number for each length. Rows of a length are ranked in parts, as many as RANKED pieces each need.
    Without order columns, rows are ranked by all their columns. Columns with the new names are replaced.
    """
    pieces = without(pieces, [n for n, _ in NEW] + ["_part", "_rank", "_before"])
    spark, total = pieces.sparkSession, pieces.count()
    parts = int(max(16, total // RANKED))
    order = tuple(c for c in order if c in pieces.columns) or tuple(pieces.columns)
    split = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = stored(split.groupBy(length, "_part").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    shared = spark.sparkContext.broadcast(Plan({r[0]: r[1] for r in sizes.groupBy(length).agg(F.sum("_n")).collect()}, capacity))
    earlier = Window.partitionBy(length).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(length, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            n, rank, first = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_rank", "_before"))
            sequence, offset = plan.place(n, first + rank - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, *(c for c, _ in NEW)])

    kept = pieces.columns
    ranked = split.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_part").orderBy(*order))).join(before, [length, "_part"])
    return ranked.mapInArrow(run, T.StructType([*pieces.schema.fields, *(T.StructField(n, t) for n, t in NEW)]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """Every document's pieces with their place in the sequences."""
    return pack(stored(cut_tokens(docs, capacity, end, text, path=path, ids=ids), "pieces"), capacity, order=("doc_id", "piece", "start", "ids_crc32"))

"""What the operators share: Arrow buffers, slices of bounded size, hashing and scratch tables."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; a longer text is a step by itself.
STEP_BYTES = 4 << 20


#: A key with more than one in so many of the rows is hot: so fewer than so many keys are.
SPREAD = 1000


pa.set_memory_pool(pa.system_memory_pool())
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, which else follows the largest block that was freed
    _LIBC.mallopt(-1, 512 << 20)  # M_TRIM_THRESHOLD: within a task memory is kept and used again
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def give_back() -> None:
    """Workers outlive tasks, so what a task freed goes back to the system."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names; a temporary one only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="offermill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors lose none of it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs within the block hands Python batches of about size bytes, one row at least. Spark's own limit is 10,000 rows
    and 64 MB, which a task holds outside the heap and its worker again; it holds after the block."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of about limit bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def views(column: pa.Array) -> list[memoryview]:
    """Each value's bytes without copying; null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return []
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    mem = memoryview(data) if data is not None else memoryview(b"")
    none = column.is_null().to_pylist() if column.null_count else None
    return [mem[:0] if none and none[i] else mem[at[i] : at[i + 1]] for i in range(len(column))]


MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, to spread polynomial hashes over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX1
    x ^= x >> np.uint64(29)
    x *= MIX2
    x ^= x >> np.uint64(32)
    return x


def digests(values: Iterable[bytes | memoryview]) -> np.ndarray:
    """128 bits that stand for each value, as two numbers a row."""
    return np.frombuffer(b"".join([hashlib.blake2b(v, digest_size=16).digest() for v in values]), np.uint64).reshape(-1, 2)


class Rolling:
    """Polynomial hashes of any substring from prefix sums modulo 2**64; equal strings have equal hashes anywhere.

    Unlike strings can be made that share such a hash, so it chooses places and candidates but never tells identity.
    """

    BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse
    INVERSE = pow(BASE, -1, 1 << 64)
    power = inverse = np.empty(0, np.uint64)
    #: One fixed odd-looking 64-bit number for each byte value, by a rule.
    BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.power) < n:
            m = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                for name, base in (("power", cls.BASE), ("inverse", cls.INVERSE)):
                    x = np.full(m, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.cumprod(x))

    def __init__(self, values: np.ndarray):
        n, self.data = len(values), values
        self.grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        x = self.BYTES[values]
        np.multiply(x, self.power[:n], out=x)
        np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """The hashes of all substrings of k symbols."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        x = self.sums[k:] - self.sums[:n]
        x *= self.inverse[:n]
        x += np.uint64(k)
        return mix(x)


def rows_of(data: bytes, offsets: np.ndarray) -> pa.Array:
    """The strings between neighbouring offsets, without copying."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def strings(column: pa.Array) -> list[bytes]:
    """The values of an array that rows_of or its dictionary made."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]  # noqa: B905, RUF007


def dealt(rows: DataFrame, values: DataFrame, key: str, lot: list[str]) -> DataFrame:
    """rows left-joined by key with values, a stored table of one row a key and _n, the rows that have it.

    Keys with more than one in SPREAD of all rows are dealt among as many salts as they are such parts, by a hash of the
    columns of lot; only those, fewer than SPREAD, are broadcast, to tell how many salts a row's key has.
    """
    total = values.agg(F.sum("_n")).first()[0] or 0
    share = max(1, total // SPREAD)
    salts = F.when(F.col("_n") > share, F.ceil(F.col("_n") / share)).otherwise(1).cast("int")
    values = values.withColumn("_salts", salts)
    hot = F.broadcast(values.filter("_salts > 1").select(key, "_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*lot), F.col("_salts")).cast("int"), F.lit(0))
    spread = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", "_n")
    return rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts").join(spread, [key, "_salt"], "left").drop("_salt")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])

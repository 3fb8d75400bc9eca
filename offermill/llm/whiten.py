"""Whitening of vectors by an exact integer scatter.

Entries become integers, x = floor(64 c) + 1000000. A shift (the offset itself) is subtracted, and sums and cross-products
are added up exactly: a block's products are of digits small enough that matrix products of doubles hold them without
rounding, and digits of the totals are added by Spark, cell by cell, whatever their size. From the totals n X'X - S S' is
formed in integers; only then is it divided by n^2, rounded once, and decomposed by eigh.

Defined results: null vectors and those with null or non-finite entries have no row, and neither have vectors of another
dimension than most have (ties: the larger one) or with an entry too large for x to be a long; repeated rows and rows
without vec_id are rows like others and count in the fit; a component whose eigenvalue is 0 but for rounding has null
whitened values; an empty table has no rows. Columns but vec_id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block: with digits below 2**DIGIT in size, its products stay below 2**53.
BLOCK, DIGIT = 4096, 20
#: Totals are sent as digits of so many bits, so that millions of tasks add up within a long.
SENT = 40


def integers(column: pa.Array, size: int) -> np.ndarray:
    """x without the offset, for vectors that have x."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.floor(values * SCALE).astype(np.int64)


def usable(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and v (doubles) of the rows that take part, and their dimension."""
    v = F.col(vector).cast("array<double>")
    limit = float(1 << 62)
    fine = F.forall(v, lambda c: c.isNotNull() & (F.abs(c * SCALE) < limit))  # false for NaN, which is above all numbers
    rows = vectors.select(F.col("vec_id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)) & (F.size(v) > 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    return rows.filter(F.size("v") == size), size


class Scatter:
    """Exact sums and cross-products, as int64 digits of 2**DIGIT by place."""

    def __init__(self, size: int):
        self.size, self.n, self.places = size, 0, []

    def add(self, y: np.ndarray) -> None:
        """Rows of integers, with a column of ones so that sums are products too."""
        for a in range(0, len(y), BLOCK):
            part = np.concatenate([y[a : a + BLOCK], np.ones((len(y[a : a + BLOCK]), 1), np.int64)], axis=1)
            digits, rest = [], part
            while rest.any() or not digits:
                low = ((rest + (1 << DIGIT - 1)) & ((1 << DIGIT) - 1)) - (1 << DIGIT - 1)
                digits.append(low.astype(np.float64))
                rest = (rest - low) >> DIGIT
            for i, x in enumerate(digits):
                for j, z in enumerate(digits):
                    self._put(i + j, (x.T @ z).astype(np.int64))
            self.n += len(part)

    def _put(self, place: int, value: np.ndarray) -> None:
        while len(self.places) <= place:
            self.places.append(np.zeros((self.size + 1, self.size + 1), np.int64))
        self.places[place] += value
        if (np.abs(self.places[place]) >= 1 << 60).any():
            carry = self.places[place] >> SENT
            self.places[place] -= carry << SENT
            self._put(place + SENT // DIGIT, carry)

    def cells(self) -> Iterator[pa.RecordBatch]:
        """i, j, place and digit of the upper triangle's nonzero digits of 2**SENT; places count DIGIT bits."""
        i, j = np.triu_indices(self.size + 1)
        for place, x in enumerate(self.places):
            high = x[i, j] >> SENT
            for p, d in ((place, x[i, j] - (high << SENT)), (place + SENT // DIGIT, high)):
                some = np.flatnonzero(d)
                yield pa.RecordBatch.from_arrays([pa.array(i[some].astype(np.int32)), pa.array(j[some].astype(np.int32)), pa.array(np.full(len(some), p, np.int32)), pa.array(d[some])], names=["i", "j", "place", "digit"])


def scatter(rows: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of x less the offset, and n X'X - S S', in integers. What reaches the driver grows with the dimension alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scatter(size)
        for b in batches:
            if b.num_rows:
                own.add(integers(b.column("v"), size))
        yield from own.cells()
        give_back()

    cells = rows.select("v").mapInArrow(run, "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum("digit").alias("digit"))
    total = [[0] * (size + 1) for _ in range(size + 1)]
    for i, j, place, digit in cells.collect():
        total[i][j] += digit << DIGIT * place
    n, sums = total[size][size], [total[i][size] for i in range(size)]
    return n, sums, [[n * total[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(size)] for i in range(size)]


class Whitener:
    """Components of vectors by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], scatter_: list[list[int]], components: int = COMPONENTS):
        square = n * n
        covariance = np.array([[x / square for x in row] for row in scatter_])  # a quotient of integers is rounded once
        self.n, self.sums, self.trace = n, sums, sum(scatter_[i][i] for i in range(len(sums))) / square
        e, v = np.linalg.eigh(covariance)
        order = np.argsort(-e, kind="stable")[:components]
        self.values, self.vectors = e[order], np.ascontiguousarray(v[:, order])
        self.zero = self.values <= max(self.trace, 0.0) * len(sums) * np.finfo(float).eps
        with np.errstate(divide="ignore", invalid="ignore"):
            self.explained = np.where(self.trace > 0, self.values / self.trace, 0.0)
            self.weights = np.where(self.zero, 0.0, self.vectors / np.sqrt(np.where(self.zero, 1.0, self.values)))

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 where that holds it, else Python's integers."""
        most = max(int(np.abs(y).max(initial=0)) * self.n, *(abs(s) for s in self.sums))
        if most < 1 << 61:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, centred: np.ndarray) -> list[int]:
        if centred.dtype != object and (not centred.size or int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63):
            return (centred * centred).sum(axis=1).tolist()
        return [sum(int(c) * int(c) for c in row) for row in centred]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.weights


def identity_error(rows: DataFrame, size: int, own: Whitener, parts: int = 64) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity. Tasks' moments are merged by groups, then once more."""
    m = int((~own.zero).sum())

    def merged(moments: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, co = 0, np.zeros(m), np.zeros((m, m))
        for k, other, more in moments:
            if k:
                d = other - mean
                co = co + more + np.outer(d, d) * (n * k / (n + k))
                n, mean = n + k, mean + d * (k / (n + k))
        return n, mean, co

    def packed(x: tuple[int, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), pa.array([np.concatenate([x[1], x[2].ravel()]).tolist()], pa.list_(pa.float64()))], names=["n", "moments"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for b in batches:
            for k, x in zip(b.column("n").to_pylist(), b.column("moments").to_pylist(), strict=True):
                yield k, np.array(x[:m]), np.array(x[m:]).reshape(m, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for b in batches:
                if b.num_rows:
                    w = own.project(own.centred(integers(b.column("v"), size)))[:, ~own.zero]
                    yield len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0))

        yield packed(merged(each()))

    schema = "n long, moments array<double>"
    first = rows.select("v").mapInArrow(run, schema).withColumn("part", F.spark_partition_id() % parts)
    few = first.repartition(parts, "part").select("n", "moments").mapInArrow(lambda batches: iter([packed(merged(unpacked(batches)))]), schema).collect()
    n, _, co = merged((r.n, np.array(r.moments[:m]), np.array(r.moments[m:]).reshape(m, m)) for r in few)
    return float(np.abs(co / n - np.eye(m)).max()) if n and m else 0.0


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error, a row for each component of each vector."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows, size = usable(vectors.withColumn("vec_id", F.col("vec_id").cast("long")), vector)
    if not size:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = stored(rows, "vectors")  # what the fit has counted is what is returned
    own = Whitener(*scatter(rows, size), components)
    error = identity_error(rows, size, own)
    m = len(own.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                k, centred = part.num_rows, own.centred(integers(part.column("v"), size))
                deviation = pc.cast(pa.array([str(d) for d in own.deviations(centred)]), pa.decimal128(38, 0))
                whitened = pa.array(own.project(centred).ravel(), mask=np.tile(own.zero, k))
                each = lambda x: x.take(pa.array(np.repeat(np.arange(k), m)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([each(part.column("vec_id")), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, own.n)), each(deviation), whitened, pa.array(np.tile(own.explained, k)), pa.array(np.full(k * m, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)

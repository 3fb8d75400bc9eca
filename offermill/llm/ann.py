"""Nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of several codebooks, each of full dimension. The codebooks are
learned on a bounded sample: residual k-means first, then beam-search coding and least squares for all codewords at once
by turns. Every row is coded by beam search and keeps its code, the norm of what the code stands for and how far that is
from the row. A query's table of products with all codewords then scores a row by lookups, and the best scored vectors of
each block of rows are compared exactly. What is left is compared too unless the score and the code's error say, by the
triangle inequality, that it is farther than the k nearest so far: no row is left out for a list's length, so recall
is 1 whatever the vectors, and what the codes spare is time alone. Rows are stored in the order of their codes, so a block
holds like vectors; a query passes over blocks that are farther as a whole than its k nearest of the sample or so far.
Copies of a vector are scored once a block, and stand for as many rows as an answer can need, those with the smallest
vec_ids: however many there are, ties between them are exact.

Defined results: vectors that are null, zero, of another dimension than most, or hold null or non-finite components take
no part, nor do rows without vec_id; rows that repeat the query's vec_id are not its neighbours, and it is searched once, by
the least of their vectors in the order of arrays; other repeated rows are each a candidate; ties go to the smaller
vec_id; with fewer candidates than asked for, all are returned; an empty table gives no rows; columns other than the
vector and its id are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

BOOKS, WORDS, BEAM = 16, 64, 6
#: Vectors that the codebooks are learned on, at most, and rounds of learning.
SAMPLE, ROUNDS = 4096, 2
#: Queries in one pass over the index; the driver and each task hold one such block.
QUERY_BLOCK = 4096
#: Rows and queries that are scored at once. Of such a block of rows the best scored, a few more than the answer needs, are
#: compared first, to know how far the rest may be.
ROW_BLOCK, QUERY_STEP, FIRST = 4096, 256, 3
#: Bytes of vectors in a part of the index.
PART_BYTES = 64 << 20


class Codebooks:
    def __init__(self, x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, rounds: int = ROUNDS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.beam = beam
        words = max(1, min(words, len(x)))
        self.c = np.zeros((books, words, x.shape[1]), np.float32)
        rest = x.astype(np.float32).copy()
        for m in range(books):
            c = rest[rng.choice(len(rest), words, replace=False)]
            for _ in range(6):
                near = self._nearest(rest, c)
                count = np.bincount(near, minlength=words)
                order = np.argsort(near, kind="stable")
                has = np.flatnonzero(count)
                sums = np.add.reduceat(rest[order], np.cumsum(count)[has] - count[has])
                c = c.copy()
                c[has] = sums / count[has, None]
            self.c[m] = c
            rest -= c[self._nearest(rest, c)]
        for _ in range(rounds):
            codes = self.encode(x)
            one_hot = np.zeros((len(x), books * words), np.float32)
            for m in range(books):
                one_hot[np.arange(len(x)), m * words + codes[:, m].astype(np.int64)] = 1
            gram = one_hot.T @ one_hot + 0.1 * np.eye(books * words, dtype=np.float32)
            # ridge towards the present codewords, so that unused ones stay
            right = one_hot.T @ x.astype(np.float32) + 0.1 * self.c.reshape(books * words, -1)
            self.c = np.linalg.solve(gram.astype(np.float64), right.astype(np.float64)).astype(np.float32).reshape(self.c.shape)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by beam search: after each codebook the partial sums that leave least stay."""
        out = np.empty((len(x), len(self.c)), np.uint8)
        for a in range(0, len(x), 2048):
            out[a : a + 2048] = self._beam(x[a : a + 2048].astype(np.float32))
        return out

    def _beam(self, x: np.ndarray) -> np.ndarray:
        n, words = len(x), self.c.shape[1]
        rest = x[:, None, :]
        left = (x * x).sum(axis=1)[:, None]
        codes = np.empty((n, 1, 0), np.uint8)
        for c in self.c:
            error = left[:, :, None] - 2 * (rest @ c.T) + (c * c).sum(axis=1)
            flat = error.reshape(n, -1)
            k = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, k - 1, axis=1)[:, :k]
            row, word = best // words, best % words
            left = np.take_along_axis(flat, best, 1)
            rest = np.take_along_axis(rest, row[:, :, None], 1) - c[word]
            codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), left.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.c[m][codes[:, m]].astype(np.float64) for m in range(len(self.c)))

    def reach(self) -> float:
        """No sum of codewords, whole or in part, is longer."""
        return float(np.sqrt((self.c.astype(np.float64) ** 2).sum(axis=2)).max(axis=1).sum())

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with each codeword: books, words, queries."""
        return self.c @ queries.astype(np.float32).T


def scores(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """For each query and row, the squared distance without the query's own norm."""
    total = tables[0][codes[:, 0]]
    for m in range(1, len(tables)):
        total += tables[m][codes[:, m]]
    total *= np.float32(-2)
    total += norms[:, None]
    return total.T


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and v, as doubles, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("v") == (sizes[0] if sizes else 0))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows that stand side by side; squares are added in the order of dimensions, as SQL does."""
    return np.sqrt(np.cumsum((x - y) ** 2, axis=-1)[..., -1])


def index(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Codebooks | None]:
    """A stored table of vec_id, v, code, norm and miss (how far the code is from the vector) of every row, like codes
    together, and the codebooks, which keep the sample."""
    total = rows.count()
    if not total:
        return rows.withColumns({"code": F.lit(None).cast("binary"), "norm": F.lit(None).cast("double"), "miss": F.lit(None).cast("double")}), None
    chance = min(1.0, 1.2 * sample / total)
    lot = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30))
    some = rows.filter(lot < int(chance * (1 << 30)) + 1).select(lot.alias("lot"), "vec_id", "v").orderBy("lot", "vec_id").limit(sample).collect() or rows.limit(1).select(F.lit(0), "vec_id", "v").collect()
    books = Codebooks(np.array([r[2] for r in some]))
    books.known = np.array([r[1] for r in some], np.int64), np.array([r[2] for r in some])
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(books)
    size = len(some[0][2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), size)
                codes = own.encode(x)
                y = own.decode(codes)
                new = pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((y * y).sum(axis=1)), pa.array(np.sqrt(((x - y) ** 2).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=["vec_id", "v", "code", "norm", "miss"])

    coded = stored(rows.mapInArrow(run, "vec_id long, v array<double>, code binary, norm double, miss double"), "codes")
    shared.destroy()
    parts = max(context.defaultParallelism, total * size * 8 // PART_BYTES)
    return stored(coded.repartitionByRange(parts, "code", "vec_id").sortWithinPartitions("code", "vec_id"), "vectors"), books


def bounded(queries: DataFrame, books: Codebooks, k: int) -> DataFrame:
    """vec_id, v and bound: the kth nearest row of the sample is no farther, so the kth nearest of all isn't."""
    shared = queries.sparkSession.sparkContext.broadcast(books.known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for b in batches:
            if b.num_rows:
                q, bound = matrix(b.column("v"), x.shape[1]), np.full(b.num_rows, np.inf)
                for i, (key, v) in enumerate(zip(b.column("vec_id").to_pylist(), q, strict=True)):
                    d = np.sqrt(((x[ids != key] - v) ** 2).sum(axis=1))
                    if len(d) >= k:
                        bound[i] = np.partition(d, k - 1)[k - 1] * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(bound)], names=["vec_id", "v", "bound"])

    return queries.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(run, "vec_id long, v array<double>, bound double")


def search(indexed: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest rows. queries: vec_id, v.

    A block of queries at a time is sent to all tasks, and its answer is stored before the next; rows never move, only
    k of each part of the index and query do.
    """
    spark = indexed.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], schema)
    folder, answers, block = scratch(spark, "nearest"), 0, []

    def answer(some: list) -> int:
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some]), np.array([r[2] for r in some]), books.c, books.reach()))
        near = indexed.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        near.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        shared.destroy()
        return 1

    for r in bounded(queries, books, k).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            answers += answer(block)
            block = []
    answers += answer(block) if block else 0
    return spark.read.schema(schema).parquet(folder) if answers else spark.createDataFrame([], schema)


def copies(x: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct vector, and its rows' keys, the smallest first: 2 k of them, and k of each key at most.

    Without the rows of any one key, that leaves k where there are so many. Fewer are filled up with the largest number.
    """
    _, first, which = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((key, which))
    which, key = which[order], key[order]
    nth = lambda new: np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    other = np.append(True, which[1:] != which[:-1])
    few = nth(other | np.append(True, key[1:] != key[:-1])) < k
    which, key = which[few], key[few]
    place = nth(np.append(True, which[1:] != which[:-1]))
    few = place < 2 * k
    keys = np.full((len(first), min(2 * k, int(place.max()) + 1)), np.iinfo(np.int64).max)
    keys[which[few], place[few]] = key[few]
    return first, keys


class Best:
    """The k nearest rows so far of each query of a block; `most` is the largest distance that can still be among them."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.q, self.bound, self.k = ids, q, bound, k
        self.d = np.full((len(ids), k), np.inf)
        self.i = np.full((len(ids), k), np.iinfo(np.int64).max)

    def most(self, z: np.ndarray) -> np.ndarray:
        return np.minimum(self.d[z, -1], self.bound[z])

    def add(self, z: np.ndarray, x: np.ndarray, keys: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
        """Compares queries (row, ascending, counted from z's first) with vectors (col) exactly."""
        n, k = len(self.ids[z]), self.k
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        wide = int(nth.max(initial=-1)) + 1
        d, near = np.full((n, wide), np.inf), np.zeros((n, wide), np.int64)
        own = self.q[z]
        for a in range(0, len(row), 8192):
            r, c = row[a : a + 8192], col[a : a + 8192]
            d[r, nth[a : a + 8192]], near[r, nth[a : a + 8192]] = distances(x[c], own[r]), c
        # the query's own vector may have no other row, so one more than k are looked at
        order = np.lexsort((keys[near, 0], d), axis=1)[:, : k + 1]
        d, i = np.take_along_axis(d, order, 1), keys[np.take_along_axis(near, order, 1)]
        d, i = np.repeat(d, keys.shape[1], axis=1), i.reshape(n, -1)
        i[np.isinf(d)] = np.iinfo(np.int64).max
        d[(i == self.ids[z][:, None]) | (i == np.iinfo(np.int64).max)] = np.inf
        d, i = np.concatenate([self.d[z], d], axis=1), np.concatenate([self.i[z], i], axis=1)
        order = np.lexsort((i, d), axis=1)[:, :k]
        self.d[z], self.i[z] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

    def meet(self, z: np.ndarray, x: np.ndarray, keys: np.ndarray, codes: np.ndarray, norms: np.ndarray, miss: np.ndarray, c: np.ndarray, reach: float) -> int:
        """All vectors of a block against some queries; returns how many pairs the scores left to compare."""
        q, k, size = self.q[z], self.k, x.shape[1]
        length = np.sqrt((q * q).sum(axis=1))
        s = scores(c @ q.astype(np.float32).T, codes, norms.astype(np.float32))
        # what single precision may have lost in the score
        slack = 2.0**-23 * ((size + 2 * len(c) + 4) * length * reach + length**2 + norms.max())
        far = np.sqrt(np.maximum(s + (length**2 - slack)[:, None], 0)) - (miss * (1 + 1e-9))[None, :]
        sure = np.isfinite(s)
        first = min(FIRST * (k + 1), len(x))
        near = np.sort(np.argpartition(s + (miss * miss)[None, :], first - 1, axis=1)[:, :first], axis=1)
        self.add(z, x, keys, np.repeat(np.arange(len(q)), first), near.ravel())
        left = ~((far > self.most(z)[:, None] * (1 + 1e-9)) & sure)
        np.put_along_axis(left, near, False, 1)
        pairs = int(left.sum())
        if pairs:
            rows, cols = np.flatnonzero(left.any(axis=1)), np.flatnonzero(left.any(axis=0))
            some = x[cols]
            own = (some * some).sum(axis=1)
            square = own[None, :] + (length[rows] ** 2)[:, None] - 2 * (q[rows] @ some.T)
            rounding = 1e-15 * (size + 8) * (length[rows] + np.sqrt(own.max())) ** 2
            square[~left[np.ix_(rows, cols)]] = np.inf
            limit = self.most(z)[rows] ** 2 * (1 + 1e-9)
            if len(cols) > k:
                limit = np.minimum(limit, np.partition(square, k, axis=1)[:, k] + rounding)
            row, col = np.nonzero(~(square > (limit + rounding)[:, None]) & left[np.ix_(rows, cols)])
            self.add(z, x, keys, rows[row], cols[col])
        return pairs


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, bound, c, reach = shared.value
        best = Best(ids, q, bound, k)
        for b in batches:
            for a in range(0, b.num_rows, ROW_BLOCK):
                part = b.slice(a, ROW_BLOCK)
                x, key = matrix(part.column("v"), q.shape[1]), part.column("vec_id").to_numpy()
                first, keys = copies(x, key, k)
                x = x[first]
                codes = np.frombuffer(b"".join(part.column("code").take(pa.array(first)).to_pylist()), np.uint8).reshape(len(x), -1)
                norms, miss = part.column("norm").to_numpy()[first], part.column("miss").to_numpy()[first]
                middle = x.mean(axis=0)
                radius = np.sqrt(((x - middle) ** 2).sum(axis=1).max())
                for at in range(0, len(ids), QUERY_STEP):
                    z = slice(at, min(at + QUERY_STEP, len(ids)))
                    near = np.flatnonzero(~(np.sqrt(((q[z] - middle) ** 2).sum(axis=1)) - radius * (1 + 1e-9) > best.most(z) * (1 + 1e-9)))
                    if len(near):
                        best.meet(at + near, x, keys, codes, norms, miss, c, reach)
        row, col = np.nonzero(np.isfinite(best.d))
        for a in range(0, len(row), 100_000):
            r, w = row[a : a + 100_000], col[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(best.i[r, w]), pa.array(best.d[r, w])], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The search of all rows for every row whose vec_id is divisible by a number."""
    rows = usable(vectors)
    indexed, books = index(rows)
    queries = indexed.filter(F.col("vec_id") % every == 0).select("vec_id", "v")
    return search(indexed, books, queries, k)

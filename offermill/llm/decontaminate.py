"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are the benchmark's windows of 13 words. A block shift table tells how far a window can move, since no
pattern holds the block at its end; where the shift is nothing, the bucket of the block's hash holds the patterns that
may occur, and comparing their bytes decides. The search runs over many stretches of a batch at once, in numpy.

Defined results: a null or empty text has no words and is never contaminated; a null or empty item has no windows; a
null item_id never counts as an item, but its windows hit; rows that repeat are each judged; an empty benchmark
contaminates nothing; an empty table gives no rows. Texts of any length are searched whole, one of them at least in a step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, stored, views, without

WINDOW = 13
#: Bytes of patterns searched for in one pass; a larger benchmark takes more passes over the texts.
PASS_BYTES = 8 << 20
SPACE = 32

_VALUE = np.full(256, SPACE, np.uint8)
_VALUE[0x30:0x3A] = np.arange(0x30, 0x3A)
_VALUE[0x61:0x7B] = np.arange(0x61, 0x7B)
_VALUE[0x41:0x5B] = np.arange(0x61, 0x7B)
_VALUE[0x80:] = np.arange(0x80, 0x100)


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return _VALUE[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


class _Group:
    """The tables for patterns of similar length."""

    def __init__(self, patterns: list[bytes], ids: np.ndarray):
        self.patterns, self.ids = patterns, ids
        self.m = m = min(map(len, patterns))
        self.block = b = 8 if m >= 16 else max(1, m // 2)
        self.mask = np.uint64((1 << 8 * b) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        bits = min(22, max(12, int(len(patterns) * (m - b + 1) * 8).bit_length()))
        self.right = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - b + 1, np.int32)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, self.slot(self.word(heads[:, j : j + b])), m - b - j)
        last = self.slot(self.word(heads[:, m - b :]))
        self.order = np.argsort(last, kind="stable")
        self.buckets = last[self.order]
        n = self.lead = min(8, m)
        self.lead_mask = np.uint64((1 << 8 * n) - 1)
        self.heads = self.word(heads[:, :n])[self.order]

    @staticmethod
    def word(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for j in range(x.shape[1]):
            out |= x[:, j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def slot(self, w: np.ndarray) -> np.ndarray:
        return (w * np.uint64(0x9E3779B97F4A7C15)) >> self.right

    def search(self, stream: np.ndarray, data: bytes, eights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns occur, and which."""
        last = len(stream) - 8 - self.m  # the stream ends with eight zeros
        if last < 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lane = max(256, min(4096, (last + 1) // 2048))
        at = np.arange(0, last + 1, lane, dtype=np.int64)
        end = np.minimum(at + lane, last + 1)
        reach, found = self.m - self.block, []
        while len(at):
            step = self.shift[self.slot(eights[at + reach] & self.mask)]
            if not step.all():
                found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            if not (go := at < end).all():
                at, end = at[go], end[go]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate(found)
        slot = self.slot(eights[at + reach] & self.mask)
        low, high = np.searchsorted(self.buckets, slot, "left"), np.searchsorted(self.buckets, slot, "right")
        size = high - low
        place, at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(at, size)
        same = (eights[at] & self.lead_mask) == self.heads[place]
        at, which = at[same], self.order[place[same]]
        hit = [data[s : s + len(p)] == p and data[s - 1] <= SPACE and data[s + len(p)] <= SPACE for s, p in zip(at.tolist(), (self.patterns[i] for i in which.tolist()), strict=True)]
        hit = np.array(hit, bool)
        return at[hit], self.ids[which[hit]]


class Benchmark:
    """Windows of items, as tables for the search."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        seen: dict[bytes, int] = {}
        holds: list[set[str]] = []
        self.size: list[int] = []
        for item, own in items:
            for i in range(max(1, len(own) - WINDOW + 1)) if own else ():
                window = own[i : i + WINDOW]
                k = seen.setdefault(b" ".join(window), len(seen))
                if k == len(holds):
                    holds.append(set())
                    self.size.append(len(window))
                if item is not None:
                    holds[k].add(str(item))
        self.names = sorted(set().union(*holds)) if holds else []
        place = {x: i for i, x in enumerate(self.names)}
        self.n_words = np.array(self.size, np.int64)
        self.starts = np.cumsum([0, *map(len, holds)])
        self.members = np.array([place[x] for h in holds for x in sorted(h)], np.int64)
        classes: dict[int, list[tuple[int, bytes]]] = {}
        for p, k in seen.items():
            classes.setdefault(min(6, len(p).bit_length()), []).append((k, p))
        self.groups = [_Group([p for _, p in c], np.array([k for k, _ in c], np.int64)) for c in classes.values()]

    def scan(self, texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """Where each text's words begin in the hit flags, which words are hit, and the items that occur in each text."""
        raw = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
        marks = np.cumsum([0, *(len(t) + 1 for t in texts)])
        value = _VALUE[raw]
        value[marks] = 0
        kept = value != SPACE
        kept[1:] |= kept[:-1].copy()
        data = value[kept].tobytes() + bytes(8)
        stream = np.frombuffer(data, np.uint8)
        eights = np.ndarray(len(stream) - 7, "<u8", data, strides=(1,))
        mark = np.flatnonzero(stream[:-8] == 0)
        solid = stream > SPACE
        begin = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        first = np.searchsorted(begin, mark)
        change = np.zeros(len(begin) + 1, np.int64)
        items: list[list[int]] = [[] for _ in texts]
        for group in self.groups:
            at, which = group.search(stream, data, eights)
            if not len(at):
                continue
            word = np.searchsorted(begin, at)
            np.add.at(change, word, 1)
            np.add.at(change, word + self.n_words[which], -1)
            doc = np.searchsorted(mark, at, "right") - 1
            for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                items[d] += self.members[self.starts[w] : self.starts[w + 1]].tolist()
        return first, np.cumsum(change[:-1]) > 0, begin, items


NEW = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")]


def _passes(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[Benchmark, bool]]:
    """Parts of the benchmark, one at a time, and whether it is the last."""
    part, size = [], 0
    for row in benchmark.select(item, text).toLocalIterator():
        if size >= limit:
            yield Benchmark(part), False
            part, size = [], 0
        own = words(row[1])
        size += sum(map(len, own)) * WINDOW
        part.append((row[0], own))
    yield Benchmark(part), True


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated, by the rule 20 * n_hit >= n_words.

    Columns of docs that have these names are replaced, as are _hits and _items, which hold what passes found. The
    benchmark is read in parts of pass_bytes of patterns, of which the driver and a task hold one at a time; each part is
    a pass over the documents, and what it found is stored before the next. No rows move between tasks.
    """
    docs = without(docs, [n for n, _ in NEW] + ["_hits", "_items"])
    spark = docs.sparkSession
    kept = docs.schema
    between = T.StructType([*kept.fields, T.StructField("_hits", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])
    final = T.StructType([*kept.fields, *(T.StructField(n, {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}[t]) for n, t in NEW)])
    for k, (part, last) in enumerate(_passes(benchmark, item, item_text, pass_bytes)):
        tables = spark.sparkContext.broadcast(part)
        docs = docs.mapInArrow(_scanner(tables, text, k > 0, last), final if last else between)
        if not last:
            docs = stored(docs, "pass")
            tables.destroy()
    return docs


def _scanner(tables, text: str, carries: bool, ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = tables.value
        for batch in slices(batches, text):
            first, hit, _, items = bench.scan(views(batch.column(text)))
            names = [sorted({bench.names[i] for i in own}) for own in items]
            n_words = np.diff(first)
            if carries:
                old = batch.column("_hits").to_pylist()
                if any(old):
                    hit = hit | np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(old, n_words, strict=True)]).astype(bool)
                names = [sorted({*own, *was}) for own, was in zip(names, batch.column("_items").to_pylist(), strict=True)]
            plain = [(n, batch.column(n)) for n in batch.schema.names if n not in ("_hits", "_items")]
            if ends:
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[first[1:]] - total[first[:-1]]
                more = [n_words, n_hit, [len(x) for x in names], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], (n_hit > 0) & (20 * n_hit >= n_words)]
                new = [(n, pa.array(x)) for (n, _), x in zip(NEW, more, strict=True)]
            else:
                new = [("_hits", pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())), ("_items", pa.array(names, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([x for _, x in plain + new], names=[n for n, _ in plain + new])

    return run

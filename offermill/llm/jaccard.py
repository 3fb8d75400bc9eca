"""Exact near-duplicate components by a metric-space join on shingle sets.

Jaccard distance is a metric. Documents make poor pivots for it: those without a common shingle are all at distance 1
from each other. So the pivots are sets of one shingle each, in one fixed order; a set's nearest pivot is its first
shingle, and as two sets within the radius differ in few shingles, the window that replicates a set beyond its own
region is its first n - ceil(0.8 n) + 1 shingles. Two linked sets meet in a region, whatever the order; rare shingles
come first, by counts in a bounded sample, which keeps regions of unlike sets small. Regions split by size, which is the
triangle inequality with the empty set as pivot, and equal regions are one. They split again by parity sketches: a bit
for each hash class tells whether a set has an odd number of members in it, so two sketches never differ in more bits
than the sets differ in members, and members whose sketches are too far apart can't be linked. What is left holds nearly
alike sets and is joined recursively: the member with most sets near it is the region's document pivot and is compared
with the others; members already in one component need no comparison, and pairs whose distances to the pivot differ by
more than the radius are cut by the triangle inequality; then more members become pivots, four times as many each time,
until no region holds two components. Distances are exact: shingles are told apart by 128 bits that follow from BLAKE2
digests of their words, and sets by 128 bits of BLAKE2. Regions and sketches use half of a shingle's bits; two shingles with
that half in common only make candidates.

Defined results: null texts and texts without words have empty sets and are linked with nothing; equal sets are one node
whatever their number; a document without doc_id has no component; rows that repeat a doc_id are nodes by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, dealt, digests, mix, rows_of, slices, stored, strings, views
from .suffixes import joined, packed

WORDS = 5
#: A link: at least so many hundredths of the union are common.
PERCENT = 80
#: Documents from which common shingles are learned, about, and how many shingles are remembered, at most.
SAMPLE_DOCUMENTS, SAMPLE_COMMON = 4096, 1 << 19
STEP = 2 << 20
#: Members of a region that one task compares by their sketches, and how many of a cluster's members are tried as its pivot.
WHOLE, DEGREES = 20_000, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = _BLANK[0x09:0x0E] = True


def word_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2 for each word, as two numbers a row; each distinct word is hashed once."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    words = rows_of(data[np.cumsum(inside[:-1]).astype(bool)].tobytes(), np.append(0, np.cumsum(end - start))).dictionary_encode()
    return digests(strings(words.dictionary))[words.indices.to_numpy()] if len(words) else np.empty((0, 2), np.uint64)


def chained(words: list[np.ndarray]) -> np.ndarray:
    """128 bits for each sequence of words, of which the first, second, ... are given, as two numbers a row.

    Each step is a permutation of the state for a given word, and words are digests that nobody can choose, so sequences
    share all bits no sooner than digests do.
    """
    a = np.full(len(words[0]), len(words), np.uint64)
    b = mix(a)
    for w in words:
        a = mix(a * np.uint64(0x9FB21C651E98DF25) + w[:, 0] + b)
        b = mix((b ^ w[:, 1]) * np.uint64(0xD6E8FEB86659FD93) + a)
    return np.stack([a, b], axis=1)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct rows in order of both numbers."""
    x = x[np.argsort(x[:, 0], kind="stable")]
    same = x[1:, 0] == x[:-1, 0]
    other = x[1:, 1] != x[:-1, 1]
    if (same & other).any():
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        same, other = x[1:, 0] == x[:-1, 0], x[1:, 1] != x[:-1, 1]
    return x[np.append(np.ones(min(1, len(x)), bool), ~same | other)]


def whole_sets(texts: list[memoryview], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, by 128 bits as two numbers a row, in order; of a text with fewer words, one for all of them."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    blank = _BLANK[data]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    own = word_digests(data, start, end)
    first = np.append(np.searchsorted(start, begin), len(start))
    n = len(own) - words + 1
    full = chained([own[i : i + n] for i in range(words)]) if n > 0 else own[:0]
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(_distinct(full[a : z - words + 1]))
        else:
            out.append(chained([own[i : i + 1] for i in range(a, z)]) if z > a else own[:0])
    return out


def shingle_sets(texts: list[memoryview], words: int = WORDS) -> list[np.ndarray]:
    """The first numbers of each text's shingles, for regions and sketches: two shingles may share one, and both count."""
    return [np.ascontiguousarray(x[:, 0]) for x in whole_sets(texts, words)]


def intersection(s: np.ndarray, t: np.ndarray) -> int:
    """How many shingles two sets share, by all their bits."""
    _, i, j = np.intersect1d(s[:, 0], t[:, 0], return_indices=True)
    if any((x[1:, 0] == x[:-1, 0]).any() for x in (s, t)):
        return len(set(map(tuple, s.tolist())) & set(map(tuple, t.tolist())))
    return int((s[i, 1] == t[j, 1]).sum())


def names(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of BLAKE2 that stand for each whole set, as two numbers a row."""
    return digests([np.ascontiguousarray(x).tobytes() for x in sets]) if sets else np.empty((0, 2), np.uint64)


def nodes(sets: list[np.ndarray], twice: frozenset[int] = frozenset()) -> np.ndarray:
    """A number for each distinct set: the first half of its name, or the second where unlike sets share a first half, as those in twice do."""
    both = names(sets).view(np.int64)
    if not twice:
        return both[:, 0]
    return np.where(np.isin(both[:, 0], list(twice)), both[:, 1], both[:, 0])


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketch(x: np.ndarray, classes: int = 2) -> bytes:
    """Parities of a set's members by hash class; so many classes for each member, or up to twice that."""
    bits = max(64, 1 << int(classes * len(x) - 1).bit_length())
    odd = np.bincount((mix(x) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches with as many classes as words of 64 bits have; classes that become one add their parities."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def membership(docs: DataFrame) -> DataFrame:
    """doc_id, node (null without a set or doc_id), other (the second half of its name), n_shingles and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            sets = whole_sets(views(b.column("text")))
            n = np.array([len(x) for x in sets], np.int64)
            none = (n == 0) | np.asarray(b.column("doc_id").is_null())
            both = names(sets).view(np.int64)
            columns = [pa.array(both[:, 0], mask=none), pa.array(both[:, 1], mask=none), pa.array(n), pa.array([sketch(x[:, 0]) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "node", "other", "n_shingles", "sketch"])

    return _source(docs).mapInArrow(run, "doc_id long, node long, other long, n_shingles long, sketch binary")


def common_shingles(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, and how many have them. They decide an order, never a link."""
    rows = _source(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    total = rows.count()
    chance = min(1.0, sample / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            x = np.concatenate([np.empty(0, np.uint64), *shingle_sets(views(b.column("text")))])
            h, n = np.unique(x, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    lot = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(chance * (1 << 30))
    some = rows.filter(lot).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2")
    got = some.orderBy(F.desc("n"), "h").limit(SAMPLE_COMMON).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy(np.int64)[order]


def window(x: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The pivots of the regions that a set belongs to."""
    n = len(x)
    size = n - -(-percent * n // 100) + 1
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], x), len(common[0]) - 1)
        count = np.where(common[0][at] == x, common[1][at], 0)
        if count.any():
            return x[np.lexsort((x, count))[:size]]
    return x[:size]


def regions(docs: DataFrame, parts: int, twice: frozenset[int] = frozenset()) -> DataFrame:
    """rid, node and n: the regions in which sets of like sizes meet. Regions with equal members are one."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for b in slices(batches, "text", STEP):
            sets = whole_sets(views(b.column("text")))
            ids = nodes(sets, twice)
            _, once = np.unique(ids, return_index=True)
            once = [i for i in once.tolist() if len(sets[i])]
            if not once:
                continue
            keys = [window(sets[i][:, 0], common) for i in once]
            which = np.repeat(np.arange(len(once)), [len(k) for k in keys])
            key = np.concatenate(keys)
            bucket = ((key >> np.uint64(3)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, key, which = bucket[order], key[order], which[order]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            node, size = ids[once], np.array([len(sets[i]) for i in once], np.uint32)
            out = []
            for a, z in zip(edge, [*edge[1:], len(bucket)], strict=True):
                out.append((int(bucket[a]), packed(key[a:z], node[which[a:z]], size[which[a:z]])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "value"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [bytes(v) for b in batches for v in views(b.column("value"))]
        if not own:
            return
        key, node, n = joined(own)
        order = np.lexsort((node, n, key))
        key, node, n = key[order], node[order], n[order].astype(np.int64)
        fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, n = key[fresh], node[fresh], n[fresh]
        # members of one region in order of size: a gap that no link can bridge starts another region
        new = np.append(True, (key[1:] != key[:-1]) | (100 * n[:-1] < PERCENT * n[1:]))
        edge = np.flatnonzero(new)
        m = np.diff(np.append(edge, len(key)))
        name = mix(np.add.reduceat(mix(node.view(np.uint64)), edge) + m.astype(np.uint64)).view(np.int64)
        _, single = np.unique(name, return_index=True)
        keep = np.zeros(len(edge), bool)
        keep[single] = True
        keep &= m > 1
        row = np.repeat(keep, m)
        rid, node, n = np.repeat(name, m)[row], node[row], n[row]
        if not len(rid):
            return
        for a in range(0, len(rid), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in (rid, node, n)], names=["rid", "node", "n"])

    found = _source(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(cells, "bucket int, value binary")
    return found.repartitionById(parts, F.col("bucket")).mapInArrow(meet, "rid long, node long, n long").dropDuplicates(["rid", "node"])


class Near:
    """Which sets may be linked, by their sketches: never fewer than are."""

    def __init__(self, n: np.ndarray, sketches: list[bytes], percent: int = PERCENT):
        self.n, self.percent = n, percent
        self.size = np.array([len(k) // 8 for k in sketches])
        least = int(self.size.min())
        self.rows = {}
        self.place = np.empty(len(n), np.int64)
        self.every = np.empty((len(n), least), np.uint64)
        for w in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == w)
            self.rows[w] = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), w)
            self.place[at] = np.arange(len(at))
            self.every[at] = folded(self.rows[w], least)

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that may be linked with i: by sketches of the least size first, then of the smaller of each two."""
        others = others[np.minimum(self.n[i], self.n[others]) * 100 >= np.maximum(self.n[i], self.n[others]) * self.percent]
        most = (self.n[i] + self.n[others]) * (100 - self.percent)
        close = others[np.bitwise_count(self.every[others] ^ self.every[i]).sum(axis=1, dtype=np.int64) * (100 + self.percent) <= most]
        if len(self.rows) == 1:
            return close
        out = []
        for w in np.unique(self.size[close]).tolist():
            own = close[self.size[close] == w]
            width = min(w, int(self.size[i]))
            mine = folded(self.rows[int(self.size[i])][self.place[i] : self.place[i] + 1], width)
            h = np.bitwise_count(folded(self.rows[w][self.place[own]], width) ^ mine).sum(axis=1, dtype=np.int64)
            out.append(own[h * (100 + self.percent) <= (self.n[i] + self.n[own]) * (100 - self.percent)])
        return np.concatenate(out) if out else close


def clusters(n: np.ndarray, sketches: list[bytes], percent: int = PERCENT) -> list[np.ndarray]:
    """Members that sketches near enough connect, those with most near ones first; single members are left out."""
    near = Near(n, sketches, percent)
    left = np.ones(len(n), bool)
    found = []
    for first in range(len(n)):
        if not left[first]:
            continue
        left[first] = False
        members, wave = [first], [first]
        while wave:
            new = near(wave.pop(), np.flatnonzero(left))
            left[new] = False
            members += new.tolist()
            wave += new.tolist()
        if len(members) > 1:
            own = np.array(members)
            probe = own if len(own) <= DEGREES else own[:: len(own) // DEGREES]
            degree = np.zeros(len(n), np.int64)
            for i in probe.tolist():
                degree[near(i, own)] += 1
            found.append(own[np.argsort(-degree[own], kind="stable")])
    return found


def split(region: DataFrame, sketches: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """rid, node, n, ord and leader of the regions' clusters. The leader has ord 0. Regions of more than WHOLE members,
    which one task should not hold, stay whole, in the order of their nodes."""
    size = region.groupBy("rid").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("leader"))
    rows = region.join(size, "rid")
    large = rows.filter(F.col("m") > WHOLE).withColumn("ord", F.when(F.col("node") == F.col("leader"), 0).otherwise(1 + F.pmod(F.xxhash64("node"), F.col("m") * 4))).select("rid", "node", "n", "ord", "leader", F.lit(True).alias("large"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        rid, node, n = (t.column(c).to_numpy() for c in ("rid", "node", "n"))
        keys = t.column("sketch").to_pylist()
        order = np.lexsort((node, rid))
        edge = np.flatnonzero(np.append(True, np.diff(rid[order]) != 0)).tolist()
        out: dict[int, list[int]] = {}
        for a, z in zip(edge, [*edge[1:], len(order)], strict=True):
            own = order[a:z]
            if z - a < 2:
                continue
            for c in clusters(n[own], [keys[i] for i in own], percent):
                members = own[c]
                name = int(mix(np.array([int(mix(node[members].view(np.uint64)).sum(dtype=np.uint64))], np.uint64)).view(np.int64)[0])
                out.setdefault(name, members.tolist())
        if not out:
            return
        which = np.array([i for m in out.values() for i in m])
        count = np.array([len(m) for m in out.values()])
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(np.cumsum(count) - count, count)
        columns = [np.repeat(np.array(list(out), np.int64), count), node[which], n[which], nth, node[which][first]]
        for a in range(0, len(which), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], names=["rid", "node", "n", "ord", "leader"])

    met = rows.filter(F.col("m") <= WHOLE).join(sketches, "node").select("rid", "node", "n", "sketch")
    near = met.repartitionById(parts, F.pmod("rid", F.lit(parts)).cast("int")).mapInArrow(run, "rid long, node long, n long, ord long, leader long")
    return near.dropDuplicates(["rid", "node"]).withColumn("large", F.lit(False)).unionByName(large)


def texts_of(docs: DataFrame, wanted: DataFrame, twice: frozenset[int] = frozenset()) -> DataFrame:
    """node, its compressed text and a sketch of more classes, one row for each wanted node (node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, "text", STEP):
            data = views(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes(whole_sets(data), twice)), pa.array([z.compress(t) for t in data], pa.binary())], names=["doc_id", "node", "z"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", STEP // 4):
            sets = shingle_sets([memoryview(z.decompress(v)) for v in views(b.column("z"))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sketch(x, 8) for x in sets], pa.binary())], names=["node", "z", "fine"])

    rows = _source(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id long, node long, z binary")
    return rows.join(wanted, ["node", "doc_id"], "left_semi").select("node", "z").mapInArrow(more, "node long, z binary, fine binary")


def near_pairs(region: DataFrame, texts: DataFrame, low: int, width: int, parts: int, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, la, lb) of each region's pivots, those with ord from low on, and later members that may be linked with
    them and are in other components. A region's members meet in one task, with their sketches; only pairs leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        rid, node, n, nth, label = (t.column(c).to_numpy() for c in ("rid", "node", "n", "ord", "label"))
        d = t.column("d").to_numpy(zero_copy_only=False)
        keys = t.column("fine").to_pylist()
        order = np.lexsort((nth, rid))
        edge = np.flatnonzero(np.append(True, np.diff(rid[order]) != 0)).tolist()
        out: set[tuple[int, int, int, int]] = set()
        for x, z in zip(edge, [*edge[1:], len(order)], strict=True):
            own = order[x:z]
            near = Near(n[own], [keys[i] for i in own], percent)
            pivots = np.flatnonzero((nth[own] >= low) & (nth[own] < low + width))
            for p in pivots.tolist():
                others = np.arange(p + 1, len(own))
                others = others[label[own[others]] != label[own[p]]]
                if len(others):  # triangle inequality with the distances to the region's leader
                    gap = np.abs(d[own[others]] - d[own[p]])
                    others = others[~(gap > 1 - percent / 100 + 1e-9)]
                for q in near(p, others).tolist() if len(others) else ():
                    i, j = own[p], own[q]
                    out.add((int(node[i]), int(node[j]), int(label[i]), int(label[j])) if node[i] < node[j] else (int(node[j]), int(node[i]), int(label[j]), int(label[i])))
        rows = sorted(out)
        for x in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[x : x + 100_000], strict=True)], names=["a", "b", "la", "lb"])

    met = region.join(texts.select("node", "fine"), "node").select("rid", "node", "n", "ord", "label", "d", "fine")
    return met.repartitionById(parts, F.pmod("rid", F.lit(parts)).cast("int")).mapInArrow(run, "a long, b long, la long, lb long").distinct()


def distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sizes of intersection and union of their sets."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "zb", STEP // 4):
            place: dict[int, int] = {}
            texts_: list[memoryview] = []
            for c in "ab":
                z = zstandard.ZstdDecompressor()
                for k, v in zip(b.column(c).to_pylist(), views(b.column("z" + c)), strict=True):
                    if k not in place:
                        place[k] = len(texts_)
                        texts_.append(memoryview(z.decompress(v)))
            sets = whole_sets(texts_)
            common, union = [], []
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                s, t = sets[place[x]], sets[place[y]]
                n = intersection(s, t)
                common.append(n)
                union.append(len(s) + len(t) - n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=[*names, "common", "union"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return both.select(*names, "za", "zb").mapInArrow(run, schema + ", common long, union long").dropDuplicates(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node that edges (a, b) lead to, for every node of an edge.

    Each round takes the least label of neighbours and then the label's own label, so that chains shorten by halves.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        low = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = now.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(low.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if not new.filter("was <> label").limit(1).count():
            return new.select("node", "label")
        now = new.select("node", "label")


def join(docs: DataFrame, percent: int = PERCENT, parts: int | None = None) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Every row's doc_id, node and n_shingles; for nodes that links or copies join with others, the component_id, the node of
    the row that has it, and the node's rows, as a stored table; and the nodes that have another half of their names."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = stored(membership(docs), "members")
    # sets are told apart by 128 bits: where only half are the same, the other half is the node
    same = members.filter("node IS NOT NULL").groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x <> y")
    twice = frozenset(r[0] for r in same.select("node").toLocalIterator())
    members = members.withColumn("node", F.when(F.col("node").isin(*twice), F.col("other")).otherwise(F.col("node")) if twice else F.col("node")).drop("other")
    least = members.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    sketches = members.select("node", "doc_id", "sketch").join(least.select("node", "doc_id"), ["node", "doc_id"], "left_semi").dropDuplicates(["node"]).select("node", "sketch")
    region = stored(split(stored(regions(docs, parts, twice), "cells"), sketches, parts, percent), "regions")
    wanted = region.select("node").distinct().join(least.select("node", "doc_id"), "node")
    texts = stored(texts_of(docs, wanted, twice), "texts")
    region = region.withColumns({"label": F.col("node"), "d": F.lit(None).cast("double")})
    steps, low, width = [], 0, 1
    radius = 1 - percent / 100 + 1e-9
    while True:
        # a region too large for one task is joined by Spark, as are all with their leaders
        whole = region if low == 0 else region.filter("large")
        pivot = whole.filter((F.col("ord") >= low) & (F.col("ord") < low + width)).select("rid", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("ord").alias("po"), F.col("label").alias("pl"), F.col("d").alias("pd"))
        like = (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent) & (F.col("label") != F.col("pl")) & ((F.col("ord") > F.col("po")) | ((F.col("ord") == F.col("po")) & (F.col("node") > F.col("p"))))
        close = F.coalesce(F.abs(F.col("d") - F.col("pd")) <= radius, F.lit(True))
        swap = F.col("p") < F.col("node")
        pairs = whole.join(pivot, "rid").filter(like & close).select(
            F.when(swap, F.col("p")).otherwise(F.col("node")).alias("a"), F.when(swap, F.col("node")).otherwise(F.col("p")).alias("b"),
            F.when(swap, F.col("pl")).otherwise(F.col("label")).alias("la"), F.when(swap, F.col("label")).otherwise(F.col("pl")).alias("lb"),
        ).distinct()
        if low:
            pairs = pairs.unionByName(near_pairs(region.filter("NOT large"), texts, low, width, parts, percent)).distinct()
        found = stored(distances(pairs, texts), "distances")
        links = found.filter(F.col("common") * 100 >= F.col("union") * percent)
        if links.limit(1).count():
            labels = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            steps.append(labels)
            region = region.withColumnRenamed("label", "was").join(labels.select(F.col("node").alias("was"), "label"), "was", "left").withColumn("label", F.coalesce("label", "was")).drop("was")
        if low == 0:
            d = found.select("a", "b", (1 - F.col("common") / F.col("union")).alias("d"))
            first = F.col("leader") < F.col("node")
            region = region.drop("d").withColumns({"a": F.when(first, F.col("leader")).otherwise(F.col("node")), "b": F.when(first, F.col("node")).otherwise(F.col("leader"))}).join(d, ["a", "b"], "left").drop("a", "b")
        low, width = low + width, width * 4
        region = region.filter(F.col("ord") >= low)
        open_ = region.groupBy("rid").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("rid")
        region = stored(region.join(open_, "rid", "left_semi").select("rid", "node", "n", "ord", "leader", "large", "label", "d"), "regions")
        if not region.limit(1).count():
            break
    named = least.withColumn("label", F.col("node"))
    for labels in steps:
        named = named.withColumnRenamed("label", "was").join(labels.select(F.col("node").alias("was"), "label"), "was", "left").withColumn("label", F.coalesce("label", "was")).drop("was")
    named = stored(named, "named")
    least = F.min(F.struct("doc_id", "node"))
    joint = named.groupBy("label").agg(least.alias("least"), F.sum("rows").alias("size")).filter("size > 1")
    joint = named.join(joint, "label").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("first"), F.col("rows").alias("_n"))
    return members.drop("sketch"), stored(joint, "joint"), twice


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. Nodes that hold many rows are dealt among salts."""
    with batches_of(docs.sparkSession, STEP):
        members, joint, _ = join(docs, percent)
    return dealt(members, joint, "node", ["doc_id"]).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id. All columns stay.

    Rows without doc_id and rows whose sets are empty all stay. Rows that share a doc_id are judged each by its own text;
    of those among them with equal sets, the one whose text is least stays.
    """
    with batches_of(docs.sparkSession, STEP):
        members, joint, twice = join(docs, percent)
    late = dealt(members.filter("node IS NOT NULL"), joint, "node", ["doc_id"]).filter("component_id < doc_id").select("doc_id").distinct()
    same = stored(members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "same")
    keyed = docs.filter("doc_id IS NOT NULL")
    if not same.limit(1).count():
        return keyed.join(late, "doc_id", "left_anti").unionByName(docs.filter("doc_id IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            sets = whole_sets(views(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(nodes(sets, twice), mask=np.array([not len(x) for x in sets], bool)), *b.columns], names=["node", *(f"c{i}" for i in range(len(b.columns) - 1)), "text"])

    # rows that share a doc_id: columns under names of our own, with the node of each row
    rows = keyed.join(same, "doc_id", "left_semi")
    own = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("text").cast("string").alias("text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    key = f"c{docs.columns.index('doc_id')}"
    placed = own.mapInArrow(run, f"node long, {types}").join(joint.drop("_n"), "node", "left")
    stays = placed.filter(F.col("node").isNull() | F.col("first").isNull() | ((F.col("component_id") == F.col(key)) & (F.col("first") == F.col("node"))))
    nth = F.row_number().over(Window.partitionBy(key, "node").orderBy("text", *(F.hash(F.col(f"c{i}")) for i in range(len(docs.columns)))))
    one = stays.withColumn("nth", nth).filter("nth = 1 OR node IS NULL").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
    rest = keyed.join(same, "doc_id", "left_anti").join(late, "doc_id", "left_anti")
    return rest.unionByName(one).unionByName(docs.filter("doc_id IS NULL"))

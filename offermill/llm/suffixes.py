"""Removal of repeated 50-byte strings by prefix-free parsing.

Triggers cut every text into phrases: a phrase is a maximal run of 50-byte windows that share their least rolling hash of
24 bytes, so equal windows lie in phrases with equal triggers wherever they occur, and each window lies in one phrase.
The parse is then short rows (trigger, hash of the phrase, document, place), and the dictionary is the distinct phrases.
A phrase that a smaller document has too is covered whole, which settles most of a repetitive corpus without its text.
A window reaches at least 13 bytes beyond its trigger on one side, so windows of unlike phrases can be equal only if these
37 bytes are; a phrase has a small code of them for each side. Only of phrases that share a trigger and a code with unlike
ones are the bytes needed: the suffixes that repeat, by a rolling hash, are sorted to the depth of 50 bytes, and equal
neighbours form the groups in which the smallest document keeps the string. As a trigger's phrases
are in one bucket, the sorted buckets together are the corpus order. Phrases are told apart by 96 bits of BLAKE2 among those
of a trigger's 32 bits, and strings by their bytes; rolling hashes only choose where to cut and what can't be equal. A task
reads its buckets one after another.

Defined results: a null or empty text, or one of fewer bytes than the string's length, loses nothing; a document without
doc_id loses nothing and takes nothing from others; rows that repeat a doc_id don't count as smaller than each other;
columns other than the text are kept, whatever their names, but for those with the names of the results, which are
replaced; an empty table gives no rows. Texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, digests, give_back, mix, slices, stored, views, without

DEPTH, TRIGGER = 50, 24
#: Windows in a phrase, at most; longer runs (of one character, say) are several phrases of one trigger.
LONGEST = 4096
PARSE_BYTES = 3 << 20
#: Text bytes that are hashed at once; every byte takes some hundred bytes then. A longer text is hashed by itself.
HASH_BYTES = 512 << 10
#: Phrases, and bytes of phrases, that are packed together for all buckets. Few make as many rows as slices times buckets.
PACKED, PACKED_BYTES = 1 << 19, 8 << 20
#: Text bytes whose phrases are in one bucket, about, and the buckets, at most. A task holds one bucket at a time.
BUCKET_BYTES, BUCKETS = 8 << 20, 100_000
NEW = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(value: bytes | memoryview) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(value)
    n, at, out = data[0], 1, []
    start = 1 + 10 * n
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", data, at)
        at += 10
        dtype = np.dtype("<" + kind.decode() if kind != b"u1" else "u1")
        out.append(np.frombuffer(data, dtype, size // dtype.itemsize, start))
        start += size
    return out


def joined(values: list[bytes | memoryview]) -> list[np.ndarray]:
    """The arrays of several packed values, each one after another."""
    return [np.concatenate(x) for x in zip(*map(unpacked, values), strict=True)]


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive numbers."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def sides(rolling: Rolling, every: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, beside: int, trigger: int) -> np.ndarray:
    """Codes, from 1, of the trigger with bytes to its left and to its right, for phrases by their first and last windows.

    A window is on the left if its first trigger has half of beside to its left, else on the right, so equal windows have
    equal codes. A side without windows has 0; a phrase whose windows begin with several triggers has 0 on both.
    """
    offset = np.full(len(first), -1, np.int64)
    for i in range(beside, -1, -1):
        offset[every[first + i] == low] = i
    at, half = first + offset, beside // 2
    plain = at >= last
    codes = np.zeros((len(first), 2), np.uint16)
    for i, (has, begin, end) in enumerate(((at - first >= half, at - half, at + trigger), (at - last < half, at, at + trigger + beside - half + 1))):
        own = np.flatnonzero(plain & has)
        codes[own, i] = np.maximum(rolling.of(begin[own], end[own]) >> np.uint64(48), np.uint64(1))
    return codes


class Parse:
    """The phrases of some texts."""

    def __init__(self, texts: list[memoryview], depth: int = DEPTH, trigger: int = TRIGGER, repeats: bool = True):
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        rolling = Rolling(data)
        self.text_hash = text_hashes(texts, repeats)
        n = len(data) - depth + 1
        empty = np.empty(0, np.int64)
        self.doc, self.start, self.windows, self.key, self.name, self.sides = empty, empty, empty, empty.astype(np.uint32), np.empty((0, 2), np.uint64), np.empty((0, 2), np.uint16)
        if n <= 0:
            return
        every = rolling.every(trigger)
        low = least(every, depth - trigger + 1)
        valid = np.zeros(n + 1, np.int8)
        long = size >= depth
        np.add.at(valid, begin[long], 1)
        np.add.at(valid, (begin + size - depth + 1)[long], -1)
        valid = np.cumsum(valid[:n]) > 0
        edge = valid.copy()
        edge[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        edge[begin[long]] = True
        start = np.flatnonzero(edge)
        doc = np.searchsorted(begin, start, "right") - 1
        stop = np.minimum(np.append(start[1:], n), (begin + size - depth + 1)[doc])
        windows = stop - start
        if (windows > LONGEST).any():
            parts = -(-windows // LONGEST)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            doc, start, windows = np.repeat(doc, parts), np.repeat(start, parts) + nth * LONGEST, np.minimum(LONGEST, np.repeat(windows, parts) - nth * LONGEST)
        view = memoryview(whole)
        self.name = digests([view[a:z] for a, z in zip(start.tolist(), (start + windows + depth - 1).tolist(), strict=True)])
        self.key = (low[start] >> np.uint64(32)).astype(np.uint32)
        self.sides = sides(rolling, every, low[start], start, start + windows - 1, depth - trigger, trigger)
        self.doc, self.start, self.windows = doc, start - begin[doc], windows


class Parses:
    """The phrases of some texts, hashed a few at a time."""

    def __init__(self, texts: list[memoryview], repeats: bool = True):
        ends = np.cumsum([len(t) for t in texts])
        some, at = [], 0
        while at < len(texts) or not some:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASH_BYTES, side="right")))
            p = Parse(texts[at:to], repeats=repeats)
            p.doc = p.doc + at
            some.append(p)
            at = to
        for name in ("text_hash", "doc", "start", "windows", "key", "name", "sides"):
            setattr(self, name, np.concatenate([getattr(p, name) for p in some]))


def _by_bucket(bucket: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order, edges = _of_buckets(bucket)
    arrays = [a[order] for a in arrays]
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        yield int(bucket[order[a]]), kind, packed(*(x[a:b] for x in arrays))


def _of_buckets(bucket: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order by buckets, and where each begins in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, v = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.binary())], names=["bucket", "kind", "value"])


def text_hashes(texts: list[memoryview], repeats: bool) -> np.ndarray:
    """A number for each text, which with the doc_id names its row; 0 if no doc_id repeats."""
    if not repeats:
        return np.zeros(len(texts), np.uint64)
    return np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in texts]), np.uint64)


def dealt_to(number: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a trigger."""
    return (mix(number.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def home(doc: np.ndarray, text_hash: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a document."""
    return dealt_to(mix(doc.astype(np.int64).view(np.uint64)) + text_hash, parts)


def gathered(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of a bucket one after another, replies before texts."""
    return rows.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def _by_turns(batches: Iterator[pa.RecordBatch], work: Callable[[list[bytes]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """What comes of the packed values of each bucket; replies that are ready pass."""
    own, at = [], None
    for b in batches:
        for bucket, kind, value in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), views(b.column("value")), strict=True):
            if kind != PARSE:
                yield _rows([(bucket, kind, bytes(value))])
                continue
            if bucket != at and own:
                done, own = work(own), []
                if done is not None:
                    yield done
            at = bucket
            own.append(bytes(value))
    if own and (done := work(own)) is not None:
        yield done
    give_back()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the ones before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _firsts(doc: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns and doc, and in it the smallest doc of each row's group."""
    order = np.lexsort((doc, *same[::-1]))
    new = _runs(*(c[order] for c in same))
    return order, doc[order][new][np.cumsum(new) - 1]


def _named(doc: np.ndarray, high: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal phrases are neighbours, where they begin in it, and the smallest doc of each row's phrase. The first number nearly always tells them apart."""
    order = np.argsort(high)
    new = _runs(high[order])
    if any(((x[order][1:] != x[order][:-1]) & ~new[1:]).any() for x in rest):
        order, first = _firsts(doc, high, *rest)
        return order, _runs(high[order], *(x[order] for x in rest)), first
    return order, new, np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]


PARSE, REPLY, TEXT = 0, 1, 2


def parse(docs: DataFrame, parts: int, repeats: bool = True) -> DataFrame:
    """Packed rows of the parse by bucket of their triggers. Phrases that an earlier document of the same pack has are
    settled here, so a phrase that very many documents share is sent once a pack."""

    def packs(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, high, low, doc, text, start, windows, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, _, first = _named(doc, high, low, key)
        late = np.zeros(len(doc), bool)
        late[order] = doc[order] > first
        early = ~late
        found = list(_by_bucket(dealt_to(key[early], parts), PARSE, *(x[early] for x in (key, high, low, doc, text, start, windows, left, right))))
        if late.any():
            found += _by_bucket(home(doc[late], text[late], parts), REPLY, doc[late], text[late], start[late], windows[late], np.zeros(int(late.sum()), np.uint32))
        return _rows(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in slices(batches, "text", PARSE_BYTES):
            ids = b.column("doc_id")
            texts = [v if ok else v[:0] for v, ok in zip(views(b.column("text")), ids.is_valid().to_pylist(), strict=True)]
            p = Parses(texts, repeats)
            if not len(p.doc):
                continue
            doc = ids.fill_null(0).to_numpy().astype(np.int64)[p.doc]
            held.append((p.key, p.name[:, 0], p.name[:, 1].astype(np.uint32), doc, p.text_hash[p.doc], p.start.astype(np.uint32), p.windows.astype(np.uint16), p.sides[:, 0], p.sides[:, 1]))
            if sum(len(x[0]) for x in held) >= PACKED:
                yield packs(held)
        if held:
            yield packs(held)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, kind int, value binary")


def contested(key: np.ndarray, *codes: np.ndarray) -> np.ndarray:
    """Which distinct phrases may have a window in common with another: they share a trigger and a code, or phrases without codes have their trigger."""
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    out = np.zeros(len(key), bool)
    own = np.flatnonzero(count[number] > 1)
    number = number[own]
    any_ = np.zeros(len(count), bool)
    any_[number[~np.logical_or.reduce([c[own] > 0 for c in codes])]] = True
    out[own] = any_[number]
    for c in codes:
        _, same, times = np.unique(number * (1 << 16) + c[own], return_inverse=True, return_counts=True)
        out[own] |= (times[same] > 1) & (c[own] > 0)
    return out


def settle(rows: DataFrame, parts: int) -> DataFrame:
    """Replies to the documents: phrases that are covered, with key 0, and those whose bytes are needed, with their key."""

    def work(own: list[bytes]) -> pa.RecordBatch | None:
        key, high, low, doc, text, start, windows, left, right = joined(own)
        own.clear()
        order, new, first = _named(doc, high, low, key)
        open_ = contested(*(x[order[new]] for x in (key, left, right)))[np.cumsum(new) - 1]
        key, doc, text, start, windows = (x[order] for x in (key, doc, text, start, windows))
        covered = doc > first
        send = covered | open_
        if not send.any():
            return None
        tag = np.where(covered, 0, np.maximum(key, 1)).astype(np.uint32)
        return _rows(list(_by_bucket(home(doc[send], text[send], parts), REPLY, doc[send], text[send], start[send], windows[send], tag[send])))

    return gathered(rows, parts).mapInArrow(lambda batches: _by_turns(batches, work), "bucket int, kind int, value binary")


def repeated(doc: np.ndarray, at: np.ndarray, size: np.ndarray, windows: np.ndarray, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows, by phrase and place in it, whose hash several documents have; any other is alone in its group."""
    hashes, i = [], 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + HASH_BYTES)))
        every = Rolling(data[at[i] : at[j - 1] + size[j - 1]]).every(depth)
        inside = np.ones(len(every), bool)
        gap = (at[i + 1 : j] - at[i])[:, None] - np.arange(1, depth)
        inside[gap.ravel()] = False
        hashes.append(every[inside])
        i = j
    hashed = np.concatenate(hashes)
    which = np.repeat(np.arange(len(at), dtype=np.int32), windows)
    order = np.argsort(hashed)
    new = _runs(hashed[order])
    own, edge = doc[which[order]], np.flatnonzero(new)
    several = np.zeros(len(which), bool)
    several[order] = (np.minimum.reduceat(own, edge) < np.maximum.reduceat(own, edge))[np.cumsum(new) - 1]
    take = np.flatnonzero(several)
    which = which[take]
    return which, take - (np.cumsum(windows.astype(np.int64)) - windows)[which]


def sort_suffixes(rows: DataFrame, parts: int, depth: int = DEPTH) -> DataFrame:
    """Replies from the dictionary phrases of each bucket: their suffixes, sorted to the depth, in groups of equals."""

    def work(own: list[bytes]) -> pa.RecordBatch | None:
        doc, text, start, windows, data = joined(own)
        own.clear()
        size = windows.astype(np.int64) + depth - 1
        at = np.cumsum(size) - size
        which, nth = repeated(doc, at, size, windows, data, depth)
        if not len(which):
            return None
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
        place = at[which] + nth
        columns = [eights[place + 8 * i] if 8 * i + 8 <= depth else eights[place + 8 * i] >> np.uint64(8 * (8 * i + 8 - depth)) for i in range(-(-depth // 8))]
        order, first = _firsts(doc[which], *(c.astype(np.uint64) for c in columns))
        late = np.zeros(len(which), bool)
        late[order] = doc[which[order]] > first
        which, nth = which[late], nth[late]
        if not len(which):
            return None
        new = _runs(which, nth - np.arange(len(nth)))
        w, s = which[new], (start[which] + nth)[new].astype(np.uint32)
        size = np.diff(np.append(np.flatnonzero(new), len(which))).astype(np.uint16)
        return _rows(list(_by_bucket(home(doc[w], text[w], parts), REPLY, doc[w], text[w], s, size, np.zeros(len(w), np.uint32))))

    return gathered(rows, parts).mapInArrow(lambda batches: _by_turns(batches, work), "bucket int, kind int, value binary")


def removed(size: int, start: np.ndarray, windows: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which bytes the windows that start there cover."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(start.astype(np.int64) + windows + depth - 1, size), -1)
    return np.cumsum(change[:size]) > 0


def _meet(texts: DataFrame, replies: DataFrame, parts: int) -> DataFrame:
    """Texts and what is known of them in the same partitions, replies first."""
    extra = [f for f in texts.schema.fields if f.name not in ("bucket", "kind", "value")]
    replies = replies.select("bucket", "kind", "value", *(F.lit(None).cast(f.dataType).alias(f.name) for f in extra))
    return gathered(replies.select(*texts.columns).unionByName(texts), parts)


def _answer(parts: int, kept: list[str], last: bool):
    """For each text either its result, or, if bytes are needed that aren't settled yet, what is known so far."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "value", PARSE_BYTES):
            bucket = b.column("bucket").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), b.num_rows]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                yield b.slice(i, j - i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index, at = [], {}, None
        for b in pieces(batches):
            values, kinds, bucket = views(b.column("value")), b.column("kind").to_pylist(), b.column("bucket")[0].as_py()
            if bucket != at:
                known, index, at = [], None, bucket
            known += [bytes(v) for v, k in zip(values, kinds, strict=True) if k == REPLY]
            texts = [i for i, k in enumerate(kinds) if k == TEXT]
            if not texts:
                continue
            if index is None:
                doc, text, start, windows, tag = joined(known) if known else [np.empty(0, d) for d in (np.int64, np.uint64, np.uint32, np.uint16, np.uint32)]
                order = np.lexsort((text, doc))
                doc, text, start, windows, tag = (x[order] for x in (doc, text, start, windows, tag))
                edge = np.flatnonzero(_runs(doc, text)).tolist() if len(doc) else []
                index = {(int(doc[a]), int(text[a])): (a, z) for a, z in zip(edge, [*edge, len(doc)][1:], strict=True)}
                known = []
            new: dict[str, list] = {n: [] for n, _ in NEW} | {"text": [], "open": []}
            ids, hashes = b.column("_doc").to_pylist(), b.column("_text_hash").to_pylist()
            own = b.column("_known").to_pylist() if last else None
            for i in texts:
                data = zstandard.ZstdDecompressor().decompress(values[i])
                a, z = index.get((ids[i], hashes[i] & 0xFFFFFFFFFFFFFFFF), (0, 0)) if ids[i] is not None else (0, 0)
                s, w, t = start[a:z], windows[a:z], tag[a:z]
                if last and own[i]:
                    s, w = (np.concatenate(x) for x in zip((s, w), unpacked(own[i]), strict=True))
                    t = np.zeros(len(s), np.uint32)
                if t.any():
                    need = t > 0
                    values_ = {"open": packed(s[~need], w[~need], s[need], w[need], t[need]), "text": None} | {n: None for n, _ in NEW}
                else:
                    gone = removed(len(data), s, w)
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    values_ = {"open": None, "text": left.decode("utf-8", "ignore"), "n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest()}
                for n, v in values_.items():
                    new[n].append(v)
            take = pa.array(texts)
            columns = [b.column(c).take(take) for c in kept]
            columns += [pa.array(new[n], {"long": pa.int64(), "string": pa.string()}[t.typeName()]) for n, t in NEW] + [pa.array(new["text"], pa.string())]
            names = [*kept, *(n for n, _ in NEW), "_clean"]
            if not last:
                columns += [pa.array(new["open"], pa.binary()), pa.array([bytes(values[i]) if o else None for i, o in zip(texts, new["open"], strict=True)], pa.binary())]
                names += ["_open", "_value"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def deduplicate(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256, and their texts without the repeated strings.

    A removed string may cut a character in two; in the text such bytes are left out, the hash is of all that are kept.
    """
    docs = without(docs, [n for n, _ in NEW])
    parts = parts or min(BUCKETS, 1 + (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // BUCKET_BYTES)
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count()
    repeats = bool(ids.filter("count > 1").limit(1).count())
    others = [f for f in docs.schema.fields if f.name != "text"]
    kept = ["_doc", "_text_hash", "_row"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", PARSE_BYTES):
            data = views(b.column("text"))
            hashes = text_hashes(data, repeats)
            doc = b.column("_doc").fill_null(0).to_numpy()
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home(doc, hashes, parts).astype(np.int32)), pa.array(np.full(len(data), TEXT, np.int32)), pa.array([z.compress(t) for t in data], pa.binary()), b.column("_doc"), pa.array(hashes.view(np.int64)), b.column("_row")],
                names=["bucket", "kind", "value", *kept],
            )

    row = F.struct(*(F.col(f.name) for f in others)) if others else F.struct(F.lit(0).alias("_none"))
    source = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"), row.alias("_row"))
    row_type = source.schema["_row"]
    held = [T.StructField("_doc", T.LongType()), T.StructField("_text_hash", T.LongType()), T.StructField("_row", row_type.dataType)]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.BinaryType()), *held])
    done = [*held, *(T.StructField(n, t) for n, t in NEW), T.StructField("_clean", T.StringType())]

    replies = stored(settle(parse(docs, parts, repeats), parts), "replies")
    met = _meet(source.mapInArrow(texts, schema), replies, parts)
    once = stored(met.mapInArrow(_answer(parts, kept, False), T.StructType([*done, T.StructField("_open", T.BinaryType()), T.StructField("_value", T.BinaryType())])), "once")

    def phrase_packs(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        doc, text, s, w, t, data = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = dealt_to(t, parts)
        order, edges = _of_buckets(bucket)
        size = w.astype(np.int64) + DEPTH - 1
        begin = (np.cumsum(size) - size)[order]
        doc, text, s, w, size, bucket = (x[order] for x in (doc, text, s, w, size, bucket))
        ends = np.cumsum(size)
        data = data[np.repeat(begin - ends + size, size) + np.arange(len(data))]
        found = []
        for i, j in zip(edges, [*edges[1:], len(s)], strict=True):
            found.append((int(bucket[i]), PARSE, packed(doc[i:j], text[i:j], s[i:j], w[i:j], data[ends[i] - size[i] : ends[j - 1]])))
        return _rows(found)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in slices(batches, "_value", PARSE_BYTES // 2):
            for d, h, o, v in zip(b.column("_doc").to_pylist(), b.column("_text_hash").to_pylist(), views(b.column("_open")), views(b.column("_value")), strict=True):
                _, _, s, w, t = unpacked(o)
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(v), np.uint8)
                size = w.astype(np.int64) + DEPTH - 1
                at = np.repeat(s.astype(np.int64) - np.cumsum(size) + size, size) + np.arange(size.sum())
                held.append([np.full(len(s), d, np.int64), np.full(len(s), h, np.int64).view(np.uint64), s, w, t, data[at]])
            if sum(len(x[-1]) for x in held) >= PACKED_BYTES:
                yield phrase_packs(held)
        if held:
            yield phrase_packs(held)
        give_back()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = b.column("_text_hash").to_numpy().astype(np.int64).view(np.uint64)
            ready = [packed(*unpacked(o)[:2]) for o in views(b.column("_open"))]
            doc = b.column("_doc").fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(home(doc, hashes, parts).astype(np.int32)), pa.array(np.full(b.num_rows, TEXT, np.int32)), b.column("_value"), *(b.column(c) for c in kept), pa.array(ready, pa.binary())], names=["bucket", "kind", "value", *kept, "_known"])

    waiting = once.filter("_open IS NOT NULL")
    more = sort_suffixes(waiting.select("_doc", "_text_hash", "_open", "_value").mapInArrow(phrases, "bucket int, kind int, value binary"), parts)
    met = _meet(waiting.mapInArrow(again, T.StructType([*schema.fields, T.StructField("_known", T.BinaryType())])), more, parts)
    rest = met.mapInArrow(_answer(parts, kept, True), T.StructType(done))
    out = once.filter("_open IS NULL").select(*(f.name for f in done)).unionByName(rest)
    columns = [F.col("_clean").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*columns, *(n for n, _ in NEW))

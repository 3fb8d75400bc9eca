"""Token counts by dynamic programming over prefixes.

In byte-level BPE the last token of a prefix's encoding is the one token that ends there and follows the last token of
what is left validly: two tokens follow each other validly if the library encodes their joined bytes as just these two.
So a table over a word's prefixes gives the exact number of tokens of each, from left to right, and how many tokens a
text has when it is cut anywhere, or where to cut it for a budget, needs no further encoding. The tables of a batch's
distinct words are filled together, position by position.

Defined results: a null or empty text has 0 tokens and 0 bytes; a text with an added token's string, or with letters
newer than the rules know, is counted by the library whole; repeated rows are each counted; texts of any length are
counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import ENCODE_BYTES, PRINTABLE, Batch, Encoder, Memory, decoded, encoder, vocabulary
from .common import Rolling, lengths, mix, slices, views, without

#: Words of more bytes than this have a table each.
SHORT = 48
#: Places of a long word whose candidates are held at a time.
CHUNK = 4096
#: Pairs of tokens of which a process remembers whether they follow each other, at most, as a power of two.
PAIRS = 20


class PrefixTables:
    def __init__(self, path: str):
        self.encoder: Encoder = encoder(path)
        back = {v: k for k, v in PRINTABLE.items()}
        added = set(self.encoder.specials)
        tokens = {i: bytes(back.get(ord(c), ord(c)) for c in s) for s, i in self.encoder.library.get_vocab(with_added_tokens=False).items() if s not in added}
        self.tokens = tokens
        self.spelt = {i: t.decode("latin-1").translate(PRINTABLE) for i, t in tokens.items()}
        self.longest = max(map(len, tokens.values()))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(t) for t in tokens.values()}):
            own = [(i, t) for i, t in tokens.items() if len(t) == n]
            spelt = np.frombuffer(b"".join(t for _, t in own), np.uint8).reshape(-1, n)
            at = np.arange(len(own)) * n
            h, ids = Rolling(spelt.ravel()).of(at, at + n), np.array([i for i, _ in own], np.int64)
            order = np.argsort(h)
            if (np.diff(h[order]) == 0).any():
                raise ValueError("two tokens share a hash")
            self.by_length[n] = h[order], ids[order], spelt[order]
        self.pairs, self.valid = np.zeros(1 << PAIRS, np.uint64), np.zeros(1 << PAIRS, bool)
        self.memory = Memory()

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right token can follow its left one; left is -1 at a word's start."""
        keys = ((left + 2).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        place = (mix(keys) >> np.uint64(64 - PAIRS)).astype(np.int64)
        out = self.valid[place]
        new = np.flatnonzero(self.pairs[place] != keys)
        if len(new):
            tokenize, found = self.encoder.model.tokenize, {}
            for k in np.unique(keys[new]).tolist():
                a, b = (k >> 32) - 2, k & 0xFFFFFFFF
                got = [t.id for t in tokenize((self.spelt[a] if a >= 0 else "") + self.spelt[b])]
                found[k] = got == ([a, b] if a >= 0 else [b])
            out[new] = [found[k] for k in keys[new].tolist()]
            # one pair for each place, in the stead of that which was there
            one = new[np.unique(place[new], return_index=True)[1]]
            self.pairs[place[one]], self.valid[place[one]] = keys[one], out[one]
        return out

    def _candidates(self, hashes: Rolling, start: np.ndarray, n: int) -> np.ndarray:
        """The token that spells the n bytes from each start, or -1: found by hash, settled by its bytes."""
        known, ids, spelt = self.by_length[n]
        h = hashes.of(start, start + n)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        out = np.full(len(start), -1, np.int64)
        like = np.flatnonzero(known[at] == h)
        same = (hashes.data[start[like][:, None] + np.arange(n)] == spelt[at[like]]).all(axis=1)
        out[like[same]] = ids[at[like[same]]]
        return out

    def tables(self, words: list[bytes]) -> list[np.ndarray]:
        """For each word, the number of tokens of each of its prefixes, from the empty one to the whole."""
        out: list[np.ndarray] = [np.zeros(1, np.int64)] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = self._long(words[i])
        own = np.flatnonzero((size > 0) & (size <= SHORT))
        if len(own):
            width = int(size[own].max())
            count = self._short([words[i] for i in own.tolist()], size[own], width)
            for k, i in enumerate(own.tolist()):
                out[i] = count[k, : size[i] + 1]
        return out

    def _short(self, words: list[bytes], size: np.ndarray, width: int) -> np.ndarray:
        flat = Rolling(np.frombuffer(b"".join(words), np.uint8))
        base = np.cumsum(size) - size
        last = np.full((len(words), width + 1), -1, np.int64)
        count = np.zeros((len(words), width + 1), np.int64)
        for end in range(1, width + 1):
            rows = np.flatnonzero(size >= end)
            word, back, token = [], [], []
            for n in range(1, min(end, self.longest) + 1):
                if n in self.by_length:
                    t = self._candidates(flat, base[rows] + end - n, n)
                    has = t >= 0
                    word.append(rows[has])
                    back.append(np.full(int(has.sum()), end - n))
                    token.append(t[has])
            word, back, token = np.concatenate(word), np.concatenate(back), np.concatenate(token)
            fine = self.follows(last[word, back], token)
            word, back, token = word[fine], back[fine], token[fine]
            last[word, end] = token
            count[word, end] = count[word, back] + 1
        return count

    def _long(self, word: bytes) -> np.ndarray:
        """The same for one word, with the candidates of CHUNK places at a time."""
        flat, n = Rolling(np.frombuffer(word, np.uint8)), len(word)
        last, count, known = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64), {}
        for base in range(0, n, CHUNK):
            ends: list[list[tuple[int, int]]] = [[] for _ in range(min(CHUNK, n - base))]
            for m in self.by_length:
                start = np.arange(max(0, base + 1 - m), base + len(ends) - m + 1)
                if len(start):
                    t = self._candidates(flat, start, m)
                    for i in np.flatnonzero(t >= 0).tolist():
                        s = int(start[i])
                        ends[s + m - base - 1].append((s, int(t[i])))
            if len(known) > 1 << 16:
                known.clear()
            for end, own in enumerate(ends, base + 1):
                for s, t in own:
                    key = (int(last[s]), t)
                    if key not in known:
                        known[key] = bool(self.follows(np.array([key[0]]), np.array([t]))[0])
                    if known[key]:
                        last[end], count[end] = t, count[s] + 1
                        break
        return count

    def _totals(self, words: list[bytes]) -> list[int]:
        size = np.array([len(w) for w in words])
        total = np.zeros(len(words), np.int64)
        for low, high in ((1, 8), (8, 12), (12, 20), (20, SHORT + 1)):
            own = np.flatnonzero((size >= low) & (size < high))
            if len(own):
                table = self._short([words[i] for i in own.tolist()], size[own], int(size[own].max()))
                total[own] = table[np.arange(len(own)), size[own]]
        for i in np.flatnonzero(size > SHORT).tolist():
            total[i] = self._long(words[i])[-1]
        return total.tolist()

    def count(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text."""
        batch = Batch(texts, self.encoder.specials)
        totals = np.array(self.memory.find(batch.distinct, self._totals) if batch.distinct else [], np.int64)
        sums = np.concatenate([[0], np.cumsum(totals[batch.which])]) if len(batch.which) else np.zeros(1, np.int64)
        out = sums[batch.bounds[1:]] - sums[batch.bounds[:-1]]
        for i in batch.slow:
            out[i] = len(self.encoder.library.encode(texts[i], add_special_tokens=False).ids)
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """The tokens of each prefix of the text, as many code points as its place says.

        A word's last prefix is its whole; within a word, the text before it keeps its tokens. White space before a word
        is joined when the text ends inside it, as the pattern does, so each such run has a table of its own.
        """
        batch = Batch([text], self.encoder.specials)
        if batch.slow:
            return np.array([len(self.encoder.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], np.int64)
        out, before = np.zeros(len(text) + 1, np.int64), [0] * (len(text) + 1)
        for a, b in zip(batch.start.tolist(), batch.stop.tolist(), strict=True):
            word = text[a:b]
            table = self.tables([word.encode()])[0]
            out[a + 1 : b + 1] = before[a] + table[np.cumsum([len(c.encode()) for c in word])]
            before[b] = before[a] + int(table[-1])
            run = a
            while run and text[run - 1].isspace():
                run -= 1
            if word[0].isspace() and run < a and len(word.strip()) != len(word):  # cut after this word's first blank: one run with those before
                out[a + 1] = before[run] + self.tables([text[run : a + 1].encode()])[0][-1]
            if word[0] == "'" and b - a == 3 and word[1:].isalpha():  # 're, 've, 'll: cut inside, the quote stands alone
                out[a + 2] = before[a] + self.tables([b"'"])[0][-1] + self.tables([word[1:2].encode()])[0][-1]
        return out

    def cut(self, text: str, budget: int) -> str:
        """The longest prefix of at most so many tokens."""
        return text[: int(np.flatnonzero(self.prefixes(text) <= budget)[-1])]


@lru_cache(2)
def prefix_tables(path: str) -> PrefixTables:
    return PrefixTables(path)


NEW = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]


def count_tokens(docs: DataFrame, text: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit); columns with these names are replaced."""
    docs = without(docs, [n for n, _ in NEW])
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = prefix_tables(path)
        for b in slices(batches, text, ENCODE_BYTES):
            n = tables.count(decoded(views(b.column(text))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths(b.column(text))), pa.array(n), pa.array(n > limit)], names=[*b.schema.names, *(k for k, _ in NEW)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in NEW)]))


def cut_to_budget(docs: DataFrame, budget: int, text: str = "text", path: str | None = None) -> DataFrame:
    """docs whose texts are cut to the longest prefixes of at most budget tokens; null stays null."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = prefix_tables(path)
        for b in slices(batches, text, ENCODE_BYTES):
            place = b.schema.names.index(text)
            short = pa.array([None if t is None else tables.cut(t, budget) for t in b.column(text).to_pylist()], b.column(text).type)
            yield b.set_column(place, text, short)

    return docs.mapInArrow(run, docs.schema)

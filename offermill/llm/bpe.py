"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

A byte-level BPE vocabulary splits a text into words by a fixed pattern and encodes each word by itself. So the words of
a batch are found by vectorised rules for that pattern, each distinct word is given to the library, and a text's ids are
its words' ids in order. Texts for which those rules may not hold (with an added token's string, or with letters and
digits newer than Unicode 3.2, on which versions of the library may differ) are given to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

from .common import rows_of, strings

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, BLANK, RARE = range(5)
#: Code points from here on go to the library with their whole text.
_FAR = 0x20000
#: Words of a generation that a process remembers, and their bytes, at most; it remembers two.
REMEMBERED, REMEMBERED_BYTES = 250_000, 8 << 20
#: Text bytes that are encoded in one step.
ENCODE_BYTES = 1 << 20

def _printable() -> dict[int, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


PRINTABLE = _printable()
_BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point below _FAR."""
    out = np.zeros(_FAR, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    for i in range(_FAR):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            out[i] = (LETTER if kind == "L" else NUMBER) if old(chr(i))[0] == kind else RARE
    out[_BLANKS] = BLANK
    return out


def word_starts(points: np.ndarray, kind: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where words start, by 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.

    fresh: where texts start, always True at 0.
    """
    n = len(points)
    run = fresh.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    begin = np.flatnonzero(run)
    end = np.append(begin[1:], n)
    blank = kind[begin] == BLANK
    after = end[blank]
    after = after[after < n]
    after = after[~fresh[after]]
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    mark = begin[(points[begin] == 0x27) & (end - begin == 1)]
    mark = mark[start[mark] & (mark + 1 < n)]
    mark = mark[~fresh[mark + 1]]
    if len(mark):
        one = points[mark + 1]
        two = np.where((mark + 2 < n) & ~fresh[np.minimum(mark + 2, n - 1)], points[np.minimum(mark + 2, n - 1)], 0)
        is_in = lambda x, s: np.isin(x, [ord(c) for c in s])
        size = np.where(is_in(one, "stmd"), 2, np.where((is_in(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))), 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        rest = mark + size
        rest = rest[rest < n]
        start[rest[(kind[rest] == LETTER) & ~fresh[rest]]] = True
    return np.flatnonzero(start)


class Batch:
    """The words of some texts: where each starts, the distinct ones, and which of them it is. Words are told apart by their bytes."""

    def __init__(self, texts: list[str], specials: list[str]):
        self.texts = texts
        self.joined = "".join(texts)
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        self.ends = np.cumsum([len(t) for t in texts])
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        table = classes()
        kind = table[np.minimum(points, _FAR - 1)]
        far = points >= _FAR
        if far.any():
            kind = np.where(far, RARE, kind)
        odd = kind == RARE
        slow = np.zeros(len(texts), bool)
        if odd.any():
            total = np.concatenate([[0], np.cumsum(odd)])
            slow = total[self.ends] > total[self.begins]
        for s in specials:
            if s in self.joined:
                slow |= np.array([s in t for t in texts])
        self.slow = np.flatnonzero(slow).tolist()
        if not n:
            self.start = self.stop = np.empty(0, np.int64)
            self.distinct: list[bytes] = []
            self.which = self.start
            self.bounds = np.zeros(len(texts) + 1, np.int64)
            return
        fresh = np.zeros(n + 1, bool)
        fresh[self.begins] = True
        fresh = fresh[:n]
        self.start = word_starts(points, kind, fresh)
        self.stop = np.append(self.start[1:], n)
        width = np.ones(n, np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        at = np.concatenate([[0], np.cumsum(width)])
        words = rows_of(self.joined.encode("utf-8", "surrogatepass"), at[np.append(self.start, n)]).dictionary_encode()
        self.distinct = strings(words.dictionary)
        self.which = words.indices.to_numpy().astype(np.int64)
        self.bounds = np.append(np.searchsorted(self.start, self.begins), len(self.start))


class Memory:
    """What is known of words, by their bytes. When a generation is full, words not asked for since the one before are forgotten."""

    def __init__(self):
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.held = 0

    def find(self, words: list[bytes], make: Callable[[list[bytes]], Iterable]) -> list:
        """What is known of each word; make gives it for those that are new."""
        young, old = self.young, self.old
        out = [young.get(w) for w in words]
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            x = out[i] = old.get(words[i])
            if x is None:
                new.append(i)
            else:
                young[words[i]] = x
        for i, x in zip(new, make([words[i] for i in new]) if new else (), strict=True):
            out[i] = young[words[i]] = x
            self.held += len(words[i])
        if len(young) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.old, self.young, self.held = young, {}, 0
        return out


class Encoder:
    """Ids of texts for one vocabulary file; a process keeps the words that it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            self.specials = [t["content"] for t in json.load(f).get("added_tokens") or []]
        self.memory = Memory()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """By the library's model alone: it takes a word as the printable characters that stand for its bytes. Ids of four bytes."""
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(w.decode("latin-1").translate(PRINTABLE))]).tobytes() for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin, with the end."""
        batch = Batch(texts, self.specials)
        own = self.memory.find(batch.distinct, self.encode_words) if batch.distinct else []
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, at = np.frombuffer(b"".join(own), np.uint32), np.cumsum(size) - size
        count, at = size[batch.which], at[batch.which]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(at - ends + count, count) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[batch.bounds]
        if batch.slow:
            parts = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            for i in batch.slow:
                parts[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            ids, offsets = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, offsets


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decoded(views: list[memoryview]) -> list[str]:
    return [str(v, "utf-8", "replace") for v in views]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

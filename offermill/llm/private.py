"""Personal data by patterns and by a semi-Markov conditional random field.

Patterns give the base spans of four kinds, each kind's leftmost ones that don't overlap. They are searched so that no
text takes more than linear time. The field finds what patterns miss, such as numbers in other punctuation and addresses
that are spelled out. Around digits and address signs a text is cut into atoms (runs of digits, runs of letters, single
signs). Every run of up to LONGEST atoms is a candidate segment, and features of the whole of it (how many digits in how
many groups, check digit, signs, what stands before and after) score it for each kind. The best segmentation, boundaries
and kinds together, is found by dynamic programming over segments of bounded length; atoms outside of segments score 0,
so stretches without a candidate need no work. Weights are trained in numpy by the gradient of the likelihood, from
forward and backward sums, on lines made by rule and on stretches of a bounded sample of documents, labelled by the base.

The field's spans must win by MARGIN, and those that overlap a base span give way to it: base spans always stay.

Defined results: null text is empty and has no spans; repeated rows, rows without doc_id and empty texts each have a row;
an empty table has none; columns but doc_id and text are not read. Offsets count code points. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: Atoms of a segment, at most; nats by which a segmentation must be better for each of its segments.
LONGEST, MARGIN = 24, 3.0
#: Documents of the sample whose stretches are learned from, at most, stretches of it, and lines made by rule.
SAMPLE, STRETCHES, LINES = 2000, 150, 450
STEP = 2 << 20
#: Starts of candidates that are scored at a time.
STARTS = 4096

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9]([ ().0-9-]++)")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = sum(map(int, number[::-2])) + sum((2 * int(d)) % 10 + int(d) // 5 for d in number[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where its local part's run of signs does, or where the address before it ends."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 14 <= len(d := digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        rest = m[1].rstrip(" ().-")
        if len(rest) > 1 and 10 <= len(digits(rest)) + 1 <= 15:
            yield m.start(), m.start(1) + len(rest)


def base(text: str) -> list[tuple[int, int, int]]:
    """start, kind and end of all base spans, in order."""
    return sorted((a, k, z) for k, found in enumerate((emails, ips, cards, phones)) for a, z in found(text))


# Candidates

_NUMBERS = re.compile(r"[0-9](?:[ ().\-\[\]/+]{0,3}[0-9])*+")
_SIGNS = re.compile(r"@|(?<![A-Za-z])[Dd][Oo][Tt](?![A-Za-z])")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
#: Characters before and after an address sign that may belong to it.
_BEFORE, _AFTER = 80, 100
_CODES = {c: i for i, c in enumerate(" .-()+@[]/_", 2)}
_DIGIT, _LETTER, _SPACE, _DOT, _DASH, _OPEN, _CLOSE, _PLUS, _AT, _BRACKET, _BRACKET2, _SLASH, _UNDER, _OTHER, _BARRIER = range(15)


def stretches(text: str) -> list[tuple[int, int]]:
    """Where candidates can be: numbers of enough digits and their surroundings, and what is around address signs."""
    found = []
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() > 6 and len(digits(m[0])) >= 7 or m[0].count(".") >= 3:
            found.append((max(0, m.start() - 4), min(len(text), m.end() + 4)))
    found += [(max(0, m.start() - _BEFORE), min(len(text), m.end() + _AFTER)) for m in _SIGNS.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, z in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


class Atoms:
    """Atoms of many stretches in a row, with a barrier after each, and sums up to each atom."""

    def __init__(self, parts: list[tuple[int, str, int, int]]):
        """parts: number of the text, text, start, end."""
        text, start, end, code, size, big, at, dot, number = [], [], [], [], [], [], [], [], []

        def put(t, s, e, c, n=0, b=0, w=0, d=0):
            text.append(t)
            start.append(s)
            end.append(e)
            code.append(c)
            size.append(n)
            big.append(b)
            at.append(w)
            dot.append(d)

        put(-1, 0, 0, _BARRIER)
        for t, whole, a, z in parts:
            for m in _ATOM.finditer(whole, a, z):
                x, s, e = m[0], m.start(), m.end()
                if "0" <= x[0] <= "9":
                    n = x.lstrip("0")
                    cut = s == a and s > 0 and whole[s - 1].isalnum() or e == z and e < len(whole) and whole[e].isalnum()
                    put(t, s, e, _OTHER if cut else _DIGIT, 0 if cut else e - s, len(n) > 3 or int(n or "0") > 255)
                    number.append("" if cut else x)
                elif x[0] in _LOCAL_SIGNS and x[0].isalpha():
                    cut = s == a and s > 0 and whole[s - 1].isalnum() or e == z and e < len(whole) and whole[e].isalnum()
                    w = x.lower() if e - s < 4 else ""
                    put(t, s, e, _OTHER if cut else _LETTER, 0, 0, w == "at", w == "dot")
                else:
                    put(t, s, e, _CODES.get(x, _OTHER))
            put(-1, z, z, _BARRIER)
        whole = lambda x: np.array(x, np.int64)
        self.text, self.start, self.end, self.code, self.size = map(whole, (text, start, end, code, size))
        self.at, self.dot = np.array(at, bool), np.array(dot, bool)
        sums = lambda x: np.append(0, np.cumsum(x))
        self.digits, self.big, self.ats, self.dots = (sums(x) for x in (self.size, whole(big), self.at, self.dot))
        self.codes = np.concatenate([np.zeros((1, _BARRIER + 1), np.int64), np.cumsum(self.code[:, None] == np.arange(_BARRIER + 1), axis=0)])
        d = np.frombuffer("".join(number).encode(), np.uint8).astype(np.int64) - 48
        double, odd = (2 * d) % 10 + d // 5, np.arange(len(d)) % 2 == 1
        self.luhn = np.stack([sums(np.where(odd, d, double)), sums(np.where(odd, double, d))])

    def candidates(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one atoms of all candidates that start between two atoms."""
        edge = np.isin(self.code, (_DIGIT, _LETTER, _OPEN, _PLUS))
        last = np.isin(self.code, (_DIGIT, _LETTER, _CLOSE))
        i = np.arange(a, z)
        j = i[:, None] + np.arange(1, LONGEST + 1)
        fine = edge[i][:, None] & (j <= len(self.code)) & last[np.minimum(j, len(self.code)) - 1]
        fine &= self.codes[np.minimum(j, len(self.code)), _BARRIER] == self.codes[i, _BARRIER][:, None]
        which, length = np.nonzero(fine)
        return i[which], i[which] + length + 1

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, groups = self.digits[j] - self.digits[i], self.codes[j, _DIGIT] - self.codes[i, _DIGIT]
        has = lambda c: self.codes[j, c] - self.codes[i, c]
        first, last, before, after = self.code[i], self.code[j - 1], self.code[i - 1], self.code[j]
        after2, before2 = self.code[np.minimum(j + 1, len(self.code) - 1)], self.code[np.maximum(i - 2, 0)]
        ats, dots, small = self.ats[j] - self.ats[i], self.dots[j] - self.dots[i], self.big[j] == self.big[i]
        parity = self.digits[j] % 2
        check = (self.luhn[parity, self.digits[j]] - self.luhn[parity, self.digits[i]]) % 10 == 0
        alnum, joins = (lambda c: c <= _LETTER), (lambda c: np.isin(c, (_DOT, _DASH, _PLUS, _AT, _SLASH, _UNDER)))
        tail = (last == _LETTER) & (self.end[j - 1] - self.start[j - 1] <= 6) & (self.end[j - 1] - self.start[j - 1] >= 2)
        signs = has(_AT) + ats
        long = (n >= 14) & (n <= 19)
        back = self.code[np.maximum(j - 2, i)]
        point = (back == _DOT) | self.dot[np.maximum(j - 3, i)] | self.dot[np.maximum(j - 4, i)]
        mail = (signs == 1) & tail & point & (has(_OTHER) == 0) & ((has(_SPACE) == 0) | (has(_SPACE) == 2 * (ats + dots)))
        columns = [
            np.ones(len(i), bool), n == 0, (n > 0) & (n < 7), (n >= 7) & (n < 10), n == 10, n == 11, (n == 12) | (n == 13), (n == 14) | (n == 15), n == 16, (n >= 17) & (n <= 19), n > 19,
            groups == 0, groups == 1, groups == 2, groups == 3, groups == 4, groups > 4,
            first == _PLUS, first == _OPEN, first == _DIGIT, first == _LETTER, last == _DIGIT, last == _LETTER, last == _CLOSE,
            *(has(c) > 0 for c in (_DOT, _DASH, _SPACE, _OPEN, _PLUS, _AT, _BRACKET, _SLASH, _OTHER, _LETTER)),
            has(_OPEN) != has(_CLOSE), has(_PLUS) > 1, has(_SPACE) > groups + has(_LETTER), signs == 1, signs > 1, dots > 0, ats == 1,
            (groups == 4) & small & (has(_LETTER) == 0), (groups == 4) & small & (has(_LETTER) == 0) & (has(_DOT) == 3) & (has(_DASH) + has(_SLASH) == 0), long & check, long & ~check,
            (n == 10) & (groups == 3) & (has(_LETTER) == 0), (n == 11) & (groups == 4) & (has(_LETTER) == 0), (n >= 10) & (n <= 13) & (groups >= 2) & (first == _PLUS),
            (signs == 1) & tail & point, mail, mail & (first <= _LETTER) & ~alnum(before) & ~joins(before), mail & (after != _AT) & ~alnum(after) & ~(joins(after) & alnum(after2)), (has(_LETTER) > 0) & (signs == 0),
            ~alnum(before) & ~joins(before), ~alnum(after) & ~joins(after),
            alnum(before), joins(before) & alnum(before2), before == _PLUS, before == _AT, alnum(after), joins(after) & alnum(after2), after == _AT, (after == _SPACE) & (after2 == _DIGIT), (before == _SPACE) & (before2 == _DIGIT),
            (after == _SPACE) & self.dot[np.minimum(j + 1, len(self.code) - 1)], (before == _SPACE) & self.at[np.maximum(i - 2, 0)],
        ]
        return np.stack(columns, axis=1).astype(np.float32)


# The field


def _sum(x: np.ndarray, axis) -> np.ndarray:
    """log of the sum of exponentials; -inf of nothing."""
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """weights: kinds by features; after: what a kind right after another adds."""

    def __init__(self, weights: np.ndarray, after: np.ndarray):
        self.weights, self.after = weights, after

    def spans(self, atoms: Atoms, margin: float = MARGIN) -> list[tuple[int, int, int, int]]:
        """text, start, kind and end of the segments of the best segmentation."""
        worst = margin - 2 * max(0.0, float(self.after.max()))
        kept: list[tuple[int, int, int, float]] = []
        for a in range(1, len(atoms.code), STARTS):
            i, j = atoms.candidates(a, min(a + STARTS, len(atoms.code)))
            if len(i):
                s = atoms.features(i, j) @ self.weights.T
                for r, k in np.argwhere(s > worst).tolist():
                    kept.append((int(i[r]), int(j[r]), k, float(s[r, k]) - margin))
        out, at = [], 0
        while at < len(kept):  # kept is ordered by start; candidates that overlap or touch are decided together
            to, end = at, kept[at][1]
            while to < len(kept) and kept[to][0] <= end:
                end = max(end, kept[to][1])
                to += 1
            out += self._best(kept[at:to])
            at = to
        return [(int(atoms.text[i]), int(atoms.start[i]), k, int(atoms.end[j - 1])) for i, j, k in out]

    def _best(self, some: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
        """The best of all choices of segments that don't overlap. best[j][k]: what is best up to atom j if a segment of kind k ends there, or none (-1)."""
        best: dict[int, dict[int, tuple[float, tuple | None]]] = {some[0][0]: {-1: (0.0, None)}}
        ends: dict[int, list] = {}
        for c in some:
            ends.setdefault(c[1], []).append(c)
        last = max(ends)
        for at in range(some[0][0] + 1, last + 1):
            here = {-1: max(best[at - 1].values(), key=lambda x: x[0])}
            for i, j, k, s in ends.get(at, ()):
                score, way = max(((v + (float(self.after[p, k]) if p >= 0 else 0.0), w) for p, (v, w) in best[i].items()), key=lambda x: x[0])
                if k not in here or score + s > here[k][0]:
                    here[k] = (score + s, (i, j, k, way))
            best[at] = here
        way, out = max(best[last].values(), key=lambda x: x[0])[1], []
        while way:
            out.append(way[:3])
            way = way[3]
        return out[::-1]


class Examples:
    """Stretches with their true segments, padded to one length."""

    def __init__(self, lines: list[tuple[str, list[tuple[int, int, int]]]]):
        parts = [(n, t, a, z) for n, (t, _) in enumerate(lines) for a, z in stretches(t)]
        atoms = Atoms(parts)
        barrier = np.flatnonzero(atoms.code == _BARRIER)
        begin, size = barrier[:-1] + 1, np.diff(barrier) - 1
        fine = (size > 0) & (size <= 120)
        self.begin, self.size = begin[fine], size[fine]
        i, j = atoms.candidates(1, len(atoms.code))
        which = np.searchsorted(begin, i, side="right") - 1
        keep = fine[which]
        number = np.cumsum(fine) - 1
        self.example, self.i, self.j = number[which[keep]], (i - begin[which])[keep], (j - begin[which])[keep]
        self.x = atoms.features(i[keep], j[keep])
        true = {(n, a, z): k for n, (_, spans) in enumerate(lines) for a, k, z in spans}
        self.y = np.array([true.get((int(atoms.text[a]), int(atoms.start[a]), int(atoms.end[b - 1])), -1) for a, b in zip(i[keep], j[keep], strict=True)])
        self.width = int(self.size.max(initial=1))

    def likelihood(self, field: Field) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log likelihood of the true segmentations, and its gradients."""
        m, n, kinds = len(self.size), self.width, len(KINDS)
        s = np.full((m, n + 1, LONGEST, kinds), -np.inf)  # by end and length
        s[self.example, self.j, self.j - self.i - 1] = self.x @ field.weights.T
        fore, back = np.full((m, n + 1, kinds + 1), -np.inf), np.full((m, n + 1, kinds + 1), -np.inf)
        fore[:, 0, 0] = 0
        into = np.full((m, n + 1, kinds), -np.inf)  # what precedes a segment of each kind that starts here
        step = np.concatenate([np.zeros((1, kinds)), field.after])
        into[:, 0] = _sum(fore[:, 0, :, None] + step, 1)
        for j in range(1, n + 1):
            fore[:, j, 0] = _sum(fore[:, j - 1], 1)
            d = min(j, LONGEST)
            fore[:, j, 1:] = _sum(into[:, j - d : j][:, ::-1] + s[:, j, :d], 1)
            into[:, j] = _sum(fore[:, j, :, None] + step, 1)
        rows = np.arange(m)
        total = _sum(fore[rows, self.size], 1)
        outof = np.full((m, n + 1, kinds), -np.inf)  # what follows from a segment of each kind that starts here
        back[rows, self.size] = 0
        for i in range(n - 1, -1, -1):
            d = min(n - i, LONGEST)
            lengths = np.arange(d)
            outof[:, i] = _sum(s[:, i + 1 + lengths, lengths] + back[:, i + 1 + lengths, 1:], 1)
            inside = (i < self.size)[:, None]
            rest = np.logaddexp(back[:, i + 1, :1], _sum(outof[:, i, None, :] + step, 2))
            back[:, i] = np.where(inside, rest, back[:, i])
        e = self.example
        with np.errstate(over="ignore"):
            p = np.exp(into[e, self.i] + s[e, self.j, self.j - self.i - 1] + back[e, self.j, 1:] - total[e, None])
        gold = (self.y[:, None] == np.arange(kinds)).astype(float)
        pair = np.exp(fore[:, :, 1:, None] + field.after + outof[:, :, None, :] - total[:, None, None, None])
        pair = np.where((np.arange(n + 1) < self.size[:, None])[:, :, None, None], pair, 0.0).sum(axis=(0, 1))
        ends = {(int(a), int(b)): int(k) for a, b, k in zip(e, self.j, self.y, strict=True) if k >= 0}
        follows = np.zeros((kinds, kinds))
        for a, b, k in zip(e[self.y >= 0].tolist(), self.i[self.y >= 0].tolist(), self.y[self.y >= 0].tolist(), strict=True):
            if (a, b) in ends:
                follows[ends[a, b], k] += 1
        value = (gold * (self.x @ field.weights.T)).sum() + (follows * field.after).sum() - total.sum()
        return value / m, (gold - p).T @ self.x / m, (follows - pair) / m


def fitted(examples: Examples, rounds: int = 90, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Full-batch ascent with moments of the gradient."""
    field = Field(np.zeros((len(KINDS), examples.x.shape[1])), np.zeros((len(KINDS), len(KINDS))))
    mean, square = [0.0, 0.0], [0.0, 0.0]
    for t in range(1, rounds + 1):
        _, *gradients = examples.likelihood(field)
        for k, (name, g) in enumerate(zip(("weights", "after"), gradients, strict=True)):
            w = getattr(field, name)
            g = g - ridge * w
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g * g
            setattr(field, name, w + rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8))
    return field


def made_lines(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines by rule: personal data in common and uncommon spellings, and numbers that are none, between invented words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ka", "lo", "min", "ter", "sa", "ve", "ro", "an", "el", "ish")) for _ in range(r.randint(1, 4)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + number(14)
        return next(c for c in (body + d for d in "0123456789") if luhn(c))

    def email() -> str:
        at, dot = r.choice((("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("@", " dot ")))
        name = word() + r.choice(("", ".", "_", "-")) + (r.choice((word(), number(2))) if r.random() < 0.6 else "")
        hosts = [word() + r.choice(("", number(1)))] + ([word()] if r.random() < 0.5 else []) + [r.choice(("com", "org", "net", "de", "fr", "es", "io"))]
        return (name.rstrip("._-") or "x") + at + dot.join(hosts)

    def ip() -> str:
        return r.choice((".", ".", "[.]", "(.)", " . ")).join(str(r.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+44 {a} {b} {c}", f"+{number(2)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}", f"({a}) {b} {c}"))

    def grouped() -> str:
        c = card()
        return r.choice(("", " ", "-", ".", "/", "  ")).join((c[:4], c[4:8], c[8:12], c[12:]))

    def none() -> str:
        k = r.randint(0, 12)
        if k < 3:  # like a card's number but for its check digit
            c = card()
            c = c[:-1] + str((int(c[-1]) + r.randint(1, 9)) % 10)
            return c if k else r.choice((" ", "-")).join((c[:4], c[4:8], c[8:12], c[12:]))
        return (
            number(r.randint(7, 13)), number(r.randint(17, 24)), f"{r.randint(1990, 2030)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/{r.randint(1990, 2030)} {number(2)}.{number(2)}", f"{number(1)}.{number(2)}.{number(2)}",
            f"{r.randint(256, 999)}.{number(3)}.{number(3)}.{number(3)}", f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"{word()} at {word()} dot {word()}minaning", f"{word()} @ {word()} {number(8)}", f"{number(4)} {number(4)} {number(3)}",
        )[k - 3]

    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(r.choice((1, 1, 2))):
            text += r.choice((" ", " ", ", ", ": ", " (", "\n", " | ")) + (word() + r.choice((" ", ". ")) if r.random() < 0.4 else "")
            kind = r.randrange(6)
            new = (email, ip, grouped, phone, none, none)[kind]()
            if kind < 4:
                spans.append((len(text), kind, len(text) + len(new)))
            text += new + r.choice(("", " ", ". ", ", ", "!! ", ") ", "\n")) + (" " + word() + " " + word() if r.random() < 0.8 else "")
        out.append((text, spans))
    return out


def sampled(docs: DataFrame, documents: int = SAMPLE, most: int = STRETCHES) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Stretches of a bounded sample of distinct texts of up to 20,000 characters, with the base spans in them, in order of a hash of the text."""
    rows = docs.select("text").filter(F.length("text").between(1, 20_000))
    lot = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    part = int(min(1.0, 1.2 * documents / max(1, rows.count())) * (1 << 30)) + 1
    out = []
    for (text,) in rows.filter(lot < part).distinct().orderBy(lot, "text").limit(documents).collect():
        known = base(text)
        for a, z in stretches(text):
            if z - a <= 300 and len(out) < most:
                out.append((text[a:z], [(s - a, k, e - a) for s, k, e in known if a <= s and e <= z]))
    return out


def train(docs: DataFrame) -> Field:
    return fitted(Examples(made_lines(LINES) + sampled(docs)))


def found(texts: list[str], field: Field) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans, and all spans, of each text."""
    known = [base(t) for t in texts]
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = [(n, t, a, z) for n, t in enumerate(texts) for a, z in stretches(t)]
    for n, a, k, z in field.spans(Atoms(parts)) if parts else ():
        more[n].append((a, k, z))
    for own, new in zip(known, more, strict=True):
        edges = sorted((a, z) for a, _, z in own)
        starts, reach = np.array([a for a, _ in edges], np.int64), np.maximum.accumulate(np.array([z for _, z in edges], np.int64)) if edges else None
        free = []
        for a, k, z in new:
            at = int(np.searchsorted(starts, z)) if edges else 0
            if not at or reach[at - 1] <= a:
                free.append((a, k, z))
        yield own, sorted(own + free)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, and spans, of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = field or train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            texts = [t or "" for t in b.column("text").to_pylist()]
            counts, digest, spans = [], [], []
            for own, every in found(texts, field):
                counts.append([sum(k == kind for _, k, _ in own) for kind in range(len(KINDS))])
                digest.append(hashlib.sha256(joined(own).encode()).hexdigest())
                spans.append(joined(every))
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array(digest), pa.array(spans)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")

"""Divergences, whitening and personal data against brute force on small tables that hold the hard cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from offermill.llm import divergence, private, whiten

DOCS = "doc_id long, text string, lang string, source string, n_chars long, value string, rank long, term string, item string, n long, spans string"


def documents():
    rnd = random.Random(4)
    words = ["the", "The", "of", "élan", "über", "日本", "x", "it's", "a1b", "rare", "ab", "cd", "ef", "gh"]
    rows = [(i, " ".join(rnd.choices(words, weights=range(1, 15), k=rnd.randint(0, 40))), rnd.choice(["en", "de"]), rnd.choice(["s0", "s0", "s1", "s2", "é"])) for i in range(80)]
    rows += [(80, None, "en", "s3"), (81, "the of", None, None), (82, "the of", None, None), (83, "THE of", None, "z"), (84, "alone", "xx", "s0"), (85, "alone too", "xx", "s1"), (None, "", "en", ""), rows[3], rows[3]]
    return [(*r, None, None, None, None, None, None, None) for r in rows]


def plain_audit(rows, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(r[2] or "", r[3] or "", Counter(words(r[1]))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for d in own for t in d[2]).items() if n >= 3]
        groups = defaultdict(Counter)
        for _, source, c in own:
            groups[source].update({t: n for t, n in c.items() if t in kept})
        every = sum(groups.values(), Counter())
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: chance(c) for s, c in groups.items()}, chance(every)
        f = lambda a, b: (a - b) ** 2 // b
        rank = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
        for s in groups:
            out += [(lang, s, "pair", t, v, n) for n, (t, v) in rank([(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s])]
            out += [(lang, s, "term", t, v, n) for n, (t, v) in rank([(t, f(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]) if n <= top]
    return sorted(out)


@pytest.mark.parametrize("top", [200, 2])
def test_divergences(spark, top, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 15)
    monkeypatch.setattr(divergence, "PAIRS", 4)
    rows = documents()
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3), top)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, top)


def test_divergences_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r) for r in divergence.audit(spark.createDataFrame([(1, "a", "en", "x"), (2, "b", "en", "y")], "doc_id long, text string, lang string, source string")).collect()] == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_best_first_search_takes_rounds_until_nothing_unseen_can_be_better(spark):
    """Many terms in many buckets, more than one round's share."""
    rnd = random.Random(8)
    terms = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(terms, weights=[1 / (k + 1) for k in range(300)], k=400)), "en", f"s{i % 3}") for i in range(30)]
    got = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), 3)
    assert sorted(map(tuple, got.collect())) == plain_audit([(*r, None) for r in rows], 3)


def test_a_text_longer_than_a_step_is_one_document(spark):
    rows = [(i, ("the of and " * 400) + f"x{'y' * 300}", "en", "a") for i in range(3)] + [(9, "the of", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.term: (r.n, r.docs) for r in divergence.counted(df, 100).collect() if r.source == "a"}
    assert got == {"the": (1200, 3), "of": (1200, 3), "and": (1200, 3), "x" + "y" * 300: (3, 3)}


VECTORS = "vec_id long, embedding array<double>, label string, v string, n long, component string"


def plain_whitening(vectors, components=32):
    x = [[int(np.floor(64 * c)) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s, strict=True)] for r in x])
    return [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], centred @ v / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("scale", [1.0, 1e6, 3e10])
def test_whitening(spark, scale, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + [0, 3, -70, 0.5, 9]) * scale
    rows = [(i, v, None, None, None, None) for i, v in enumerate(x.tolist())] + [(0, x[0].tolist(), None, None, None, None), (None, x[1].tolist(), None, None, None, None)]
    bad = [None, [], [1.0], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame(rows + [(1000 + i, b, None, None, None, None) for i, b in enumerate(bad)], VECTORS).repartition(4)
    deviation, whitened, explained = plain_whitening([r[1] for r in rows], 4)
    want = sorted((-1 if r[0] is None else r[0], d, *np.abs(w)) for r, d, w in zip(rows, deviation, whitened, strict=True))
    by = defaultdict(list)
    for r in whiten.whiten(df, components=4).collect():
        assert r.n == 202 and r.identity_error <= 1e-4 and abs(r.explained / explained[r.component - 1] - 1) < 1e-4
        by[-1 if r.vec_id is None else r.vec_id].append(r)
    assert sorted(by) == sorted({w[0] for w in want}) and all(len(v) == (8 if k == 0 else 4) for k, v in by.items())
    for k, d, *w in want:
        assert {int(r.deviation) for r in by[k]} == {d}
        assert all(abs(abs(r.whitened) - w[r.component - 1]) < 1e-6 for r in by[k])
    signs = {r.component: np.sign(r.whitened) * np.sign(whitened[5][r.component - 1]) for r in by[5]}
    assert all(np.sign(r.whitened) == signs[r.component] * np.sign(whitened[9][r.component - 1]) for r in by[9])


def test_whitening_of_few_or_equal_vectors(spark):
    assert whiten.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    one = whiten.whiten(spark.createDataFrame([(1, [2.0, 3.0], None, None, None, None)] * 2, VECTORS)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(2, 0, None, 0.0, 0.0)] * 4
    line = whiten.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], None, None, None, None) for i in range(9)], VECTORS)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9


def test_scatter_is_exact_for_all_digits():
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.integers(-(1 << 61), 1 << 61, (60, 3)), rng.integers(-5, 5, (60, 3))])
    own = whiten.Scatter(3)
    own.add(y)
    own.add(y[:7])
    total = defaultdict(int)
    for b in own.cells():
        for r in b.to_pylist():
            total[r["i"], r["j"]] += r["digit"] << whiten.DIGIT * r["place"]
    rows = [[int(c) for c in r] + [1] for r in [*y.tolist(), *y[:7].tolist()]]
    assert all(total[i, j] == sum(r[i] * r[j] for r in rows) for i in range(4) for j in range(i, 4))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            total = sum(x if n % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for n, x in enumerate(d[::-1]))
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and total % 10 == 0 or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def private_texts():
    rnd = random.Random(3)
    bits = ["1", "25", "255", "0", ".", "@", "a", "b-", "+", "-", " ", "(", ")", "_", "é", "日", "x.com", "4929348385146306", "+1 (377) 555-0271", "10.2.3.4", "me@mail.example.com"]
    texts = [None, "", " ", "1" * 5000, "a" * 5000 + "@", "1." * 3000, "+1 " * 999, "x@y.z," * 300]
    return texts + ["".join(rnd.choices(bits, k=rnd.randint(1, 30))) for _ in range(600)]


@pytest.fixture(scope="module")
def field():
    return private.fitted(private.Examples(private.made_lines(private.LINES)))


def test_base_spans(spark, field):
    texts = private_texts()
    rows = [(i, t, *[None] * 9) for i, t in enumerate(texts)] + [(None, "me@mail.example.com", *[None] * 9)]
    got = private.find(spark.createDataFrame(rows, DOCS).repartition(3), field).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or "" if r.doc_id is not None else rows[-1][1]
        want = plain_base(text)
        said = [f"{list(PATTERNS)[k]}:{a}:{z}" for a, k, z in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert not set(said) - set(spans) and len(set(spans)) == len(spans)
        more = sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans if x not in said)
        assert all(a >= z or b <= s for a, b in more for s, _, z in want) and all(x[1] <= y[0] for x, y in zip(more, more[1:]))  # noqa: B905, RUF007
    assert private.find(spark.createDataFrame([], DOCS), field).collect() == []


def test_field_finds_what_patterns_miss_on_lines_it_has_not_seen(field):
    lines, right, wrong, missed = private.made_lines(300, seed=77), 0, 0, 0
    for (text, spans), (own, every) in zip(lines, private.found([t for t, _ in lines], field), strict=True):
        assert own == plain_base(text)
        right += len(set(spans) & set(every))
        wrong += len(set(every) - set(spans) - set(own))
        missed += len(set(spans) - set(every))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.85


def test_dynamic_programming_finds_the_best_segmentation_and_the_likelihood_sums_all():
    """All segmentations of short stretches, one by one."""
    lines = [("12 4345 8917 at 7", [(0, 2, 12)]), ("a@b.co me", []), ("x 1.2.3.4 +123", [(2, 1, 9)])]
    ex = private.Examples(lines)
    rng = np.random.default_rng(1)
    own = private.Field(rng.normal(size=(4, ex.x.shape[1])) * 0.4, rng.normal(size=(4, 4)))
    value, gw, ga = ex.likelihood(own)
    plain = 0.0
    for m in range(len(ex.size)):
        rows = np.flatnonzero(ex.example == m)
        s = {(int(ex.i[r]), int(ex.j[r])): own.weights @ ex.x[r] for r in rows}
        gold = {(int(ex.i[r]), int(ex.j[r])): int(ex.y[r]) for r in rows if ex.y[r] >= 0}
        scores, true = [], None

        def walk(at, last, score, chosen, m=m, s=s, gold=gold, scores=scores):
            nonlocal true
            if at == ex.size[m]:
                scores.append(score)
                if chosen == gold:
                    true = score
                return
            walk(at + 1, -1, score, chosen)
            for (i, j), x in s.items():
                if i == at:
                    for k in range(4):
                        walk(j, k, score + x[k] + (own.after[last, k] if last >= 0 else 0.0), {**chosen, (i, j): k})

        walk(0, -1, 0.0, {})
        plain += true - np.logaddexp.reduce(scores)
    assert value == pytest.approx(plain / len(ex.size))
    for name, g in (("weights", gw), ("after", ga)):
        for at in ((0, 0), (1, 3), (2, 1)):
            w = getattr(own, name).copy()
            w[at] += 1e-5
            other = private.Field(w, own.after) if name == "weights" else private.Field(own.weights, w)
            assert (ex.likelihood(other)[0] - value) / 1e-5 == pytest.approx(g[at], abs=1e-4)


def test_best_choice_of_segments():
    rng = np.random.default_rng(5)
    for _ in range(60):
        own = private.Field(np.zeros((4, 1)), rng.normal(size=(4, 4)))
        some = sorted({(int(i), int(i + rng.integers(1, 4)), int(rng.integers(4)), float(rng.normal())) for i in rng.integers(0, 6, 7)})

        def worth(chosen, own=own):
            pairs = list(zip(chosen, chosen[1:]))  # noqa: B905, RUF007
            if any(a[1] > b[0] for a, b in pairs):
                return -np.inf
            return sum(c[3] for c in chosen) + sum(own.after[a[2], b[2]] for a, b in pairs if a[1] == b[0])

        best = max(worth([c for n, c in enumerate(some) if m >> n & 1]) for m in range(1 << len(some)))
        scores = {c[:3]: c[3] for c in some}
        got = own._best(some)
        assert worth([(*c, scores[c]) for c in got]) == pytest.approx(best)

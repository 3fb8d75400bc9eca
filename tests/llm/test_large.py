"""Operators and the pipeline beyond limits that they once had, against brute force in plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from offermill.llm import ann, jaccard, langid, warc, wrapper

SF = "/root/testdata/sf0.001"


def test_jaccard_links_members_of_equal_order_in_large_regions(spark, monkeypatch):
    rnd = random.Random(5)
    some = lambda n: [f"w{rnd.randrange(1 << 40)}" for _ in range(n)]
    frequent = some(20)
    texts = []
    for _ in range(150):  # two linked texts, and one linked with neither that is in all regions of theirs
        passage = some(94)
        texts += [passage + some(10), passage + some(10), passage + frequent]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    least = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                least[j] = min(least[j], least[i])
    assert least == [i - (i % 3 == 1) for i in range(len(texts))]
    monkeypatch.setattr(jaccard, "WHOLE", 2)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == dict(enumerate(least))


@pytest.mark.parametrize("query", [jaccard.near_duplicates, jaccard.keep_one])
def test_jaccard_hands_python_batches_of_bounded_size(spark, monkeypatch, query):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(i, f"text {i // 2} of some " + "long words " * 30_000) for i in range(40)], "doc_id long, text string").repartition(1)
    before, most, store = spark.conf.get(key), [], jaccard.stored

    def stored(rows, name):
        if name == "members":  # the batches that this step's Python gets
            sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
            most.append(max(r.n for r in sizes.collect()))
        return store(rows, name)

    monkeypatch.setattr(jaccard, "stored", stored)
    assert query(df).count()
    assert len(most) == 1 and most[0] <= jaccard.STEP + 400_000  # a row more, at most
    assert spark.conf.get(key) == before


def test_constant_texts_of_any_length_are_template(spark):
    page = lambda i: f"<div><p>{'all rights of this text are kept ' * 15}</p><div>{'we use what we like ' * 300}</div><ul>Story {i} of a host</ul></div>"
    df = spark.createDataFrame([(i, "http://h.example/a", page(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrapper.main_text(df).collect()} == {i: f"Story {i} of a host" for i in range(8)}


def test_pages_are_aligned_with_their_own_layout(spark):
    one = lambda i: f"<body class=post-{i}><div><p>We keep what we like</p><ul>Story {i} of one</ul></div></body>"
    two = lambda i: f"<body><table><tr><td><h2>Read this one as well</h2><h4>Story {i} of two</h4></td></tr></table><section><h3>Tell all about it</h3></section></body>"
    rows = [(0, None), (1, ""), *((i, one(i)) for i in range(2, 22)), *((i, two(i)) for i in range(22, 30))]
    df = spark.createDataFrame([(i, "http://h.example/a", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert got == {0: "", 1: ""} | {i: f"Story {i} of one" for i in range(2, 22)} | {i: f"Story {i} of two" for i in range(22, 30)}


def test_warc_keeps_pages_with_long_urls(spark):
    urls = ["http://h.example/" + "a" * 70_000, "http://h.example/" + "é" * 30_000, "http://h.example/"]
    df = spark.createDataFrame([(i, u, "page") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.url for r in warc.round_trip(df).collect()} == dict(enumerate(urls))


def test_a_gap_in_a_fresh_archive_is_an_error(spark, monkeypatch):
    read = warc.read
    gap = "'f' AS file, 'gap' AS kind, 0L AS start, 1L AS stop, 'broken' AS reason"
    monkeypatch.setattr(warc, "read", lambda s, *a, **k: read(s, *a, **k).unionByName(s.range(1).selectExpr(*gap.split(", ")), allowMissingColumns=True))
    with pytest.raises(Exception, match="gap in a fresh archive: broken"):
        warc.round_trip(spark.createDataFrame([(1, "u", "page")], "page_id long, url string, html string")).collect()


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid.Network, "fit", lambda self, texts, labels: self)
    df = spark.createDataFrame([(i, f"some text {i}", f"l{i % 70:02}") for i in range(700)], "doc_id long, text string, lang string")
    assert langid.train(df).labels == [f"l{i:02}" for i in range(70)]


def test_the_pipeline_keeps_documents_where_no_language_is_known(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, df, SF).collect()) == [1, 2]


def test_ties_between_very_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 8))
    key = rng.permutation(4000)
    x[:2500] = x[0]  # copies, in no order of their ids, more than are compared exactly
    x[2500:2504] = x[2500]
    key[3000:3030] = key[3000]  # one row many times
    x[3000:3030] = x[3000]
    again = [(int(key[0]), [9.0] * 8)]  # another vector by an id that is there
    rows = [(int(k), [float(v) for v in r]) for k, r in zip(key, x, strict=True)] + again
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), every=50).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    wanted = {}
    for i, r in rows:
        if i % 50 == 0:
            wanted[i] = min(r, wanted.get(i, r))
    assert set(found) == set(wanted)
    right = 0
    for i, q in wanted.items():
        d = np.sqrt(((v - np.array(q)) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert sorted(found[i]) == list(range(1, 11))
        if d[best[9]] == 0:
            assert [found[i][k][0] for k in range(1, 11)] == ids[best].tolist()
        right += sum((a, pytest.approx(s)) == (b, t) for (a, s), (b, t) in zip([found[i][k] for k in range(1, 11)], zip(ids[best].tolist(), d[best].tolist(), strict=True), strict=True))
    assert sum(len({s for _, s in f.values()}) == 1 for f in found.values()) > 40 and right >= 9 * len(wanted)

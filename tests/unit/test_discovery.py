"""Finding pages: fixed points of links, lists of domains, registered extractors, archives and cut streams, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermill.functions import fixed, urls
from offermill.operators import crawl, domains, frontier
from offermill.sources import archive, chunks, registry
from offermill.sources.html import LINKS, mapped


def plain_reached(links, seeds):
    depth, delta, via = {s: 0 for s in seeds if s}, {s for s in seeds if s}, {s: None for s in seeds if s}
    while delta:
        new = {}
        for a, b in links:
            if a in delta and b and b not in depth:
                new[b] = min(new.get(b, a), a)
        depth |= {b: max(depth.values()) + 1 for b in new}
        via |= new
        delta = set(new)
    return {(u, d, via[u]) for u, d in depth.items()}


def test_links_to_a_fixed_point(spark):
    rnd = random.Random(2)
    links = [(f"u{rnd.randrange(40)}", f"u{rnd.randrange(40)}") for _ in range(55)] + [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c12", "c0"), ("u1", "c0"), ("u1", None), (None, "u2"), ("u1", "u1")]
    links += links[:9]
    seeds = ["u1", "u3", "u3", None, "lonely"]
    got = crawl.reached(spark.createDataFrame(links, "url string, href string").repartition(3), spark.createDataFrame([(s,) for s in seeds], "url string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_reached([x for x in links if x[0] and x[1]], seeds), key=str)
    two = crawl.reached(spark.createDataFrame(links, "url string, href string"), spark.createDataFrame([("c0",)], "url string"), 2)
    assert {r.url for r in two.collect()} == {"c0", "c1", "c2"}
    assert crawl.reached(spark.createDataFrame([], "url string, href string"), spark.createDataFrame([], "url string")).collect() == []


def test_products_of_listings_that_lead_to_each_other(spark):
    nav = lambda *links: "<div class=pagination>" + "".join(f"<a href='{x}'>n</a>" for x in links) + "</div>"
    card = lambda n: f"<li class=product><h3>Panel {n}</h3><b class=price>${n}</b><a href='/product/{n}'>x</a></li>"
    pages = [
        ("https://s.example/l", card(10) + card(11) + nav("?p=2", "/l?p=2", "https://s.example/l", "?p=3")),
        ("https://s.example/l?p=2", card(11) + card(12) + nav("/l", "?p=4&amp;x=1", "?p=missing")),
        ("https://s.example/l?p=2", card(11) + card(12) + nav("/l", "?p=4&amp;x=1", "?p=missing") + " twice"),
        ("https://s.example/l?p=3", nav("1", "2", "3", "4", "5", "/l?p=6")),  # the sixth further page isn't followed
        ("https://s.example/l?p=4&x=1", card(13)),
        ("https://s.example/l?p=6", card(14)),
        ("https://s.example/other", card(15)),
        (None, card(16)),
        ("https://s.example/null", None),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    got = crawl.listing_products(df, spark.createDataFrame([("https://s.example/l",)], "url string"))
    assert {(r.title, r.depth, r.url) for r in got.collect()} == {(f"Panel {n}", d, f"https://s.example/product/{n}") for n, d in ((10, 0), (11, 0), (12, 1), (13, 2))}


def plain_labels(rows, domain):
    tests = {"below": lambda n: domain == n or domain.endswith("." + n), "ending": domain.endswith, "within": lambda n: n in domain}
    return sorted({label for n, label, how in rows if n and tests[how](n)})


def test_domains_on_lists_of_any_length(spark):
    rnd = random.Random(3)
    rows = [("example.com", "a", "below"), ("ample.com", "b", "ending"), ("x.com", "c", "within"), ("x.com", "d", "below"), ("", "e", "ending"), ("co.uk", "a", "below"), ("shop.example.com", "f", "below"), ("é.de", "g", "within")]
    rows += [(f"{rnd.choice('abc')}{rnd.choice('ab.')}{rnd.choice('abc')}", f"l{i % 4}", domains.HOWS[i % 3]) for i in range(40)]
    hosts = ["example.com", "shop.example.com", "notexample.com", "www.example.com", "box.com.au", "a.co.uk", "é.de", "EXAMPLE.com:80"] + ["".join(rnd.choices("abc.", k=rnd.randint(1, 12))).strip(".") or "a" for _ in range(200)]
    df = spark.createDataFrame([(f"https://{h}/p",) for h in hosts] + [(None,), ("no url",)], "url string")
    names = spark.createDataFrame(rows, "name string, label string, how string")
    want = sorted((r.url or "", plain_labels(rows, r.d)) for r in df.withColumn("d", urls.domain(F.col("url"))).collect())
    for most in (domains.MOST_BYTES, 0):  # sent to the workers; joined
        assert sorted((r.url or "", r["labels"]) for r in domains.labelled(df, names, most_bytes=most).collect()) == want
    assert all(r["labels"] == [] for r in domains.labelled(df, names.limit(0)).collect())
    with pytest.raises(ValueError, match="too many"):
        domains.labels(F.col("url"), [("x" * (domains.MOST_BYTES + 1), "a", "below")])


def test_a_dimension_of_100_000_domains(spark):
    names = spark.range(100_000).select(F.concat(F.lit("shop"), "id", F.lit(".example")).alias("name"), F.concat(F.lit("l"), F.col("id") % 7).alias("label"), F.element_at(F.array(*(F.lit(h) for h in domains.HOWS)), (F.col("id") % 3 + 1).cast("int")).alias("how"))
    df = spark.range(0, 200_000, 37).select(F.concat(F.lit("http://a.shop"), "id", F.lit(".example/")).alias("url"), "id")
    sent, joined = domains.labelled(df, names), domains.labelled(df, names, most_bytes=0)
    got = {r.id: r["labels"] for r in sent.collect()}
    assert got == {r.id: r["labels"] for r in joined.collect()}
    assert got[37 * 27] == ["l5"] and got[37 * 5000] == [] and len(got) == 5406


def test_frontier_decides_as_the_url_functions_do(spark):
    hosts = [*fixed.VENDORS["supplements"][:9], *fixed.DEAL_SITES["supplements"][:5], *fixed.SOLAR_VENDORS[:9], *fixed.SOLAR_EXCLUDED[:9], *fixed.BROWSER_DOMAINS, *fixed.EXCLUDED[:9]]
    found = [f"https://{p}{h}/{q}" for h in dict.fromkeys(hosts) for p in ("", "www.", "not", "a.b.") for q in ("", "product/1", "blog/solar")] + ["", "x", "https://"]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(found)] + [(None, -1)], "url string, ordinal long")
    u = F.col("url")
    for renderer in (False, True):
        plain = df.select("ordinal", urls.tier(u, fixed.VENDORS["supplements"], fixed.DEAL_SITES["supplements"], renderer).alias("tier"), urls.tier(u, fixed.SOLAR_VENDORS, fixed.SOLAR_DEAL_SITES, renderer, frontier.SOLAR_SHOPS).alias("solar_tier"))
        assert sorted(map(tuple, frontier.both_tiers(df, "supplements", renderer).select("ordinal", "tier", "solar_tier").collect())) == sorted(map(tuple, plain.collect()))
    ids = lambda x: sorted(r.ordinal for r in x.collect())
    assert ids(frontier.fetchable(df, "supplements")) == ids(df.filter(~urls.is_excluded(u, "supplements")))
    assert ids(frontier.solar_fetchable(df)) == ids(df.filter(~urls.within_domain(u, fixed.SOLAR_EXCLUDED) & ~urls.is_blog(u)))
    assert ids(frontier.routed(df).filter("route = 'render'")) == ids(df.filter(urls.needs_browser(u)))


def test_tiers_are_one_pass_without_joins(spark):
    plan = frontier.both_tiers(spark.createDataFrame([("https://a.example", 1)], "url string, ordinal long"), "supplements")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Exchange" not in plan


def test_one_page_a_url_through_a_cache(spark):
    page = lambda *rows: spark.createDataFrame(list(rows), "url string, html string")
    wanted = spark.createDataFrame([("u",), ("u",), ("v",), ("w",)], "url string")
    got = frontier.read_through(wanted, page(("u", "2"), ("u", "1")), page(("v", "b"), ("v", "a"), ("u", "new")))
    assert sorted(map(tuple, got.collect())) == [("u", "1", "cache"), ("v", "a", "fetch")]
    both = frontier.one_of_both(page(("u", "1"), ("u", "0"), ("v", "2")), page(("u", "r"), ("u", "s")))
    assert sorted(map(tuple, both.select("url", "html", "source").collect())) == [("u", "r", "render"), ("v", "2", "fetch")]


def test_pages_that_fail_are_told(spark):
    def fails(html):
        if html == "bad":
            raise ValueError("no tree")
        return [{"ordinal": 0, "href": html}]

    df = spark.createDataFrame([(1, "bad"), (2, "x")], "id long, html string")
    assert sorted(map(tuple, mapped(df, fails, LINKS, errors="error").collect())) == [(1, None, None, "ValueError: no tree"), (2, 0, "x", None)]
    assert [tuple(r) for r in mapped(df, fails, LINKS).collect()] == [(2, 0, "x")]


def headings(html, url, level=1):
    if "broken" in html:
        raise ValueError("broken page")
    return registry.selected(html, url, f"h{level}")


def tagged(html, url=None, tags="h1"):
    return [{t: (registry.selected(html, url, t) or [{"value": None}])[0]["value"] for t in tags.split("+")}]


def tagged_columns(tags="h1"):
    return T.StructType([T.StructField(t, T.StringType()) for t in tags.split("+")])


def test_extractors_by_name_from_sql(spark):
    own = registry.Registry().extractor("headings", "value string", headings).extractor("tagged", tagged_columns, tagged).install(spark)
    rows = [(1, "<h1>a</h1><h1>b</h1><h2>c</h2><title>t</title>"), (2, "broken"), (3, None), (4, "<p>none</p>")]
    spark.createDataFrame(rows, "id long, html string").createOrReplaceTempView("some_pages")
    ask = lambda q: sorted(map(tuple, spark.sql(q).collect()), key=str)
    assert ask("SELECT id, h.* FROM some_pages, LATERAL headings(html, CAST(NULL AS STRING)) h") == [(1, 0, "a", None), (1, 1, "b", None), (2, 0, None, "ValueError: broken page")]
    assert ask("SELECT id, value FROM some_pages, LATERAL headings(html, 'u', level => CAST(id + 1 AS INT)) WHERE value IS NOT NULL") == [(1, "c")]
    df = spark.sql("SELECT id, x.* FROM some_pages, LATERAL tagged(html, tags => 'h2+title') x")
    assert df.columns == ["id", "ordinal", "h2", "title", "error"] and (1, 0, "c", "t", None) in map(tuple, df.collect())
    assert ask("SELECT id, h1 FROM some_pages, LATERAL page_fields(html, fields => 'h1,title_tag')") == [(1, "a"), (2, None), (3, None), (4, None)]
    for bad in ("page_fields(html, fields => 'nothing')", "tagged(html, tags => CAST(id AS STRING))", "page_fields(id)"):
        with pytest.raises(Exception, match="field|constants|html"):
            spark.sql(f"SELECT * FROM some_pages, LATERAL {bad}").collect()
    with pytest.raises(ValueError, match="name"):
        own.extractor("no name", "a string", headings)
    with pytest.raises(ValueError, match="tier"):
        own.engine("E", 9, 0, {})


def test_engines_of_a_registry(spark):
    own = registry.Registry(defaults=False).engine("Rule", 1, 10, {"selectors": ["b.none", "a.hit"], "own": ["self.example"], "fallback": ["self.example"]}).engine("Code", 3, 0, lambda html: html.split()).install(spark)
    rows = [("Rule", "<a class=hit href=http://a>x</a><a class=hit href=http://self.example/y>y</a>"), ("Rule", "<a href=http://z>z</a>"), ("Code", "http://c http://d"), ("Other", "<a href=http://q>"), (None, "x")]
    got = spark.sql("SELECT r.engine, l.ordinal, l.href FROM {r} r, LATERAL engine_links(r.html, engine => r.engine) l", r=spark.createDataFrame(rows, "engine string, html string"))
    assert sorted(map(tuple, got.collect())) == [("Code", 0, "http://c"), ("Code", 1, "http://d"), ("Rule", 0, "http://a"), ("Rule", 0, "http://z")]
    assert sorted(map(tuple, spark.table("engines").collect())) == [("Code", 3, 0, 1), ("Rule", 1, 10, 0)]
    assert [r.engine for r in own.query_engines(spark.createDataFrame([("q",)], "query string"), 2).collect()] == ["Rule"]


def archive_lines():
    good = [{"url": f"https://h{i % 3}.example/{i}", "status": 200, "html": "é€😀" * (i * 7 % 50)} for i in range(30)]
    odd = [{"url": "https://a/", "status": s, "html": "x"} for s in (200, 204, 299, 300, 403, 404, 429, 500, 199)] + [{"url": "u", "status": 200, "html": None}, {"url": "u", "status": 200, "html": "Captcha, are you a robot"}, {"url": "u", "status": 200, "html": "captcha"}, {"status": 200, "html": "x"}, {"url": None, "status": 200, "html": "x"}, {"url": "u", "html": "x"}]
    lines = [json.dumps(x, ensure_ascii=i % 2 == 0) for i, x in enumerate(good + odd)]
    return [*lines, "", "not json", '{"url": "u", "status": 200, "html": "cut', "[1]", json.dumps({"url": "long", "status": 200, "html": "y" * 5000})]


def test_archive_in_ranges(spark, tmp_path):
    lines = archive_lines()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0.txt").write_text("\n".join(lines), "utf-8")
    (tmp_path / "a" / "part-1.txt").write_text("\n".join(lines[:5]) + "\n", "utf-8")
    (tmp_path / "a" / "_SUCCESS").write_text("")
    want = sorted((archive.record(x.encode()) for x in [*lines, *lines[:5]] if x), key=str)
    assert {x[3] for x in want} == {None, "limited", "http", "blocked", "broken"}
    for size in (1 << 20, 4096, 333, 50):
        df = archive.read_archive(spark, f"file://{tmp_path}/a", size)
        assert sorted(map(tuple, df.collect()), key=str) == want
    assert df.rdd.getNumPartitions() == sum(-(-(tmp_path / "a" / f"part-{i}.txt").stat().st_size // 50) for i in (0, 1))
    assert sorted(map(tuple, archive.rows_of(spark, f"{tmp_path}/a").collect()), key=str) == want


def test_rows_that_pass_tests_in_the_reader(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n".join(archive_lines()), "utf-8")
    path = str(tmp_path / "x.txt")
    rows = archive.read_archive(spark, path).collect()
    for options, test in (({"error": "limited"}, lambda r: r.error == "limited"), ({"error": "none"}, lambda r: r.error is None), ({"status": "200, 204", "url": "https"}, lambda r: r.status in (200, 204) and r.url.startswith("https")), ({"error": "broken,none", "status": "200"}, lambda r: r.error is None and r.status == 200)):
        df = archive.read_archive(spark, path, 100, **options)
        want = sorted((tuple(r) for r in rows if test(r)), key=str)
        assert want and sorted(map(tuple, df.collect()), key=str) == want
        assert df.filter("url = 'https://a/'").count() == sum(r[0] == "https://a/" for r in want) and df.count() == len(want)  # a frame answers one query after another
    with pytest.raises(FileNotFoundError):
        archive.ArchiveReader({"path": f"{tmp_path}/none"}).partitions()
    with pytest.raises(ValueError, match="rows_of"):
        archive.local("store://x/y")


def test_archive_round_trip(spark, tmp_path):
    rows = [(f"u{i}", 200, "line\nbreaks\r and \"quotes\"  " * i) for i in range(20)]
    archive.write_archive(spark.createDataFrame(rows, "url string, status int, html string").repartition(3), str(tmp_path / "w"))
    assert sorted(tuple(r)[:3] for r in archive.read_archive(spark, str(tmp_path / "w"), 64).collect()) == sorted(rows)
    assert archive.read_archive(spark, str(tmp_path / "w")).filter("error IS NOT NULL").collect() == []


def plain_events(data):
    event, out = "", []
    *whole, _ = data.split(b"\n")
    for n, x in enumerate(whole):
        text = x.removesuffix(b"\r").decode("utf-8", "replace")
        if text.startswith("event: "):
            event = text[7:]
        elif text.startswith("data: "):
            if event and text[6:]:
                out.append((n, event, text[6:]))
            event = ""
    return out


def streams():
    rnd = random.Random(6)
    bits = ["event: a\n", "event: é€😀\n", "data: x\n", "data: 日本 y\r\n", "\n", "\n\n", "data: \n", "event: \n", "id: 7\n", ": note\n", "event: cut", "data: z", "event: b\ndata: {\"k\": 1}\n\n"]
    texts = {f"s{k}": "".join(rnd.choices(bits, k=rnd.randint(0, 40))).encode() for k in range(12)} | {"none": b"", "open": b"event: a\ndata: never ends", "long": b"event: l\ndata: " + b"q" * 3000 + b"\n\n", "broken": b"event: a\ndata: \xff\xfe!\n\n"}
    rows = [(k, i, t[a : a + n]) for k, t in texts.items() for n in [rnd.choice((1, 2, 3, 7, 50))] for i, a in enumerate(range(0, len(t), n))]
    return texts, rows


@pytest.mark.parametrize("block", [1, 3, chunks.BLOCK])
def test_events_cut_anywhere(spark, block):
    texts, rows = streams()
    rows.append(("null", 0, None))
    got = chunks.events(spark.createDataFrame(rows, "stream string, seq long, chunk binary").repartition(5), block)
    want = sorted((k, *e) for k, t in texts.items() for e in plain_events(t))
    assert sorted(map(tuple, got.collect())) == want and any("😀" in e for _, _, e, _ in want)
    assert chunks.events(spark.createDataFrame([], "stream string, seq long, chunk binary")).collect() == []
    text = spark.createDataFrame([("s", 0, "event: é\nda"), ("s", 1, "ta: ü\n")], "stream string, seq int, chunk string")
    assert [tuple(r) for r in chunks.events(text).collect()] == [("s", 1, "é", "ü")]


def test_events_of_chunks_that_come_in_batches_and_out_of_order(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    texts, rows = streams()
    rows = [r for r in rows if r[0] in ("s0", "s1", "s2", "open", "broken")]
    random.Random(1).shuffle(rows)
    schema = "stream string, seq long, chunk binary"
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    from offermill.streaming.state import run_to

    run_to(chunks.decoded(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted((k, *e) for k in ("s0", "s1", "s2", "open", "broken") for e in plain_events(texts[k]))

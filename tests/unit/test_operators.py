"""Operators on small relations."""

import json

import pytest
from pyspark.sql import functions as F

from offermill.functions import fixed
from offermill.operators import extract, frontier, leaderboard, limits, ranking
from offermill.sources import documents
from offermill.sources.html import Page
from offermill.streaming import state

RECORD = "ordinal long, title string, price double, currency string, quantity double, unit string, url string, vendor string, primaryUpc string, valid_upc boolean"


def records(spark, rows):
    return spark.createDataFrame([(i, "A product of good quality", p, "USD", q, u, f"https://{v}/{i}", v, upc, upc is not None) for i, (p, q, u, v, upc) in enumerate(rows)], RECORD)


def test_cheaper_ranks_higher(spark):
    got = ranking.rank_offers(records(spark, [(50.0, 100.0, "g", "a", None), (10.0, 100.0, "g", "b", None), (25.0, 100.0, "g", "c", None)])).orderBy("rank").collect()
    assert [r.price for r in got] == [10.0, 25.0, 50.0]
    assert got[0].price_per_unit == 0.1


def test_vendor_and_price_once(spark):
    got = ranking.rank_offers(records(spark, [(20.0, 100.0, "g", "a", None), (20.0, 100.0, "g", "a", None), (20.0, 100.0, "g", "b", None)])).collect()
    assert sorted((r.vendor, r.ordinal) for r in got) == [("a", 0), ("b", 2)]


def test_incomplete_records_count_as_matches_only(spark):
    got = ranking.rank_offers(records(spark, [(20.0, 100.0, "g", "a", "012345678905"), (None, 1.0, "g", "b", "012345678905"), (9.0, 0.0, "capsules", "c", None)])).collect()
    assert [(r.vendor, r.matches) for r in got] == [("a", 1)]


def test_at_most_fifty(spark):
    df = ranking.rank_offers(records(spark, [(20.0 + i, 100.0, "g", f"v{i}", None) for i in range(100)]))
    assert df.count() == 50
    assert ranking.best_deal(df).first().rank == 1


PAGE = """<html><head><title>T</title><meta property="og:title" content="Fish Oil &amp; More 300 softgels">
<script type="application/ld+json">{"@type": "Product", "gtin13": "4006381333931", "sku": "FO-1", "offers": [{"price": "24.99", "priceCurrency": "EUR"}]}</script><script type="application/ld+json">{bad</script></head>
<body><h1>other</h1><div class="sale-price">$19.99</div><del>$29.99</del><span class="shipping-cost">$4.99</span><div class="coupon-box">Use SAVE10 for 10% off</div>
<p>Subscribe & save 15%. Buy 3 get 10% today. Free shipping on orders over $50. UPC: 012345678905</p><i data-upc="012345678905"></i></body></html>"""


def test_product_record(spark):
    df = spark.createDataFrame([(0, "https://www.shop.de/x", PAGE), (1, "https://b.com", "<p>no title"), (2, "https://c.com", None)], "ordinal long, url string, html string")
    (r,) = extract.product_records(df).collect()
    assert (r.title, r.price, r.currency, r.quantity, r.unit, r.vendor) == ("Fish Oil  More 300 softgels", 19.99, "EUR", 300.0, "softgels", "shop.de")
    assert (r.primaryUpc, r.sku, r.original_price, r.discount_percent) == ("4006381333931", "FO-1", 29.99, 33)
    assert [(i["type"], i["source"]) for i in r.identifiers] == [("ean-13", "json-ld"), ("sku", "json-ld"), ("upc-a", "data-attribute")]
    assert tuple(r.shipping) == (4.99, 50.0, True)
    assert tuple(r.promotion) == (True, "SAVE10", "10% off", "15%", "Buy 3 get 10%")


def test_price_cascade(spark):
    pages = {
        "meta": ('<title>x y</title><meta property="product:price:amount" content="22.90"><b class="price">$5.00</b>', 22.9),
        "slot": ('<title>x y</title><b class="price-was">$99.00</b><b class="big-price">now</b><b class="my-price">£7.50</b>', 7.5),
        "text": ("<title>x y</title><p>only $0.50 or $12.00", 12.0),
        "none": ("<title>x y</title><p>free", None),
    }
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in pages.items()], "k string, url string, html string")
    assert {r.k: r.price for r in extract.product_records(df).collect()} == {k: p for k, (_, p) in pages.items()}


def test_panel_record(spark):
    html = '<title>Renogy 400W Bifacial panel</title><script type="application/ld+json">{"@graph":[{"@type":"Product","brand":{"name":"Renogy"},"offers":{"price":200}}]}</script><table><tr><td>Efficiency 21.5%<td>1722 x 1134 x 30 mm<td>47.4 lbs</table>ships free'
    df = spark.createDataFrame([("https://renogy.de/p", html), ("https://a.com/blog", "<title>400W solar guide</title>$300.00")], "url string, html string")
    (r,) = extract.panel_records(df).collect()
    assert (r.price, r.pricePerWatt, r.wattage, r.country, r.specs.panelType, r.specs.efficiency, r.specs.weightKg, r.specs.brand) == (200.0, 0.5, 400, "DE", "bifacial", 21.5, 21.5, "Renogy")
    assert r.confidence == pytest.approx(1.0)


def test_selectors():
    p = Page('<div class="a price-x" id="i"><p class=old-price>1<ul><li>x<li data-k="v">y</ul></div><a href="/shop/1">z</a>')
    assert [e.tag for e in p.select('[class*="price"]:not([class*="old"])')] == ["div"]
    assert [e.text() for e in p.select("div li, #i p")] == ["1", "x", "y"]
    assert p.first('[data-k="v"]').text() == "y" and p.first('a[href^="/shop"]') and p.first("ul .a") is None


def test_engine_links(spark):
    rows = [
        ("Bing", '<li class="b_algo"><h2><a href="https://a.com">1</a></h2></li><a href="https://bing.com/x">o</a>'),
        ("Google", '<a href="/url?q=https%3A%2F%2Fb.com%2F&x=1">1</a><a href="https://maps.google.de">2</a><a href="https://c.com">3</a>'),
        ("Yahoo", '<a href="https://r.yahoo/RU=https%3A%2F%2Fd.com/RK=1">1</a>'),
        ("Mojeek", '<a href="https://e.com">1</a><a href="https://www.mojeek.com/about">2</a>'),
        ("Brave", '<a data-url="https://f.com" href="https://g.com">1</a>'),
        ("Ecosia", ""),
    ]
    got = extract.links(spark.createDataFrame(rows, "engine string, html string")).orderBy("engine", "ordinal").collect()
    assert [(r.engine, r.url) for r in got] == [("Bing", "https://a.com")] * 4 + [("Brave", "https://f.com"), ("Google", "https://b.com/"), ("Google", "https://c.com"), ("Mojeek", "https://e.com"), ("Yahoo", "https://d.com")]
    body = json.dumps({"results": [{"url": "https://a"}, {"url": "ftp://b"}, {"url": "https://c"}]})
    assert [r.url for r in extract.json_links(spark.createDataFrame([(1, body), (2, "bad")], "k int, body string")).orderBy("ordinal").collect()] == ["https://a", "https://c"]


def test_cards(spark):
    html = '<li class="product used"><h3>Mono 300W panel</h3><span class="price">€1,200.50</span><a href="/p/1">x</a></li><li class="product"><h3>No price</h3></li>'
    (r,) = extract.cards(spark.createDataFrame([("https://s.com/l", html)], "url string, html string")).collect()
    assert (r.title, r.price, r.currency, r.wattage, r.panelType, r.isUsed, r.url) == ("Mono 300W panel", 1200.5, "EUR", 300, "monocrystalline", True, "https://s.com/p/1")


def test_queries(spark):
    assert len(frontier.solar_queries("US")) == 21 and len(frontier.solar_queries("DE")) == 23
    t = frontier.category_templates("supplements", ["US", "UK", "DE"])
    assert t[0] == "{} (site:allstarhealth.com OR site:dpsnutrition.net)" and "{} buy site:*.co.uk" in t and t[-1] == '"{}" price'
    df = frontier.plan_queries(spark, "creatine 500g", "supplements", ["US"], "quick")
    assert df.count() == 6 and all("500g" not in r.query for r in df.collect())
    q = spark.createDataFrame([(0, "Buy creatine now!"), (1, "now CREATINE buy"), (2, "other")], "ordinal int, query string")
    assert [r.ordinal for r in frontier.distinct_queries(q).orderBy("ordinal").collect()] == [0, 2]


def test_engines_by_query(spark):
    q = spark.createDataFrame([(0,), (2,), (5,)], "ordinal int")
    got = {(r.ordinal, r.engine) for r in frontier.query_engines(q, ["US"]).collect()}
    assert {e for o, e in got if o == 0} == {"Bing", "Yahoo", "Ecosia", "Brave"}
    assert len([1 for o, _ in got if o == 2]) == 11 and (5, "DuckDuckGo") in got
    assert (5, "DuckDuckGo") not in {(r.ordinal, r.engine) for r in frontier.query_engines(q, used=["DuckDuckGo"]).collect()}


def test_requests():
    assert frontier.request("  ok  ", "x", ["DE", "ZZ", "DE"], "deep") == {"query": "ok", "category": "supplements", "countries": ["DE", "DE"], "depth": "deep"}
    assert frontier.request("ok")["countries"] == ["US"]
    for bad in ("a", " a ", "x" * 201, None):
        with pytest.raises(ValueError):
            frontier.request(bad)


def test_first_panels_stay(spark):
    rows = [(0, "u1", "v", 0.52, 0.5, 0.9), (1, "u1", "v", 0.9, 0.9, 0.9), (2, "u2", "v", 0.53, 0.5, 0.9), (3, "u3", "v", 0.05, 0.5, 0.9), (4, "u4", "w", 0.52, 0.5, 0.3), (5, "u5", "w", 0.52, 0.5, 0.4)]
    df = spark.createDataFrame(rows, "ordinal int, url string, vendor string, pricePerWattUsd double, x double, confidence double")
    assert sorted(r.ordinal for r in leaderboard.filtered(df).collect()) == [0, 2, 5]


def test_pages(spark):
    df = spark.range(120).withColumnRenamed("id", "ordinal").orderBy("ordinal")
    assert [r.ordinal for r in leaderboard.page(df, 2, 5).collect()] == [5, 6]
    assert leaderboard.page(df, 0, -3).count() == 50 and leaderboard.page(df, 999, 0).count() == 120
    assert tuple(leaderboard.page_info(df, 50, 50).first()) == (120, 50, 50, True, 3)


def test_budget_and_cache(spark):
    df = spark.sql("SELECT id, timestamp_millis(id * 1000) AS ts, id % 3 AS k FROM range(200)")
    got = {r.id: r.recent for r in limits.in_last(df).collect()}
    assert got == {i: min(i, 59) for i in range(200)}
    hits = limits.cache_hits(df, "k", "ts", 5000)
    assert hits.filter("k = 0").orderBy("at").limit(4).select("hit").collect() == [(False,), (True,), (False,), (True,)]


def test_only_requests_that_are_made_count(spark):
    df = spark.sql("SELECT id, timestamp_millis(id * 500) AS ts, id % 2 AS engine, id < 20 OR id % 2 = 1 AS failed FROM range(400) UNION ALL SELECT 999, NULL, 0, false")
    plain = limits.budgeted(df, "ts", "id").collect()
    assert sum(bool(r.allowed) for r in plain) == 220 and [r.allowed for r in plain if r.id == 999] == [None]
    made, engines, want = [], {}, {}
    for i in range(400):
        made = [t for t in made if i * 500 - t < 60_000]
        n, wrong = engines.get(i % 2, (0, 0))
        want[i] = len(made), len(made) < 60 and not (wrong > 2 * (n - wrong) and n > 5)
        if want[i][1]:
            made.append(i * 500)
            engines[i % 2] = n + 1, wrong + (i < 20 or i % 2 == 1)
    got = {r.id: (r.recent, r.allowed) for r in limits.budgeted(df, "ts", "id", engine="engine", failed="failed").collect() if r.id != 999}
    assert got == want
    apart = spark.sql("SELECT id, timestamp_millis(id * 100 + id DIV 70 * 120000) AS ts FROM range(700)")
    assert sum(r.allowed for r in limits.budgeted(apart, "ts", "id").collect()) == 600


def test_rows_without_a_time_stay(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', timestamp_millis(0)), ('a', NULL), ('a', timestamp_millis(10)) AS t(k, ts)")
    assert sorted((r.at is not None, r.at or 0, r.hit) for r in limits.cache_hits(df, "k", "ts", 5000).collect()) == [(False, 0, False), (True, 0, False), (True, 10, True)]


def test_made_up_urls_and_countries_in_any_case(spark, tmp_path):
    p = {"title": "Panel (A) mono kit", "price": 99, "wattage": 400, "source": "", "vendor": ""}
    (tmp_path / "solar-a.json").write_text(json.dumps([p, p | {"wattage": 300}, p]))
    got = documents.batches(spark, str(tmp_path))
    assert {r.url for r in got.collect()} == {"https://unknown/Panel%20(A)%20mono%20kit"}
    built = leaderboard.build(got)
    assert sorted(r.wattage for r in built.collect()) == [300, 400]
    assert leaderboard.facets(built, ["us"]).count() == 2 and leaderboard.facets(built, most_watts=0).count() == 0


def test_documents(spark, tmp_path):
    p = {"title": "P", "price": "99.5 USD", "wattage": "400W", "source": "s.com"}
    for name, doc in {"solar-a.json": [p], "solar-b.json": {"products": [p | {"title": "Q"}], "panels": [p | {"title": "R", "price": 0}]}, "solar-c.json": {"AU": {"products": [p | {"title": "S", "url": "https://x"}]}, "n": 1}, "solar-leaderboard.json": [p]}.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "solar-d.json").write_text("{bad")
    got = documents.batches(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.title, r.price, r.wattage, r.vendor, r.url) for r in got] == [("P", 99.5, 400, "s.com", "s.com"), ("Q", 99.5, 400, "s.com", "s.com"), ("S", 99.5, 400, "s.com", "https://x")]
    built = leaderboard.build(documents.batches(spark, str(tmp_path)))
    doc = documents.document(built.select("title", "url", "pricePerWatt", "country", "vendor"), leaderboard.metadata(built, 3), "pricePerWatt", "title")
    documents.write_document(doc, str(tmp_path / "out"))
    back = documents.leaderboard(spark, str(tmp_path / "out"), built.select("title", "url").schema)
    assert sorted(r.title for r in back.collect()) == ["P", "Q", "S"]
    documents.write_document(documents.document(back.withColumn("x", F.lit(1)), spark.range(1), "title"), str(tmp_path / "out"))
    assert documents.leaderboard(spark, str(tmp_path / "missing"), back.schema).count() == 0
    (tmp_path / "stock-results-1.json").write_text(json.dumps({"results": {"s.com": "in_stock", "https://x": "unknown"}}))
    (tmp_path / "stock-results-2.json").write_text(json.dumps({"s.com": "out_of_stock"}))
    stocked = leaderboard.with_stock(built, documents.statuses(spark, str(tmp_path)))
    assert sorted((r.title, r.url, r.stockStatus) for r in stocked.collect()) == [("P", "s.com", "out-of-stock"), ("Q", "s.com", "out-of-stock"), ("S", "https://x", "unknown")]


def test_event_texts(spark):
    df = spark.createDataFrame([("progress", '{"a": 1}'), ("complete", "{}")], "event string, data string")
    text = "".join(r.value for r in documents.event_text(df).collect())
    got = documents.parsed_events(spark.createDataFrame([(text + "event: cut",)], "value string")).collect()
    assert [(r.event, r.data) for r in got] == [("progress", '{"a": 1}'), ("complete", "{}")]


def test_saved(spark):
    a, b = (spark.createDataFrame([(u,) for u in us], "url string") for us in (["x", "y"], ["y", "z"]))
    assert sorted(r.url for r in documents.insert_absent(a, b).collect()) == ["x", "y", "z"]
    assert [r.url for r in documents.removed(a, "x").collect()] == ["y"]


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("e", i, 1000 * i, i in (1, 2, 3), 30000) for i in range(6)]
    spark.createDataFrame(rows, "key string, seq long, at_ms long, failed boolean, base_ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, at_ms long, failed boolean, base_ms long").parquet(str(tmp_path / "in"))
    got = state.run_now(state.cooled_down(stream), "cool", str(tmp_path / "c1")).orderBy("seq").collect()
    assert [r.run for r in got] == [0, 1, 2, 3, 0, 0]
    assert got[3].until_ms == 3000 + 120000 and [r.allowed for r in got] == [True, True, False, False, False, False]
    got = state.run_now(state.budgeted(stream), "budget", str(tmp_path / "c2")).orderBy("seq").collect()
    assert [r.recent for r in got] == [0, 1, 2, 3, 4, 5]
    got = state.run_now(state.cached(stream.withColumn("entry", F.lit("q"))), "cache", str(tmp_path / "c3")).orderBy("seq").collect()
    assert [r.hit for r in got] == [False, True, True, True, True, True]


def test_the_dimensions_are_complete():
    assert [len(fixed.VENDORS[c]) for c in fixed.CATEGORIES] == [40, 37, 34] and [len(fixed.DEAL_SITES[c]) for c in fixed.CATEGORIES] == [6, 5, 3]
    assert len(fixed.EXCLUDED) == 29 and [len(fixed.EXCLUDED_BY_CATEGORY[c]) for c in fixed.CATEGORIES] == [12, 7, 7]
    assert len(fixed.SOLAR_VENDORS) == 22 and len(fixed.SOLAR_EXCLUDED) == 45 and len(fixed.BLOCK_SIGNALS) == 32 and len(fixed.BROWSER_DOMAINS) == 32 and len(fixed.SOLAR_BRANDS) == 25 and len(fixed.COUNTRIES) == 14

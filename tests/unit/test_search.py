"""Whole searches over stored pages."""

from pyspark.sql import functions as F

from offermill.__main__ import arguments
from offermill.operators import display, frontier
from offermill.plans import search
from offermill.streaming import progress

PRODUCT = '<title>Creatine powder of brand {} 500g</title><b class="price">${}</b>'


def test_search(spark):
    query = frontier.plan_queries(spark, "creatine", "supplements", ["US"], "quick").orderBy("ordinal").first().query
    html = "".join(f'<li class="b_algo"><h2><a href="{u}">x</a></h2></li>' for u in ("https://shop{0}.com/product/1", "https://shop{1}.com/product/1", "https://reddit.com/x"))
    results = spark.createDataFrame([("Bing", query, html.replace("{0}", "a").replace("{1}", "b")), ("DuckDuckGo", query, '<a href="https://never.com">x</a>')], "engine string, query string, html string")
    pages = spark.createDataFrame([("https://shopa.com/product/1", PRODUCT.format("A", "30.00")), ("https://shopb.com/product/1", PRODUCT.format("B", "20.00")), ("https://reddit.com/x", PRODUCT.format("C", "1.00")), ("https://never.com", PRODUCT.format("D", "1.00"))], "url string, html string")
    ranked, answer = search.search(spark, results, pages, " creatine ", depth="quick")
    assert [(r.rank, r.vendor) for r in ranked.orderBy("rank").collect()] == [(1, "shopb.com"), (2, "shopa.com")]
    row = answer.first()
    assert row.query == "creatine" and row.best_deal.vendor == "shopb.com" and [r.vendor for r in row.results] == ["shopb.com", "shopa.com"]


def test_panel_rows(spark):
    specs = "struct<wattage:long,panelType:string,efficiency:double,dimensions:struct<lengthMm:double,widthMm:double,depthMm:double>,weightKg:double,brand:string>"
    row = ("u", 0.5, 200.0, (400, "bifacial", 21.46, (1722.0, 1134.0, None), None, None), (None, None, True), 0.856)
    df = spark.createDataFrame([row], f"url string, pricePerWattUsd double, priceUsd double, specs {specs}, shipping struct<cost:double,freeThreshold:double,isFree:boolean>, confidence double")
    r = display.panel_rows(df).first()
    assert (r.per_watt, r.price, r.watts, r.type, r.efficiency, r.brand, r.dimensions, r.weight, r.shipping, r.stock, r.confidence) == ("$0.500", "200.00", "400W", "Bifa", "21.5%", "-", "1722 x 1134 x ? mm", "-", "Free", "Unknown", "86%")


def test_toggles_and_arguments():
    assert display.toggled(["US"], "DE") == ["US", "DE"] and display.toggled(["US", "DE"], "US") == ["DE"] and display.toggled(["US"], "US") == ["US"]
    a = arguments(["r", "p", "o", "--countries", "us,zz", "--max-pages", "x"])
    assert a.countries == ["US"] and a.max_pages == 3000


def test_progress_events(spark):
    df, seen = progress.observed(spark.range(7), "extracting")
    df.count()
    df.select(F.sum("id")).collect()
    assert seen.get["rows"] == 7
    assert progress.event("progress", {"stage": "x"}) == 'event: progress\ndata: {"stage": "x"}\n\n'
    now = [0.0]
    loads = []
    fresh = progress.Fresh(lambda: loads.append(1) or spark.range(1), 5, lambda: now[0])
    fresh.get(), fresh.get()
    now[0] = 301
    fresh.get()
    assert len(loads) == 2

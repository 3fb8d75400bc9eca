"""Queries over pages of each kind of markup that engines and shops use, around the urls of all pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls
from .offers import table
from .register import query

#: A result page of each engine: {a} and {b} are results as they stand, {A} and {B} escaped; other links are the engine's own.
RESULT_PAGES = {
    "Brave": "<a data-url='{a}' href='https://brave.com/r'>x</a><div class='snippet'><a href='{b}'>y</a><a href='https://search.brave.com/s'>o</a></div>",
    "DuckDuckGo": "<a class='result-link' href='{a}'>x</a><table><tr><td><a href='{b}'>y</a></td></tr></table><a href='https://duckduckgo.com/z'>o</a>",
    "Google": "<a href='/url?q={A}&amp;sa=U'>x</a><a href='{b}'>y</a><a href='https://www.youtube.com/w'>o</a><a href='https://maps.google.com/m'>o</a>",
    "GoogleShopping": "<a href='https://s.example/shopping/product/1?url={A}'>x</a><div class='sh-dgr__content'><a href='https://s.example/r?q={B}'>y</a></div><a href='https://google.com/z'>o</a>",
    "Ecosia": "<a class='result__link' href='{a}'>x</a><div class='result'><a href='{b}'>y</a><a href='https://www.ecosia.org/i'>o</a></div>",
    "Yahoo": "<a href='https://r.search.yahoo.example/RU={A}/RK=2'>x</a><a href='https://r.search.yahoo.example/RU={B}/RK=2'>y</a><a href='https://yahoo.example/about'>o</a>",
    "Startpage": "<a class='w-gl__result-url' href='{a}'>x</a><div class='result'><a href='{b}'>y</a></div><div class='result'><a href='https://www.startpage.com/p'>o</a></div>",
    "Bing": "<ol><li class='b_algo'><h2><a href='{a}'>x</a></h2></li><li class='b_algo'><p><a href='{b}'>y</a></p></li></ol><a href='https://www.bing.com/x'>o</a><a href='https://go.microsoft.com/y'>o</a>",
    "Mojeek": "<ul class='results-standard'><li><a class='ob' href='{a}'>x</a></li></ul><a class='title' href='{b}'>y</a><a class='title' href='https://www.mojeek.com/a'>o</a>",
    "Yandex": "<div class='serp-item'><a class='link' href='{a}'>x</a></div><div class='OrganicTitle'><a href='{b}'>y</a></div><a href='https://yandex.ru/x'>o</a>",
    "Qwant": "<a data-testid='serp-url' href='{a}'>x</a><div class='result__url'><a href='{b}'>y</a></div><a href='https://www.qwant.com/x'>o</a>",
    "SearXNG": "<div class='result'><a class='url_wrapper' href='{a}'>x</a></div><article><a href='{b}'>y</a></article><article><a href='https://searx.example/x'>o</a></article>",
}
#: A page that no selector of most engines knows: theirs is the fallback.
PLAIN_PAGE = "<p><a href='{a}'>x</a> and <a href='/inside'>y</a>"


def filled(text: str, values: dict[str, Column]) -> Column:
    """A text with columns in place of {names}."""
    import re

    parts = re.split(r"(\{\w+\})", text)
    return F.concat(*(values[p[1:-1]] if p.startswith("{") and p[1:-1] in values else F.lit(p) for p in parts if p))


_ENGINES = "['" + "', '".join(RESULT_PAGES) + "']"


@query(f"""WITH e AS (SELECT page_id, {_ENGINES}[page_id % 12 + 1] AS engine, page_id // 12 % 2 = 1 AS plain, url FROM pages)
SELECT page_id, engine, url || '/' || x AS url FROM e, (SELECT unnest(['a', 'b']) AS x) WHERE NOT plain OR x = 'a' AND engine NOT IN ('Brave', 'Yahoo', 'Startpage')""")
def links_of_all_engines(spark, sf_dir):
    """The results on pages of all twelve engines, half of them in markup that only fallbacks know."""
    from ..operators.extract import links

    a, b = F.concat("url", F.lit("/a")), F.concat("url", F.lit("/b"))
    html = lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))
    values = {"a": html(a), "b": html(b), "A": urls.encoded(a), "B": urls.encoded(b)}
    k, page = F.col("page_id") % 12, F
    for i, text in enumerate(RESULT_PAGES.values()):
        page = page.when(k == i, filled(text, values))
    engine = F.element_at(F.array(*(F.lit(e) for e in RESULT_PAGES)), (k + 1).cast("int"))
    results = table(spark, sf_dir, "pages").select("page_id", engine.alias("engine"), F.when(F.expr("page_id DIV 12 % 2 = 1"), filled(PLAIN_PAGE, values)).otherwise(page).alias("html"))
    return links(results).select("page_id", "engine", "url").distinct()


#: Shop pages by where they state price, size and code; {n} is a number of the page.
SHOP_PAGES = [
    "<meta property='og:title' content='Jar {n}'><script type='application/ld+json'>{\"@type\": \"Product\", \"gtin13\": \"4006381333931\", \"sku\": \"S-{n}\", \"offers\": {\"price\": {n}, \"priceCurrency\": \"EUR\"}}</script><meta name='description' content='Holds 250g'><p>free shipping</p>",
    "<h1>Box {n}</h1><meta property='product:price:amount' content='{n}.25'><meta property='product:upc' content='012345678905'><div class='product-detail'>Size: 2 kg</div><p>free shipping on orders over $20</p>",
    "<title>Bag {n} of 60 capsules</title><span data-price='{n}.75'></span><span itemprop='gtin12' content='012345678905'></span><span class='shipping-cost'>$3.99</span>",
    "<h1>Tin {n} 12 oz</h1><p>Only ${n}.99 today. EAN: 4006381333931. Subscribe &amp; save 15%</p>",
    "<h1>Tub {n} 5 lb</h1><b class='sale-price'>€{n}.50</b><del>€900.00</del><i data-barcode='4006381333931'></i><u class='promo-code'>Use CODE{n}X for 10% off</u><p>Buy 2 save 20%</p>",
]


@query("""WITH p AS (SELECT page_id, page_id % 5 AS k, page_id % 300 + 10 AS n FROM pages)
SELECT page_id, ['Jar ', 'Box ', 'Bag ', 'Tin ', 'Tub '][k + 1] || n || ['', '', ' of 60 capsules', ' 12 oz', ' 5 lb'][k + 1] AS title, n + ([0.0, 0.25, 0.75, 0.99, 0.5]::DOUBLE[])[k + 1] AS price, ['EUR', 'USD', 'USD', 'USD', 'EUR'][k + 1] AS currency,
 ([250, 2, 60, 12, 5]::DOUBLE[])[k + 1] AS quantity, ['g', 'kg', 'capsules', 'oz', 'lb'][k + 1] AS unit, ['4006381333931', '012345678905', '012345678905', '4006381333931', '4006381333931'][k + 1] AS upc,
 ['json-ld', 'meta-tag', 'microdata', 'text-pattern', 'data-attribute'][k + 1] AS code_source, CASE WHEN k = 0 THEN 'S-' || n END AS sku, CASE k WHEN 1 THEN CASE WHEN n + 0.25 >= 20 THEN 0.0::DOUBLE END WHEN 2 THEN 3.99::DOUBLE END AS shipping_cost,
 CASE WHEN k = 1 THEN 20.0::DOUBLE END AS threshold, k = 0 OR k = 1 AS free, CASE WHEN k = 4 THEN 900.0::DOUBLE END AS original, CASE WHEN k = 3 THEN '15%' END AS subscribe, CASE WHEN k = 4 THEN 'CODE' || n || 'X' END AS coupon, CASE WHEN k = 4 THEN 'Buy 2 save 20%' END AS bulk FROM p""")
def facts_by_every_path(spark, sf_dir):
    """Products whose price, size and code each stand where another kind of shop has them: structured data, meta tags, attributes, text and slots."""
    from ..operators.extract import product_records

    n, page = (F.col("page_id") % 300 + 10).cast("string"), F
    for i, text in enumerate(SHOP_PAGES):
        page = page.when(F.col("page_id") % 5 == i, filled(text, {"n": n}))
    df = product_records(table(spark, sf_dir, "pages").select("page_id", "url", page.alias("html")))
    s, p = F.col("shipping"), F.col("promotion")
    return df.select(
        "page_id", "title", "price", "currency", "quantity", "unit", F.col("primaryUpc").alias("upc"), F.get("identifiers", F.lit(0))["source"].alias("code_source"), "sku", s["cost"].alias("shipping_cost"), s["freeThreshold"].alias("threshold"),
        s["isFree"].alias("free"), F.col("original_price").alias("original"), p["subscribeDiscount"].alias("subscribe"), p["couponCode"].alias("coupon"), p["bulkDiscount"].alias("bulk"),
    )

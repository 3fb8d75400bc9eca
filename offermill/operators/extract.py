"""Records out of page facts: which fact counts, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import barcodes, fixed, parse, scores, urls
from ..functions.numbers import found, prefix_number
from ..sources.html import CARDS, LINKS, listing_cards, mapped, page_facts, result_links
from .ranking import distinct_identifiers, first_code, first_sku


def _first(texts: Column, parser, fine) -> Column:
    """The first text that parses to something fine."""
    return F.get(F.filter(F.transform(texts, lambda t: parser(t)), lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(0))


def title(df: DataFrame) -> Column:
    raw = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("og_title", "h1", "title_tag")))
    return F.nullif(parse.title(raw), F.lit(""))


def _price(most: float, scan: Column, pattern: str, low: float, high: float, ready: Column) -> Column:
    """Structured data, else meta tag (its currency is lost), else slots, else amounts in the text."""
    data = prefix_number(F.col("json_price"))
    within = lambda a, b: lambda p: (p["value"] > a) & (p["value"] < b)
    seen = F.when(ready, _first(F.regexp_extract_all(scan, F.lit(pattern), F.lit(0)), parse.price, within(low, high)))
    return F.coalesce(F.when(data.isNotNull(), F.struct(data.alias("value"), F.col("json_currency").alias("currency"))), parse.price(F.col("price_meta")), _first(F.col("price_texts"), parse.price, within(0, most)), seen)


def _identifiers() -> Column:
    """All codes in the order of their sources; those in the text count only if their check digit is right."""
    entry = lambda code, source, named: F.struct(code.alias("code"), F.lit(source).alias("source"), named.cast("string").alias("named"))
    from_source = lambda s: lambda v: entry(v, s, F.lit(None))
    given = F.transform("json_codes", lambda c: entry(c["value"], "json-ld", F.when(c["field"].isin("sku", "mpn"), c["field"])))
    listed = [F.transform(F.col(c), from_source(s)) for c, s in (("meta_codes", "meta-tag"), ("itemprop_codes", "microdata"), ("data_codes", "data-attribute"))]
    texts = [F.transform(F.regexp_extract_all("body_text", F.lit("(?i)" + p), F.lit(1)), from_source("text-pattern")) for p in fixed.CODE_TEXTS]
    codes = F.transform(F.concat(given, *listed, *texts), lambda e: F.struct(F.when(e["named"].isNull(), barcodes.normal(e["code"])).otherwise(e["code"]).alias("code"), e["source"].alias("source"), e["named"].alias("named")))
    kinds = F.transform(codes, lambda e: F.struct(barcodes.kind(e["code"]).alias("kind"), e.alias("e")))
    ids = F.transform(kinds, lambda k: F.struct(
        F.coalesce(k["e"]["named"], k["kind"]["type"]).alias("type"), k["e"]["code"].alias("value"), (k["e"]["named"].isNotNull() | k["kind"]["isValid"]).alias("isValidCheckDigit"), k["e"]["source"].alias("source"),
    ))
    return F.filter(ids, lambda i: (i["type"] != "unknown") & ((i["source"] != "text-pattern") | i["isValidCheckDigit"]))


def shipping(price: Column, most: float = 100) -> Column:
    """struct(cost, freeThreshold, isFree). A threshold's sentence says free, below it too."""
    text = F.lower("body_text")
    free = text.rlike("|".join(fixed.FREE_SHIPPING))
    threshold = F.coalesce(*(found(text, p).try_cast("double") for p in fixed.FREE_THRESHOLD))
    cost = _first(F.col("shipping_texts"), parse.price, lambda p: p["value"] < most)["value"]
    reached = F.coalesce((threshold > 0) & (price >= threshold), F.lit(False))
    return F.struct(F.when(reached, 0.0).otherwise(cost).alias("cost"), threshold.alias("freeThreshold"), (reached | free).alias("isFree"))


def promotion() -> Column:
    """struct(hasCoupon, couponCode, couponDiscount, subscribeDiscount, bulkDiscount), null if there is none."""
    code = "(?<![A-Za-z0-9_])([A-Z0-9]{4,15})(?![A-Za-z0-9_])"
    coupon = F.get(F.filter("coupon_texts", lambda t: t.rlike(code)), F.lit(0))
    subscribe = F.coalesce(*(found(F.col("body_text"), "(?i)" + p) for p in fixed.SUBSCRIBE))
    bulk = F.coalesce(*(found(F.col("body_text"), "(?i)" + p, 0) for p in fixed.BULK))
    own = F.struct(coupon.isNotNull().alias("hasCoupon"), found(coupon, code).alias("couponCode"), found(coupon, "(?i)(\\d+%?\\s*off|\\$\\d+\\s*off)").alias("couponDiscount"), subscribe.alias("subscribeDiscount"), bulk.alias("bulkDiscount"))
    return F.when(coupon.isNotNull() | subscribe.isNotNull() | bulk.isNotNull(), own)


def product_records(pages: DataFrame) -> DataFrame:
    """A record of each page (url, html, ...) that has a title."""
    df = page_facts(pages)
    df = df.withColumn("title", title(df)).filter("title IS NOT NULL")
    some = lambda q: (q["value"] != 0)
    asked = lambda t: F.get(F.filter(F.array(parse.quantity(t)), lambda q: q["value"] != 0), F.lit(0))
    df = df.withColumns({
        "_price": _price(10000, F.col("body_text"), "[$€£]\\s*\\d+\\.?\\d*", 1, 500, F.lit(True)),
        "_quantity": F.coalesce(asked(F.col("title")), asked(F.col("description")), _first(F.col("detail_texts"), parse.quantity, some)),
        "identifiers": distinct_identifiers(_identifiers()),
        "_sale": _first(F.col("sale_texts"), parse.price, lambda p: p["value"] < 10000)["value"], "_listed": _first(F.col("original_texts"), parse.price, lambda p: p["value"] < 10000)["value"],
    })
    main, sale = F.col("_price")["value"], F.col("_sale")
    listed = F.when(sale.isNull() | (F.col("_listed") > sale), F.col("_listed"))
    df = df.withColumns({"price": F.least(main, F.when(main.isNotNull(), sale)), "currency": F.coalesce(F.col("_price")["currency"], F.lit("USD")), "_listed": listed})
    original = F.when(F.col("_listed") > F.col("price"), F.col("_listed")).when(sale < main, main)
    df = df.withColumns({
        "quantity": F.col("_quantity")["value"], "unit": F.col("_quantity")["unit"], "rawQuantity": F.concat(F.col("_quantity")["value"].cast("string"), F.col("_quantity")["unit"]),
        "vendor": urls.domain(F.col("url")), "primaryUpc": first_code(F.col("identifiers")), "sku": first_sku(F.col("identifiers")), "original_price": original,
        "discount_percent": scores.discount_percent(F.col("_listed"), F.col("price")), "shipping": F.when(F.col("price").isNotNull(), shipping(F.col("price"))), "promotion": promotion(),
    })
    own = [c for c in pages.columns if c not in ("html", "url")]
    return df.select(*own, "title", "price", "currency", "rawQuantity", "quantity", "unit", "url", "vendor", "identifiers", "primaryUpc", "sku", "original_price", "discount_percent", "shipping", "promotion")


def product_signals() -> Column:
    cart = F.lower("body_text").rlike("add.to.cart|add.to.basket|buy.now|purchase")
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("json_product"), cart, F.col("product_meta"), F.col("price_itemprop"), F.col("price_data"))), F.lit(0))


def panel_records(pages: DataFrame) -> DataFrame:
    """A panel of each product page that states a price and plausible watts."""
    df = page_facts(pages)
    df = df.withColumns({"title": title(df), "_signals": product_signals()}).filter("title IS NOT NULL AND _signals > 0")
    data = prefix_number(F.col("json_price"))
    df = df.withColumn("_price", _price(50000, F.col("body_text"), "[$€£]\\s*\\d+[.,]?\\d*", 30, 50000, F.col("_signals") >= 2)).filter(F.col("_price")["value"] > 0)
    any_ = lambda x: x.isNotNull()
    area = lambda parser: _first(F.col("area_texts"), parser, any_)
    from_title = parse.panel_type(F.col("title"))
    brand = F.coalesce("json_brand", F.get(F.filter(F.array(*(F.lit(b) for b in fixed.SOLAR_BRANDS)), lambda b: F.lower("title").contains(F.lower(b))), F.lit(0)))
    df = df.withColumns({"price": F.col("_price")["value"], "currency": F.col("_price")["currency"], "wattage": F.coalesce(parse.wattage(F.col("title")), _first(F.col("spec_texts"), parse.wattage, any_))})
    df = df.filter((F.col("wattage") > 5) & (F.col("wattage") <= 1000))
    df = df.withColumns({
        "panelType": F.when(from_title != "unknown", from_title).otherwise(parse.panel_type(F.col("body_text"))), "efficiency": F.coalesce(area(parse.efficiency), parse.efficiency(F.col("body_text"))),
        "dimensions": area(parse.dimensions), "weightKg": area(parse.weight_kg), "brand": brand, "vendor": urls.domain(F.col("url")), "country": F.coalesce(urls.country(F.col("url")), F.lit("US")), "shipping": shipping(F.col("price"), 500),
    })
    ship = F.col("shipping")
    df = df.withColumn("confidence", scores.solar_confidence(F.col("price"), data.isNotNull(), F.col("wattage"), F.col("efficiency"), ship["isFree"] | ship["cost"].isNotNull(), F.col("brand"), F.col("json_product")))
    specs = F.struct("wattage", "panelType", "efficiency", "dimensions", "weightKg", F.lit(None).cast("string").alias("warranty"), F.lit(None).cast("long").alias("cellCount"), "brand", F.lit(None).cast("string").alias("model"))
    own = [c for c in pages.columns if c not in ("html", "url")]
    from .leaderboard import priced_per_watt

    return priced_per_watt(df).withColumn("specs", specs).select(*own, "title", "price", "currency", "priceUsd", "pricePerWatt", "pricePerWattUsd", "wattage", "specs", "vendor", "url", "country", "shipping", "confidence")


def links(results: DataFrame) -> DataFrame:
    """url of each link on stored result pages (engine, html, ...), unwrapped, in order, at most 50 of a page."""
    df = mapped(results, lambda h, e: result_links(h, e) if e in fixed.ENGINE_LINKS else [], LINKS, also="engine")
    url = F.lit(None).cast("string")
    for e in ("Google", "GoogleShopping", "Yahoo"):
        url = F.when(F.col("engine") == e, urls.unwrapped(F.col("href"), e)).otherwise(url)
    url = F.when(F.col("engine").isin("Google", "GoogleShopping", "Yahoo"), url).otherwise(F.col("href"))
    df = df.withColumn("url", url).filter(F.col("url").startswith("http"))
    own = F.array(*(F.lit(x) for x in fixed.ENGINE_LINKS["Google"]["own"]))
    df = df.filter((F.col("engine") != "Google") | ~F.exists(own, lambda o: F.col("url").contains(o)))
    from .frontier import first_per_source

    keys = [c for c in results.columns if c != "html"]
    return first_per_source(df, keys).drop("href")


def json_links(bodies: DataFrame, body: str = "body", most: int = fixed.LINKS_KEPT) -> DataFrame:
    """url of each result of JSON result documents, in order."""
    rows = F.from_json(body, "results array<struct<url string>>")["results"]
    fine = F.slice(F.filter(rows, lambda r: r["url"].startswith("http")), 1, most)
    return bodies.select(*[c for c in bodies.columns if c != body], F.posexplode(F.transform(fine, lambda r: r["url"])).alias("ordinal", "url"))


def either_links(results: DataFrame) -> DataFrame:
    """url of each result, in order: of the JSON body where it has any, else of the markup. results: keys, engine, body, html."""
    keys = [c for c in results.columns if c not in ("body", "html")]
    found = json_links(results.select(*keys, "body"))
    rest = results.drop("body").join(found.select(*keys).distinct(), keys, "left_anti")
    columns = [*keys, F.col("ordinal").cast("long").alias("ordinal"), "url"]
    return found.select(*columns).unionByName(links(rest).select(*columns))


def cards(listings: DataFrame) -> DataFrame:
    """Cards of listing pages (url, html, ...): title, price, currency, wattage, panelType, isUsed and url."""
    df = mapped(listings.withColumnRenamed("url", "page_url"), listing_cards, CARDS, also="page_url")
    words = F.concat_ws(" ", "title", "classes")
    low = F.lower(words)
    amount = F.regexp_extract("price_text", r"[$€£A-Z]*\s*([\d,]+\.?\d*)", 1)
    price = F.regexp_replace(amount, "^([^,]*),", "$1").try_cast("double")
    kind = F.when(low.contains("mono") & ~low.contains("poly"), "monocrystalline").when(low.contains("poly"), "polycrystalline").when(low.contains("bifacial"), "bifacial").when(low.contains("thin") & low.contains("film"), "thin-film").otherwise("unknown")
    code = F.when(F.col("price_text").contains("€"), "EUR").when(F.col("price_text").contains("£"), "GBP").when(F.col("price_text").contains("A$"), "AUD").otherwise("USD")
    df = df.withColumns({"price": price, "currency": code, "wattage": found(words, r"(?i)(\d+)\s*[-]?\s*(?:watt|w)(?![A-Za-z0-9_])").try_cast("long"), "panelType": kind, "isUsed": low.rlike("used|refurbished|blemish")})
    return df.filter((F.col("title") != "") & (F.col("price") > 5) & (F.col("link") != "")).drop("price_text", "classes").withColumnRenamed("link", "url")

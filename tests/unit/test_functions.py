"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from offermill.functions import barcodes, fixed, formats, numbers, parse, scores, urls


def values(spark, cases, make, kinds="string"):
    rows = [c if isinstance(c, tuple) else (c,) for c in cases]
    names = [f"c{i}" for i in range(len(rows[0]))]
    kinds = kinds.split()
    schema = ", ".join(f"{n} {kinds[min(i, len(kinds) - 1)]}" for i, n in enumerate(names))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(make(*(F.col(n) for n in names))).collect()]


PRICES = {
    "$19.99": (19.99, "USD"), "€15,50": (15.5, "EUR"), "£12.99": (12.99, "GBP"), "¥1500": (1500.0, "JPY"), "₹ 499": (499.0, "INR"), "19.99 USD": (19.99, "USD"), "15.50 eur": (15.5, "EUR"),
    "price 24.95 only": (24.95, "USD"), "$1,299.99": (1.29, "USD"), "29.99 SEK": (29.99, "USD"), "299 SEK": None, "free": None, "": None, "$0": None, None: None,
}
QUANTITIES = {
    "500g": (500.0, "g"), "1.5 kg": (1.5, "kg"), "2 lbs": (2.0, "lbs"), "3 pounds": (3.0, "lb"), "100 capsules": (100.0, "capsules"), "60 Tabs": (60.0, "tablets"), "2.2 fl oz": (2.2, "fl oz"), "5000 IU": (5000.0, "iu"),
    "30 veggie caps": (30.0, "capsules"), "12 gummies": (12.0, "servings"), "120 x 500mg": (500.0, "mg"), "4 x 30gx": (120.0, "g"), "250 ml": (250.0, "ml"), "1 litre": (1.0, "l"), "no quantity": None, "500gé": (500.0, "g"), None: None,
}


@pytest.mark.parametrize(("cases", "parser"), [(PRICES, parse.price), (QUANTITIES, parse.quantity)])
def test_parsed_pairs(spark, cases, parser):
    assert [tuple(x) if x else None for x in values(spark, list(cases), parser)] == list(cases.values())


def test_thousands_can_be_dropped(spark):
    assert values(spark, ["$1,299.99"], lambda c: parse.price(c, thousands=True)["value"]) == [1299.99]


def test_panel_specs(spark):
    assert values(spark, ["400W", "400-Watt", "0.4kW", "1.2 kw", "150kW 300W", "400 Watts mono", "x", None], parse.wattage) == [400, 400, 400, 1200, 300, 400, None, None]
    assert values(spark, ["Bifacial mono", "MONO", "monopoly", "poly", "thin film", "thin-film", "amorphous", "x", None], parse.panel_type) == ["bifacial", "monocrystalline", "monocrystalline", "polycrystalline", "thin-film", "thin-film", "thin-film", "unknown", "unknown"]
    assert values(spark, ["22.8%", "efficiency: 21 %", "21.5 percent", "60%", "3% off, efficiency 20%", None], parse.efficiency) == [22.8, 21.0, 21.5, None, 20.0, None]
    got = values(spark, ["1722 x 1134 x 30 mm", "67.7 x 44.6 x 1.18 in", "10x20mm", "10×20 inches", '67" ', None], parse.dimensions)
    assert [tuple(x) if x else None for x in got] == [(1722.0, 1134.0, 30.0), (1719.6, 1132.8, 30.0), (10.0, 20.0, None), (254.0, 508.0, None), None, None]
    assert values(spark, ["21.5 kg", "47.4 lbs", "900 kg, 10 lb", "x"], parse.weight_kg) == [21.5, 21.5, 4.54, None]


def test_titles(spark):
    assert values(spark, ["  A &  B ", "Café—(x), 1.5-g!", "a" * 300, None], parse.title) == ["A  B", "Caf(x), 1.5-g", "a" * 200, None]


def test_barcodes(spark):
    assert values(spark, ["012345678905", "012345678906", "12345", "01234567890a", None], barcodes.upc_a) == [True, False, False, False, False]
    assert values(spark, ["4006381333931", "4006381333932"], barcodes.ean_13) == [True, False]
    assert values(spark, ["10012345678902", "10012345678903"], barcodes.gtin_14) == [True, False]
    assert values(spark, ["0123-4567 8905", "12345678905"], barcodes.normal) == ["012345678905", "012345678905"]
    got = values(spark, ["012345678905", "4006381333931", "10012345678902", "AB-12", "a b", "abc"], barcodes.kind)
    assert [tuple(x) for x in got] == [("upc-a", True), ("ean-13", True), ("gtin-14", True), ("sku", True), ("unknown", False), ("unknown", False)]
    assert values(spark, ["012345678905", "4006381333931"], barcodes.as_ean) == ["0012345678905", "4006381333931"]


def test_units_and_currencies(spark):
    cases = [(1.0, "kg"), (500.0, " MG "), (2.0, "lb"), (1.0, "oz"), (1.0, "fl oz"), (5.0, "capsules"), (1.0, None)]
    assert values(spark, cases, scores.grams, "double string") == pytest.approx([1000.0, 0.5, 907.184, 28.3495, 29.5735, None, None])
    assert values(spark, [(10.0, "eur"), (10.0, "XYZ"), (1000.0, "JPY")], scores.usd, "double string") == pytest.approx([10.8, 10.0, 6.7])


def test_confidence(spark):
    make = lambda p, q, u, t: scores.confidence(p, q, u, t)
    assert values(spark, [(1.0, 1.0, "g", "Creatine 500g powder"), (None, 1.0, "ml", "short"), (0.0, 0.0, None, None)], make, "double double string string") == pytest.approx([1.0, 0.3, 0.0])
    full = lambda p, q, u, t: scores.confidence_with_upc(p, q, u, t, F.lit(True), F.lit(9))
    assert values(spark, [(1.0, 1.0, "g", "Creatine 500g powder")], full, "double double string string") == pytest.approx([1.1 / 1.2])


def test_domains_and_countries(spark):
    cases = ["https://www.Shop.example.co.uk:8080/x", "http://a.de", "https://b.com.au/", "https://c.com", "https://d.net", "nonsense", None, "https://e.co.jp", "https://notuk.uk"]
    assert values(spark, cases, urls.domain) == ["shop.example.co.uk", "a.de", "b.com.au", "c.com", "d.net", "unknown", "unknown", "e.co.jp", "notuk.uk"]
    assert values(spark, cases, urls.country) == ["UK", "DE", "AU", "US", None, None, None, "JP", "UK"]


def test_tiers(spark):
    cases = ["https://www.iherb.com/pr/x", "https://allstarhealth.com/a", "https://slickdeals.net/x", "https://x.org/product/1", "https://x.org/?sku=1", "https://x.org/a", "https://notallstarhealth.com/"]
    own = lambda u: urls.tier(u, fixed.VENDORS["supplements"], fixed.DEAL_SITES["supplements"])
    assert values(spark, cases, own) == [5, 1, 2, 3, 3, 4, 1]
    rendered = lambda u: urls.tier(u, fixed.VENDORS["supplements"], fixed.DEAL_SITES["supplements"], True)
    assert values(spark, cases[:1], rendered) == [1]
    solar = lambda u: urls.tier(u, fixed.SOLAR_VENDORS, fixed.SOLAR_DEAL_SITES, False, "solar|panel|watt")
    assert values(spark, ["https://x.org/my-solar", "https://renogy.com/a"], solar) == [3, 1]
    assert values(spark, ["https://screwfix.com/p", "https://iherb.com"], lambda u: urls.is_excluded(u, "building")) == [True, False]
    assert values(spark, ["https://a.com/blog/x", "https://costco.com/x", "https://a.com/shop"], urls.is_blog) == [True, True, False]


def test_blocked(spark):
    assert values(spark, ["solve the CAPTCHA", "recaptcha", "Access denied, bot detected", "fine", None], urls.blocked) == [False, True, True, False, False]


def test_redirects(spark):
    assert values(spark, ["/url?q=https%3A%2F%2Fa.com%2Fx%2By&sa=1", "https://b.com", "/url?q=%zz"], lambda u: urls.unwrapped(u, "Google")) == ["https://a.com/x+y", "https://b.com", None]
    assert values(spark, ["https://r.search/RU=https%3a%2f%2fa.com/RK=2", "https://x"], lambda u: urls.unwrapped(u, "Yahoo")) == ["https://a.com", None]


def test_numbers(spark):
    assert values(spark, [2.5, -2.5, 1.005, 0.1], lambda x: numbers.half_up(x), "double") == [3.0, -2.0, 1.0, 0.0]
    assert values(spark, [1.005, 2.675], lambda x: numbers.half_up(x, 2), "double") == [1.0, 2.68]
    assert values(spark, ["12abc", " -1.5e2x", ".5", "abc", ""], numbers.prefix_number) == [12.0, -150.0, 0.5, None, None]


def test_formats(spark):
    assert values(spark, [(12.5, "USD"), (3.0, "SEK"), (None, "USD"), (1.0, "AUD")], formats.currency, "double string") == ["$12.50", "SEK 3.00", "—", "A$1.00"]
    assert values(spark, [(0.005, "g"), (0.25, "g"), (None, "g")], formats.price_per_unit, "double string") == ["0.0050/g", "0.25/g", "—/g"]
    assert values(spark, [(500.0, "g"), (1.5, "kg"), (None, "g")], formats.quantity, "double string") == ["500 g", "1.5 kg", "—"]
    assert values(spark, ["short", "a longer text"], lambda t: formats.truncated(t, 8)) == ["short", "a lon..."]
    assert values(spark, [999, 1000, 61000, 3599999], formats.elapsed, "long") == ["999ms", "1s", "1m 1s", "59m 59s"]
    assert values(spark, [("starting", 0, 0), ("searching", 6, 12), ("searching", 0, 12), ("crawling", 5, 10), ("crawling", None, None), ("complete", 0, 0)], formats.progress, "string long long") == [2.0, 22.5, 10.0, 60.0, 50.0, 100.0]
    assert values(spark, ["monocrystalline"], formats.type_label) == ["Mono"]

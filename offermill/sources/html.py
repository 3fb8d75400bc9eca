"""Pages as facts: a lenient parser, a small selector language, and what product pages, result pages and listings hold.

Only what needs a document tree is done in Python; prices, quantities and all decisions are column expressions over the
facts. One page is parsed once, whole batches at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import fixed

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}


class Element:
    __slots__ = ("attributes", "children", "order", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, order: int):
        self.tag, self.attributes, self.parent, self.order, self.children = tag, attributes, parent, order, []

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(parts)

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#document", {}, None, 0)
        self.elements: list[Element] = []

    def handle_starttag(self, tag, attributes):
        if tag in _ENDS_P:
            self._end("p", ("div", "td", "th", "li", "section", "article", "body", "button"))
        if tag in _SAME:
            self._end(tag, _SAME[tag])
        e = Element(tag, {k: v or "" for k, v in reversed(attributes)}, self.at, len(self.elements))
        self.at.children.append(e)
        self.elements.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)

    def _end(self, tag, walls):
        e = self.at
        while e.parent and e.tag not in walls:
            if e.tag == tag:
                self.at = e.parent
                return
            e = e.parent

    def handle_endtag(self, tag):
        e = self.at
        while e.parent:
            if e.tag == tag:
                self.at = e.parent
                return
            e = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


class Page:
    def __init__(self, html: str):
        b = _Builder()
        b.feed(html)
        b.close()
        self.root, self.elements = b.root, b.elements
        self.body = next((e for e in b.elements if e.tag == "body"), b.root)

    def select(self, selector: str, within: Element | None = None) -> list[Element]:
        """Elements in page order."""
        chains = compiled(selector)
        pool = self.elements if within is None else [e for e in self.elements if _below(e, within)]
        return [e for e in pool if any(_matches(e, c) for c in chains)]

    def first(self, selector: str, within: Element | None = None) -> Element | None:
        found = self.select(selector, within)
        return found[0] if found else None

    def body_text(self) -> str:
        return self.body.text()


def _below(e: Element, top: Element) -> bool:
    while (e := e.parent) is not None:
        if e is top:
            return True
    return False


_PART = re.compile(r"\s*(,)\s*|(\s+)|([A-Za-z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:([*^]?=)\"?([^\]\"]*)\"?)?\]|:not\(\[([\w:-]+)([*^]?=)\"?([^\]\"]*)\"?\]\)")


@lru_cache(500)
def compiled(selector: str) -> tuple:
    """Alternatives, each a chain of tests from ancestor to element."""
    chains, chain, tests = [], [], []
    for m in _PART.finditer(selector):
        comma, blank, tag, cls, ident, a, op, v, na, nop, nv = m.groups()
        if comma or blank:
            chain.append(tuple(tests))
            tests = []
            if comma:
                chains.append(tuple(chain))
                chain = []
        elif tag:
            tests.append(("tag", tag.lower(), "", True))
        elif cls:
            tests.append(("class", cls, "", True))
        elif ident:
            tests.append(("id", ident, "", True))
        elif a:
            tests.append((op or "has", a, v, True))
        else:
            tests.append((nop, na, nv, False))
    chain.append(tuple(tests))
    chains.append(tuple(chain))
    return tuple(chains)


def _test(e: Element, kind: str, name: str, value: str) -> bool:
    if kind == "tag":
        return e.tag == name
    if kind == "class":
        return name in e.attributes.get("class", "").split()
    if kind == "id":
        return e.attributes.get("id") == name
    own = e.attributes.get(name)
    if own is None:
        return False
    return kind == "has" or (kind == "=" and own == value) or (kind == "*=" and value in own) or (kind == "^=" and own.startswith(value))


def _matches(e: Element, chain: tuple) -> bool:
    if not all(_test(e, k, n, v) == want for k, n, v, want in chain[-1]):
        return False
    rest = chain[:-1]
    while rest and (e := e.parent) is not None:
        if all(_test(e, k, n, v) == want for k, n, v, want in rest[-1]):
            rest = rest[:-1]
    return not rest


def _value(e: Element, *names: str) -> str:
    return e.text() or next((v for n in names if (v := e.get(n))), "")


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _string(x) -> str | None:
    """As it is written out; nothing for what counts as absent."""
    if x in (None, "", 0, False):
        return None
    return "true" if x is True else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def json_facts(scripts: list[str]) -> dict:
    """Price, currency, codes, brand and kind out of structured data; anything malformed is passed over."""
    out = {"json_price": None, "json_currency": None, "json_product": False, "json_brand": None, "json_codes": []}
    for data in filter(None, map(_json, scripts)):
        if not isinstance(data, dict):
            continue
        graph = [g for g in data.get("@graph") or [] if isinstance(g, dict)] if isinstance(data.get("@graph"), list) else []
        offers = data.get("offers") or next((g["offers"] for g in graph if g.get("offers")), None)
        offer = offers[0] if isinstance(offers, list) and offers else offers
        if out["json_price"] is None and isinstance(offer, dict) and (p := _string(offer.get("price"))):
            out |= {"json_price": p, "json_currency": _string(offer.get("priceCurrency")) or "USD"}
        out["json_product"] |= data.get("@type") in ("Product", "ProductGroup") or any(g.get("@type") == "Product" for g in graph)
        product = data if data.get("@type") == "Product" else next((g for g in graph if g.get("@type") == "Product"), None)
        if product:
            out["json_codes"] += [{"field": f, "value": v} for f in (*fixed.CODE_JSON, "sku", "mpn") if (v := _string(product.get(f)))]
            if out["json_brand"] is None:
                out["json_brand"] = next((n for k in ("brand", "manufacturer") if isinstance(product.get(k), dict) and (n := _string(product[k].get("name")))), None)
    return out


_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*)(;?)")


def only_closed(html: str) -> str:
    """html whose character references are those that a semicolon ends; the & of others is escaped."""
    known = lambda m: m[2] and (m[1][0] == "#" or f"{m[1]};" in html5)
    return _REFERENCE.sub(lambda m: m[0] if known(m) else f"&amp;{m[1]}{m[2]}", html)


def facts(html: str) -> dict:
    """What a product page holds, by slot; texts are as they stand, in order of the selectors and the page."""
    p = Page(html)
    one = lambda s: (e := p.first(s)) and e.get("content")
    text = lambda s: (e := p.first(s)) and e.text()
    each = lambda selectors, *names: [_value(e, *names) for s in selectors for e in p.select(s)]
    firsts = lambda selectors, *names: [_value(e, *names) for s in selectors if (e := p.first(s))]
    first = lambda selectors: [one(s) for s in selectors if one(s)]
    return json_facts([e.text() for e in p.select('script[type="application/ld+json"]')]) | {
        "og_title": one('meta[property="og:title"]'), "h1": text("h1"), "title_tag": text("title"),
        "price_meta": one('meta[property="product:price:amount"], meta[name="price"]'), "price_texts": each(fixed.PRICE_SELECTORS, "content", "data-price"),
        "description": one('meta[name="description"], meta[property="og:description"]'), "detail_texts": each(fixed.DETAIL_SELECTORS),
        "meta_codes": first(fixed.CODE_METAS), "itemprop_codes": [v.strip() for n in fixed.CODE_ITEMPROPS for e in p.select(f'[itemprop="{n}"]') if (v := e.get("content") or e.text())],
        "data_codes": [v for e in p.select(", ".join(f"[{a}]" for a in fixed.CODE_DATA)) for a in fixed.CODE_DATA if (v := e.get(a))],
        "sale_texts": firsts(fixed.SALE_SELECTORS, "content", "data-sale-price"), "original_texts": firsts(fixed.ORIGINAL_SELECTORS, "content"),
        "shipping_texts": firsts(fixed.SHIPPING_SELECTORS), "coupon_texts": firsts(fixed.COUPON_SELECTORS),
        "spec_texts": each(fixed.SPEC_SELECTORS), "area_texts": [e.text() for e in p.select(fixed.SPEC_AREAS)], "body_text": p.body_text(),
        "product_meta": bool(p.first('meta[property="og:type"][content*="product"], meta[property="product:price:amount"]')),
        "price_itemprop": bool(p.first('[itemprop="price"]')), "price_data": bool(p.first("[data-price]")),
    }


_S, _B, _L = T.StringType(), T.BooleanType(), T.ArrayType(T.StringType())
FACTS = T.StructType([
    *(T.StructField(n, _S) for n in ("json_price", "json_currency", "json_brand", "og_title", "h1", "title_tag", "price_meta", "description", "body_text")),
    *(T.StructField(n, _B) for n in ("json_product", "product_meta", "price_itemprop", "price_data")),
    *(T.StructField(n, _L) for n in ("price_texts", "detail_texts", "meta_codes", "itemprop_codes", "data_codes", "sale_texts", "original_texts", "shipping_texts", "coupon_texts", "spec_texts", "area_texts")),
    T.StructField("json_codes", T.ArrayType(T.StructType([T.StructField("field", _S), T.StructField("value", _S)]))),
])


def mapped(df: DataFrame, one_to_many, fields: T.StructType, html: str = "html", also: str | None = None, errors: str | None = None) -> DataFrame:
    """df without its html, with a row for each dict that the function makes of a page.

    A page that fails makes none; or, if errors names a column for what went wrong, one row with nulls.
    """
    kept = [f for f in df.schema.fields if f.name != html]
    if errors:
        fields = T.StructType([*fields.fields, T.StructField(errors, T.StringType())])
    schema = T.StructType([*kept, *fields.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 200):  # facts are larger than pages
                part = b.slice(a, 200)
                more = part.column(also).to_pylist() if also else [None] * part.num_rows
                rows, at = [], []
                for i, (page, x) in enumerate(zip(part.column(html).to_pylist(), more, strict=True)):
                    try:
                        found = one_to_many(page or "", x) if also else one_to_many(page or "")
                    except (ValueError, RecursionError, AssertionError) as e:
                        found = [{errors: f"{type(e).__name__}: {e}"[:500]}] if errors else []
                    rows += found
                    at += [i] * len(found)
                if rows:
                    new = pa.RecordBatch.from_pylist(rows, arrow)
                    left = [part.column(f.name).take(pa.array(at)) for f in kept]
                    yield pa.RecordBatch.from_arrays([*left, *new.columns], names=schema.names)

    return df.mapInArrow(run, schema)


def page_facts(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with their facts instead of html."""
    return mapped(pages, lambda h: [facts(h)], FACTS)


def result_links(html: str, engine: str, rules: dict = fixed.ENGINE_LINKS) -> list[dict]:
    """Links of a result page in order: by the engine's selectors, else, where it has one, by its fallback."""
    how, p = rules[engine], Page(html)
    out: list[str] = []
    for s in how["selectors"]:
        for e in p.select(s):
            href = (e.get("data-url") or e.get("href")) if engine == "Brave" else e.get("href")
            if href and (href.startswith("http") or engine in ("Google", "Yahoo")) and not any(o in href for o in how["own"] if not href.startswith("/url?")):
                out.append(href)
        if len(out) > how.get("enough", float("inf")):
            break
    if not out and "fallback" in how:
        out = [h for e in p.select('a[href^="http"]') if (h := e.get("href")) and not any(o in h for o in how["fallback"])]
    return [{"ordinal": i, "href": h} for i, h in enumerate(out)]


LINKS = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("href", _S)])


def listing_cards(html: str, url: str | None = None) -> list[dict]:
    """Product cards of a listing page, by the first selector that finds any."""
    p = Page(html)
    cards = next((c for s in fixed.CARD_SELECTORS if (c := p.select(s))), None) or p.select(fixed.CARD_FALLBACK)
    out = []
    for i, c in enumerate(cards):
        text = lambda s, c=c: e.text().strip() if (e := p.first(s, c)) else ""
        link = p.first(fixed.CARD_LINK, c)
        href = link.get("href") if link else None
        out.append({"ordinal": i, "title": text(fixed.CARD_TITLE), "price_text": text(fixed.CARD_PRICE), "link": urljoin(url or "", href) if href else "", "classes": c.get("class") or ""})
    return out


CARDS = T.StructType([T.StructField("ordinal", T.LongType()), *(T.StructField(n, _S) for n in ("title", "price_text", "link", "classes"))])


def next_pages(html: str, url: str | None = None) -> list[dict]:
    """At most five further pages of a listing."""
    p = Page(html)
    found = dict.fromkeys(urljoin(url or "", h) for e in p.select(fixed.CARD_PAGES) if (h := e.get("href")))
    return [{"ordinal": i, "href": h} for i, h in enumerate([h for h in found if h != url][:5])]

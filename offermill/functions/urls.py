"""Hosts, countries, exclusions and priorities of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numbers import found


def host(url: Column) -> Column:
    """Lower case, without port; null if the URL is not one."""
    return F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def domain(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(host(url), "^www\\.", ""), F.lit("unknown"))


def country(url: Column) -> Column:
    """The first country, in order, one of whose suffixes ends the host; .com is US; else null."""
    h = host(url)
    out = F
    for code, (_, _, suffixes, _) in fixed.COUNTRIES.items():
        test = F.lit(False)
        for s in suffixes:
            test = test | h.endswith(s)
        out = out.when(test, code)
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def within(url: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    h = host(url)
    return _any([(h == d) | h.endswith("." + d) for d in domains])


def within_domain(url: Column, domains: list[str]) -> Column:
    """As within, on the domain without www."""
    d = domain(url)
    return _any([(d == x) | d.endswith("." + x) for x in domains])


def excluded(category: str) -> list[str]:
    return fixed.EXCLUDED + fixed.EXCLUDED_BY_CATEGORY[category]


def is_excluded(url: Column, category: str) -> Column:
    """The domain contains an excluded one, even as a part of a word: screwfix.com contains x.com."""
    return _any([domain(url).contains(d) for d in excluded(category)])


def is_blog(url: Column) -> Column:
    """Patterns are tried on the whole URL, so //costco.com is one too."""
    return F.coalesce(url.rlike("(?i)" + "|".join(fixed.BLOG_PATHS)), F.lit(False))


def needs_browser(url: Column) -> Column:
    return within(url, fixed.BROWSER_DOMAINS)


def looks_like_shop(url: Column, more: str = "") -> Column:
    return url.rlike("(?i)" + "|".join([*fixed.SHOP_URL, *([more] if more else [])]))


def tier(url: Column, vendors: list[str], deal_sites: list[str], renderer: bool = False, more: str = "") -> Column:
    """1 vendor, 2 deal site, 3 looks like a shop, 4 other, 5 needs a browser that isn't there. A vendor's name may end a longer one."""
    d = domain(url)
    ends = lambda names: _any([d.endswith(v) for v in names])
    return F.when(F.lit(not renderer) & needs_browser(url), 5).when(ends(vendors), 1).when(ends(deal_sites), 2).when(F.coalesce(looks_like_shop(url, more), F.lit(False)), 3).otherwise(4)


def decoded(text: Column) -> Column:
    """Percent escapes; a plus sign stays; null if an escape is broken."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def unwrapped(url: Column, engine: str) -> Column:
    """The target of a result page's redirecting link; null if it has none or its escapes are broken."""
    if engine == "Google":
        return F.when(url.startswith("/url?"), decoded(found(url, "[?&]q=([^&]+)"))).otherwise(url)
    if engine == "GoogleShopping":
        inner = found(url, "[?&](?:url|q)=([^&]+)")
        return F.when(inner.isNotNull(), decoded(inner)).otherwise(url)
    if engine == "Yahoo":
        return decoded(found(url, "RU=([^/]+)"))
    return url


def encoded(text: Column) -> Column:
    """Percent escapes of all but letters, digits and - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for escape, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(escape), F.lit(sign))
    return out


def blocked(html: Column) -> Column:
    """At least two signals of a page that stands in for another; one may contain another."""
    t = F.lower(html)
    return F.coalesce(sum((t.contains(s).cast("int") for s in fixed.BLOCK_SIGNALS), F.lit(0)) >= 2, F.lit(False))

"""Which queries to ask, and which URLs to fetch first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, urls
from . import domains
from .ranking import first_of


#: What makes a url look like a panel shop's, besides what any shop's has.
SOLAR_SHOPS = "solar|panel|watt"


def _sites(names: list[str]) -> str:
    return "(" + " OR ".join(f"site:{n}" for n in names) + ")"


def category_templates(category: str, countries: list[str] = ("US",)) -> list[str]:
    """Query templates in order; {} is the product."""
    vendors = fixed.VENDORS[category]
    out = [f"{{}} {_sites(vendors[i : i + 2])}" for i in (0, 2, 4, 6)]
    out += [f"{{}} {w}" for w in fixed.SHOPPING_WORDS[category]]
    out.append(f"{{}} {_sites(fixed.DEAL_SITES[category][:3])}")
    out += [f"{{}} {_sites(part)}" for part in (vendors[8:11], vendors[11:14]) if part]
    out += [f"{{}} buy site:*{fixed.COUNTRIES[c][2][0]}" for c in [c for c in countries if c != "US"][:6] if c in fixed.COUNTRIES]
    if fixed.COMPARE_SITES[category]:
        out.append(f"{{}} {_sites(fixed.COMPARE_SITES[category])}")
    out += [f"{{}} {w}" for w in fixed.COMPARE_WORDS[category]]
    out.append('"alternative to" "{}" buy')
    regional = [v for v in vendors if re.search(r"\.(co\.\w{2}|com\.\w{2}|\w{2}\.\w{2})$", v, re.ASCII) and not v.endswith(".com")]
    if regional:
        out.append(f"{{}} {_sites(regional[:4])}")
    return [*out, '"{}" buy', '"{}" price']


def solar_queries(country: str) -> list[str]:
    _, _, suffixes, word = fixed.COUNTRIES[country]
    out = [f'"solar panel" {_sites(fixed.SOLAR_VENDORS[i : i + 2])}' for i in (0, 2, 4, 6)] + fixed.SOLAR_SHOPPING + fixed.SOLAR_WATTS
    if country != "US":
        out += [f"solar panel buy site:*{suffixes[0]} -blog -review", f'solar panel shop {word} "add to cart"']
    return [*out, *fixed.SOLAR_PAGES, *fixed.SOLAR_DEALS, f"solar panel price {_sites(fixed.SOLAR_DEAL_SITES[:3])}", *fixed.SOLAR_BRAND_QUERIES]


def expand(products: DataFrame, templates: list[str], column: str = "product") -> DataFrame:
    """products × templates: query and its ordinal; nothing moves between tasks."""
    rows = F.posexplode(F.array(*(F.lit(t) for t in templates))).alias("ordinal", "_template")
    return products.select("*", rows).withColumn("query", F.replace("_template", F.lit("{}"), F.trim(column))).drop("_template")


def plain_queries(products: DataFrame, column: str = "product") -> DataFrame:
    return expand(products, fixed.PLAIN_TEMPLATES, column)


def without_quantity(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, "(?i)" + fixed.QUERY_QUANTITY + "(?![A-Za-z0-9_])", ""))


def query_key(query: Column) -> Column:
    """Words of more than two characters in order; queries with equal keys ask the same."""
    words = F.split(F.regexp_replace(F.lower(query), r"[^a-z0-9_\s]", ""), r"\s+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: F.length(w) > 2)), " ")


def distinct_queries(queries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return first_of(queries, [*(keys or []), query_key(F.col("query"))], F.asc("ordinal"))


def plan_queries(spark: SparkSession, query: str, category: str = "supplements", countries: list[str] = ("US",), depth: str = "normal") -> DataFrame:
    """The distinct queries for a search, as many as its depth allows."""
    asked = spark.createDataFrame([(query,)], "asked string").select(without_quantity(F.col("asked")).alias("product"))
    return distinct_queries(expand(asked, category_templates(category, countries))).orderBy("ordinal").limit(fixed.DEPTHS[depth][1])


def country_queries(countries: DataFrame, column: str = "country") -> DataFrame:
    """countries × their queries."""
    table = F.create_map(*(x for c in fixed.COUNTRIES for x in (F.lit(c), F.array(*(F.lit(q) for q in solar_queries(c))))))
    return countries.select("*", F.posexplode(F.try_element_at(table, F.col(column))).alias("ordinal", "query"))


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, t, c, i) for i, (n, (t, c)) in enumerate(fixed.ENGINES.items())], "engine string, tier int, cooldown_ms long, engine_ordinal int")


def query_engines(queries: DataFrame, countries: list[str] = ("US",), limited: list[str] = (), used: list[str] = (), most_tier: int = 3) -> DataFrame:
    """queries (ordinal from 0) × the engines that they go to. The engines are a literal of a dozen rows."""
    table = F.array(*(F.struct(F.lit(n).alias("engine"), F.lit(t).alias("tier"), F.lit(i).alias("engine_ordinal")) for i, (n, (t, _)) in enumerate(fixed.ENGINES.items()) if n not in limited and t <= most_tier))
    europe = any(c in fixed.EU_COUNTRIES for c in countries)
    out = queries.select("*", F.inline(table))
    early = (F.col("tier") == 1) | (F.lit(europe) & F.col("engine").isin(fixed.EU_ENGINES))
    late = (F.col("tier") < 3) | ~F.col("engine").isin(list(used) or [""])
    return out.filter(F.when(F.col("ordinal") < 2, early).when(F.col("ordinal") < 4, F.col("tier") <= 2).otherwise(late))


def first_seen(found: DataFrame) -> DataFrame:
    """The first of each URL (url, ordinal)."""
    return first_of(found, ["url"], F.asc("ordinal"))


def first_per_source(links: DataFrame, keys: list[str], n: int = fixed.LINKS_KEPT) -> DataFrame:
    return links.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))).filter(F.col("_nth") <= n).drop("_nth")


def _labelled(found: DataFrame, category: str | None) -> DataFrame:
    """found with the labels of its urls' domains, by the lists of a category, or of panels."""
    return found.withColumn("_labels", domains.labels(urls.domain(F.col("url")), domains.rows_of(domains.lists_of(category))))


def fetchable(found: DataFrame, category: str) -> DataFrame:
    return _labelled(found, category).filter(~domains.on("excluded")).drop("_labels")


def solar_fetchable(found: DataFrame) -> DataFrame:
    return _labelled(first_seen(found), None).filter(~domains.on("excluded") & ~urls.is_blog(F.col("url"))).drop("_labels")


def prioritised(found: DataFrame, category: str, renderer: bool = False) -> DataFrame:
    return _labelled(found, category).withColumn("tier", domains.tier(F.col("url"), renderer)).drop("_labels")


def solar_prioritised(found: DataFrame, renderer: bool = False) -> DataFrame:
    return _labelled(found, None).withColumn("tier", domains.tier(F.col("url"), renderer, SOLAR_SHOPS)).drop("_labels")


def both_tiers(found: DataFrame, category: str, renderer: bool = False) -> DataFrame:
    """tier for a category and solar_tier for panels, in one pass over the domains."""
    rows = domains.rows_of(domains.lists_of(category)) + domains.rows_of(domains.lists_of(None), "solar ")
    df = found.withColumn("_labels", domains.labels(urls.domain(F.col("url")), rows))
    return df.withColumns({"tier": domains.tier(F.col("url"), renderer), "solar_tier": domains.tier(F.col("url"), renderer, SOLAR_SHOPS, "solar ")}).drop("_labels")


def to_fetch(found: DataFrame, category: str, depth: str = "normal", renderer: bool = False) -> DataFrame:
    """First seen, not excluded, best tiers first, as many as the depth allows."""
    df = _labelled(first_seen(found), category).filter(~domains.on("excluded")).withColumn("tier", domains.tier(F.col("url"), renderer)).drop("_labels")
    return df.orderBy("tier", "ordinal").limit(fixed.DEPTHS[depth][0])


def guarded(found: DataFrame) -> DataFrame:
    """found with protected: whether the host is one whose pages are guarded; false for what is no url."""
    return _labelled(found, None).withColumn("protected", domains.on("protected")).drop("_labels")


def routed(found: DataFrame) -> DataFrame:
    """render for pages of hosts that need a browser, else fetch."""
    df = _labelled(found, None)
    return df.withColumn("route", F.when(domains.on("browser"), "render").otherwise("fetch")).drop("_labels")


def uncached(found: DataFrame, cache: DataFrame) -> DataFrame:
    return found.join(cache.select("url"), "url", "left_anti")


def request(query: str, category: str | None = None, countries: list[str] | None = None, depth: str | None = None) -> dict:
    """A search request with defaults in place of what isn't known; ValueError if the query is too short or long."""
    if not isinstance(query, str) or not 2 <= len(query.strip()) <= 200:
        raise ValueError("a query has 2 to 200 characters")
    known = [c for c in countries or [] if c in fixed.COUNTRIES] if isinstance(countries, list) else []
    return {"query": query.strip(), "category": category if category in fixed.CATEGORIES else "supplements", "countries": known or ["US"], "depth": depth if depth in fixed.DEPTHS else "normal"}


def _once(pages: DataFrame) -> DataFrame:
    """One page a url: of several, the smallest text, so that the choice doesn't depend on their order."""
    return pages.groupBy("url").agg(F.min("html").alias("html"))


def read_through(wanted: DataFrame, held: DataFrame, fetched: DataFrame) -> DataFrame:
    """url, html and source of wanted pages, one a url: from the cache, and those that it lacks as they were fetched or rendered."""
    asked = wanted.select("url").distinct()
    hits = asked.join(_once(held), "url").withColumn("source", F.lit("cache"))
    misses = asked.join(held.select("url"), "url", "left_anti").join(_once(fetched), "url").withColumn("source", F.lit("fetch"))
    return hits.unionByName(misses)


def one_of_both(fetched: DataFrame, rendered: DataFrame) -> DataFrame:
    """Pages (url, html) read both ways, one a url: the rendered one where there is one, else the fetched one."""
    both = _once(rendered).withColumn("source", F.lit("render")).unionByName(_once(fetched).withColumn("source", F.lit("fetch")))
    return both.groupBy("url").agg(F.max_by("html", "source").alias("html"), F.max("source").alias("source"))

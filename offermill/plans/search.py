"""The engine's questions end to end: which offer is the best value, and which panels cost least per watt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import extract, frontier, leaderboard, ranking
from ..sources.documents import envelope


def candidate_urls(queries: DataFrame, results: DataFrame, countries: list[str] = ("US",), limited: list[str] = (), most_tier: int = 3) -> DataFrame:
    """url and ordinal out of stored result pages (engine, query, html), for the engines that each query goes to."""
    asked = frontier.query_engines(queries, countries, limited, most_tier=most_tier).select("query", "engine", F.col("ordinal").alias("query_ordinal"), "engine_ordinal")
    found = extract.links(results.join(asked, ["engine", "query"]))
    return found.select("url", F.struct("query_ordinal", "engine_ordinal", "ordinal").alias("ordinal"))


def readable(pages: DataFrame) -> DataFrame:
    return pages.filter(~urls.blocked(F.col("html")))


def pages_of(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """The stored pages (url, html) of wanted URLs (url, tier, ordinal), in order of tier and ordinal as ordinal."""
    return readable(pages.select("url", "html").join(wanted.select("url", F.struct("tier", "ordinal").alias("ordinal")), "url"))


def search(spark: SparkSession, results: DataFrame, pages: DataFrame, query: str, category: str | None = None, countries: list[str] | None = None, depth: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked offers for a query, and the answer in one row. results: engine, query, html; pages: url, html."""
    ask = frontier.request(query, category, countries, depth)
    queries = frontier.plan_queries(spark, ask["query"], ask["category"], ask["countries"], ask["depth"])
    found = candidate_urls(queries, results, ask["countries"])
    wanted = frontier.to_fetch(found, ask["category"], ask["depth"])
    # at most as many pages as the depth allows: read once, kept for the joins of ranking
    records = extract.product_records(pages_of(wanted, pages)).cache()
    ranked = ranking.rank_offers(records).cache()
    return ranked, envelope(ranked, ranking.best_deal(ranked), ask)


def solar_records(results: DataFrame, pages: DataFrame, countries: DataFrame, most_pages: int = 3000) -> tuple[DataFrame, DataFrame]:
    """Stored pages found for the countries (country) by engines of the first two tiers, and the panels on them."""
    queries = frontier.country_queries(countries).select("query", "ordinal").distinct()
    found = candidate_urls(queries, results, most_tier=2)
    wanted = frontier.solar_prioritised(frontier.solar_fetchable(found)).orderBy("tier", "ordinal").limit(most_pages)
    found = pages_of(wanted, pages)
    return found, extract.panel_records(found)


def solar_board(results: DataFrame, pages: DataFrame, countries: DataFrame, most_pages: int = 3000, top: int = 1000) -> DataFrame:
    """The cheapest panels per watt."""
    return leaderboard.top_panels(solar_records(results, pages, countries, most_pages)[1], top)


def crawl_counters(fetched: DataFrame, extracted: DataFrame, kept: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(fetched, "totalCrawled").join(one(extracted, "totalExtracted")).join(one(kept, "totalAfterFiltering"))

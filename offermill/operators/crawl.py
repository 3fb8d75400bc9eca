"""Listing pages to a fixed point: pages name further pages, until none is new.

The links of all stored pages are read once and kept. Then each round takes the pages that are new (the delta), finds the
links on them, and keeps the targets that no round has seen; the rounds are as many as the longest shortest way from a
seed. A round joins only its delta: stored tables of known size, so a small one is broadcast by Spark's own measure and
neither links nor seen pages move for it; a large one is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.html import LINKS, mapped, next_pages
from .extract import cards
from .ranking import first_of
from .storage import kept, shared_folder


def page_links(pages: DataFrame) -> DataFrame:
    """url, ordinal and href: at most five further pages of each stored listing page (url, html)."""
    df = mapped(pages.select("url", "html").withColumn("page_url", F.col("url")), next_pages, LINKS, also="page_url")
    return df.select("url", "ordinal", "href")


def reached(links: DataFrame, seeds: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """url, depth and via of all that seeds (url) lead to by links (url, href), the seeds included, each once.

    depth is the least number of links on the way, via the smallest url of that depth less one that has the link. Null
    urls lead nowhere; cycles and repeated links change nothing.
    """
    spark = links.sparkSession
    links = kept(links.select("url", "href").filter("url IS NOT NULL AND href IS NOT NULL AND url <> href").distinct(), "links")
    folder = shared_folder(spark, "reached")
    delta = kept(seeds.select("url").filter("url IS NOT NULL").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")), "reached", f"{folder}/round=0")
    seen = lambda: spark.read.schema(delta.schema).parquet(*(f"{folder}/round={r}" for r in range(done + 1)))
    done = 0
    while (most_rounds is None or done < most_rounds) and not delta.isEmpty():
        found = links.join(delta.select("url"), "url").groupBy("href").agg(F.min("url").alias("via")).select(F.col("href").alias("url"), F.lit(done + 1).alias("depth"), "via")
        found = kept(found, "found")
        # seen pages are met by what is found, not the other way round: they stay where they are if that is little
        known = seen().join(found.select("url"), "url", "left_semi").select("url")
        delta = kept(found.join(known, "url", "left_anti"), "reached", f"{folder}/round={done + 1}")
        done += 1
    return seen()


def listing_products(pages: DataFrame, seeds: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Cards of all stored listing pages (url, html) that the seeds lead to, with the depth of their page; a page that is stored twice counts once."""
    once = first_of(pages.select("url", "html"), ["url"], F.asc("html"))
    way = reached(page_links(once), seeds, most_rounds)
    found = cards(once.join(way.select("url", "depth"), "url"))
    # a product on several pages belongs to the first of them
    return first_of(found, ["url"], F.asc("depth"), F.asc("page_url"), F.asc("ordinal"))

"""python -m offermill RESULTS PAGES OUT [--countries US,DE] [--max-pages N]: a leaderboard of panels out of stored pages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.fixed import COUNTRIES
from .operators.leaderboard import metadata, top_panels
from .plans.search import crawl_counters, solar_records
from .sources.documents import document, write_document


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="offermill")
    p.add_argument("results")
    p.add_argument("pages")
    p.add_argument("out")
    p.add_argument("--countries", default=",".join(COUNTRIES))
    p.add_argument("--max-pages", default="3000")
    a = p.parse_args(args)
    known = [c.strip().upper() for c in a.countries.split(",") if c.strip().upper() in COUNTRIES]
    a.countries = known or list(COUNTRIES)
    a.max_pages = int(a.max_pages) if a.max_pages.isdigit() and int(a.max_pages) > 0 else 3000
    return a


def main() -> None:
    a = arguments()
    spark = SparkSession.builder.appName("offermill").getOrCreate()
    countries = spark.createDataFrame([(c,) for c in a.countries], "country string")
    pages, records = solar_records(spark.read.parquet(a.results), spark.read.parquet(a.pages), countries, a.max_pages)
    records = records.cache()
    board = top_panels(records).cache()
    n = crawl_counters(pages, records, board).first()
    write_document(document(board.drop("ordinal"), metadata(board, n.totalCrawled, n.totalExtracted), "pricePerWattUsd", "url"), a.out)
    for r in board.limit(10).collect():
        print(f"{r.pricePerWattUsd:.3f} $/W  {r.title}  {r.vendor}")


if __name__ == "__main__":
    main()

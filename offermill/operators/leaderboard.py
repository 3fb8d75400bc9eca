"""Leaderboards of price per watt: filtering, duplicates, building from batches, stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..functions.numbers import half_up, lookup
from ..functions.urls import encoded
from .ranking import first_of


def priced_per_watt(df: DataFrame) -> DataFrame:
    """df (price, currency, wattage) with priceUsd and both prices per watt, 3 digits."""
    usd = scores.usd(F.col("price"), F.col("currency"))
    return df.withColumns({"priceUsd": usd, "pricePerWatt": half_up(F.col("price") / F.col("wattage"), 3), "pricePerWattUsd": half_up(usd / F.col("wattage"), 3)})


def filtered(df: DataFrame) -> DataFrame:
    """Plausible and sure enough panels, the first of each URL, and of these the first of each vendor and 5-cent step."""
    df = df.filter(F.col("pricePerWattUsd").between(0.10, 3.0) & (F.col("confidence") >= 0.4))
    df = first_of(df, ["url"], F.asc("ordinal"))
    return first_of(df, ["vendor", half_up(F.col("pricePerWattUsd") * 20)], F.asc("ordinal"))


def top_panels(df: DataFrame, top: int = 1000) -> DataFrame:
    return filtered(df).orderBy("pricePerWattUsd", "ordinal").limit(top)


def listing_panels(cards: DataFrame) -> DataFrame:
    """Panels out of listing cards: single ones of plausible watts and price."""
    df = priced_per_watt(cards.filter(F.col("wattage").between(5, 1000) & (F.col("price") > 0)))
    raw = F.col("priceUsd") / F.col("wattage")
    return df.filter(raw.between(0.05, 5.0) & ~F.col("title").rlike("(?i)pallet|bundle|pack of|set of")).withColumn("confidence", F.lit(0.7))


def build(products: DataFrame, parts: int | None = None, ordered: bool = True) -> DataFrame:
    """A leaderboard of merged batches: rates of more currencies, filters and, unless it is only counted, order by the price per watt as paid.

    In parts, if given, it takes as many tasks, so that none grows with the batches; all rows of a key then meet in one
    task. Else Spark's number of shuffle partitions holds, and of each task only the first rows of a key move.
    """
    df = products.filter(F.col("wattage").between(10, 1000) & (F.col("price") > 0))
    code = F.upper(F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")))
    usd = half_up(F.col("price") * F.coalesce(lookup(fixed.BUILDER_RATES, code), F.lit(1.0)), 2)
    df = df.withColumns({"currency": code, "priceUsd": usd, "pricePerWatt": half_up(F.col("price") / F.col("wattage"), 3)}).withColumn("pricePerWattUsd", half_up(F.col("priceUsd") / F.col("wattage"), 3))
    df = df.filter(F.col("pricePerWatt").between(0.10, 3.0)).withColumns({"panelType": F.coalesce("panelType", F.lit("unknown")), "country": F.coalesce("country", F.lit("US")), "confidence": F.lit(0.85)})
    real = F.col("url").startswith("http") & ~F.col("url").contains(encoded(F.substring(F.coalesce("title", F.lit("")), 1, 20)))
    key = F.when(F.coalesce(real, F.lit(False)), F.col("url")).otherwise(F.concat_ws("|", F.col("vendor"), F.col("title"), F.col("wattage").cast("string")))
    df = df.withColumn("_key", key)
    df = first_of(df if parts is None else df.repartition(parts, "_key"), ["_key"], F.asc("ordinal")).drop("_key")
    if not ordered:
        return df
    order = ("pricePerWatt", "ordinal")
    return df.orderBy(*order) if parts is None else df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def build_rows(built: DataFrame) -> DataFrame:
    """Rows of a built leaderboard as its document has them: specs and shipping nested, with nulls for what batches don't tell."""
    none = lambda kind: F.lit(None).cast(kind)
    size = "struct<lengthMm:double,widthMm:double,depthMm:double>"
    unknown = [none(t).alias(n) for n, t in (("efficiency", "double"), ("dimensions", size), ("weightKg", "double"), ("warranty", "string"), ("cellCount", "long"), ("brand", "string"), ("model", "string"))]
    specs = F.struct("wattage", "panelType", *unknown)
    shipping = F.struct(none("double").alias("cost"), F.lit(False).alias("isFree"))
    return built.select("ordinal", "title", "price", "currency", "priceUsd", "pricePerWatt", "pricePerWattUsd", specs.alias("specs"), "vendor", "url", "country", shipping.alias("shipping"), "confidence", F.current_timestamp().alias("lastCrawled"))


def timed(counters: DataFrame, started: Column, completed: Column) -> DataFrame:
    """Counters with when a crawl began and ended, and for how long it ran in milliseconds."""
    return counters.select("*", started.alias("crawlStarted"), completed.alias("crawlCompleted"), (F.unix_millis(completed) - F.unix_millis(started)).alias("crawlDurationMs"))


def metadata(results: DataFrame, crawled: int, extracted: int | None = None, version: int = 3) -> DataFrame:
    """One row of counters: pages read, panels found on them, and results; where pages aren't known, as many as panels."""
    return results.agg(
        F.lit(crawled).alias("totalCrawled"), F.lit(crawled if extracted is None else extracted).alias("totalExtracted"), F.count(F.lit(1)).alias("totalAfterFiltering"),
        F.sort_array(F.collect_set("country")).alias("countriesCrawled"), F.sort_array(F.collect_set("vendor")).alias("vendorsCrawled"), F.lit(version).alias("version"),
    )


def latest_stock(statuses: DataFrame) -> DataFrame:
    """The last known status of each URL (url, status, ordinal)."""
    known = statuses.filter((F.col("status") != "unknown") & (F.col("status") != ""))
    return known.groupBy("url").agg(F.max_by("status", "ordinal").alias("status"))


def with_stock(results: DataFrame, statuses: DataFrame) -> DataFrame:
    """results with stockStatus. Stock tables grow with the corpus, so Spark chooses the join by their size."""
    state = F.when(F.col("status").isin("in-stock", "in_stock"), "in-stock").when(F.col("status").isin("out-of-stock", "out_of_stock"), "out-of-stock").otherwise("unknown")
    return results.join(latest_stock(statuses), "url", "left").withColumn("stockStatus", state).drop("status")


def stock_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("stockStatus").agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame, countries: list[str] | None = None, least_watts: float | None = None, most_watts: float | None = None, panel_type: str | None = None, stock: str | None = None, exact_type: bool = False) -> DataFrame:
    """Rows that all given facets hold for. Watts and type are looked for in specs, where records have them; countries and,
    unless it must be exact, type in any case."""
    nested = "specs" in df.columns
    watts = F.coalesce(F.col("specs.wattage" if nested else "wattage"), F.lit(0))
    kind = F.col("specs.panelType" if nested else "panelType")
    if countries:
        df = df.filter(F.upper("country").isin([c.strip().upper() for c in countries]))
    if least_watts is not None:
        df = df.filter(watts >= least_watts)
    if most_watts is not None:
        df = df.filter(watts <= most_watts)
    if panel_type:
        df = df.filter(kind == panel_type if exact_type else F.lower(kind) == panel_type.lower())
    if stock:
        df = df.filter(F.coalesce("stockStatus", F.lit("unknown")) == stock)
    return df


SORTS = {"pricePerWatt": "pricePerWatt", "price": "price", "wattage": "wattage", "efficiency": "efficiency"}


def sorted_by(df: DataFrame, by: str = "pricePerWatt", display: bool = False) -> DataFrame:
    """Ascending, unknown last; for display, by dollars, and watts and efficiency descending."""
    at = lambda c: F.col(f"specs.{c}") if "specs" in df.columns and c in ("wattage", "efficiency") else F.col(c)
    if display:
        order = {"pricePerWatt": F.asc("pricePerWattUsd"), "price": F.asc("priceUsd"), "wattage": F.desc(F.coalesce(at("wattage"), F.lit(0))), "efficiency": F.desc(F.coalesce(at("efficiency"), F.lit(0)))}[by]
    else:
        order = at(SORTS.get(by, "pricePerWatt")).asc_nulls_last()
    return df.orderBy(order, "ordinal")


def page(df: DataFrame, limit: int | None = 50, offset: int | None = 0) -> DataFrame:
    """Rows of one page of a sorted frame: 1 to 200 of them, 50 unless given."""
    return df.offset(max(0, offset or 0)).limit(min(max(1, limit or 50), 200))


def page_info(df: DataFrame, limit: int | None = 50, offset: int | None = 0) -> DataFrame:
    size, start = min(max(1, limit or 50), 200), max(0, offset or 0)
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(size).alias("limit"), F.lit(start).alias("offset"), (F.lit(start + size) < F.col("total")).alias("hasMore"), F.ceil(F.col("total") / size).alias("pages"))


def display_rank(df: DataFrame, *order: Column, start: int = 0) -> DataFrame:
    """rank within a page that starts somewhere, and whether it is one of the first ten."""
    rank = F.row_number().over(Window.orderBy(*order)) + start
    return df.withColumn("rank", rank).withColumn("top10", F.col("rank") <= 10)

"""From extracted records to ranked offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numbers import half_up
from .storage import kept

UNIVERSAL = ("upc-a", "ean-13", "gtin-14")


def field(df: DataFrame, name: str, kind: str) -> Column:
    """A column that a record may lack."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def cross_vendor(df: DataFrame, upc: str = "primaryUpc") -> DataFrame:
    """df with matches: how many other records have the same code, complete or not; 0 without a code.

    Counts are added up before they move, and joined back, so a code that very many records share needs no sort of them.
    """
    counts = df.filter(F.col(upc).isNotNull()).groupBy(F.col(upc).alias("_upc")).agg((F.count(F.lit(1)) - 1).alias("_others")).filter("_others > 0")
    return df.join(counts, F.col(upc) == F.col("_upc"), "left").withColumn("matches", F.coalesce("_others", F.lit(0))).drop("_upc", "_others")


def has_valid_code(identifiers: Column) -> Column:
    return F.coalesce(F.exists(identifiers, lambda i: i["type"].isin(*UNIVERSAL) & i["isValidCheckDigit"]), F.lit(False))


def distinct_sources(identifiers: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(F.transform(identifiers, lambda i: i["source"]))), F.lit(0))


def first_code(identifiers: Column) -> Column:
    return F.get(F.filter(identifiers, lambda i: i["type"].isin(*UNIVERSAL) & i["isValidCheckDigit"]), F.lit(0))["value"]


def first_sku(identifiers: Column) -> Column:
    return F.get(F.filter(identifiers, lambda i: i["type"] == "sku"), F.lit(0))["value"]


def distinct_identifiers(identifiers: Column) -> Column:
    """The first of each type and value, in order."""
    seen = lambda acc, i: F.exists(acc, lambda t: (t["type"] == i["type"]) & (t["value"] == i["value"]))
    empty = F.filter(identifiers, lambda i: F.lit(False))
    return F.aggregate(identifiers, empty, lambda acc, i: F.when(seen(acc, i), acc).otherwise(F.concat(acc, F.array(i))))


def verified(df: DataFrame, upc: str = "primaryUpc") -> DataFrame:
    """df with matches, valid_upc and verification_score; from identifiers, or valid_upc where a relation has it already."""
    df = cross_vendor(df, upc)
    if "identifiers" in df.columns:
        df = df.withColumns({"valid_upc": has_valid_code(F.col("identifiers")), "_sources": distinct_sources(F.col("identifiers"))})
    else:
        df = df.withColumn("_sources", F.lit(0))
    return df.withColumn("verification_score", scores.verification(F.col("valid_upc"), F.col("_sources"), F.col("matches"))).drop("_sources")


def priced(df: DataFrame) -> DataFrame:
    """Complete records with price_per_unit, price_per_unit_usd (4 digits) and confidence (2 digits), if it is at least one half unrounded."""
    df = df.dropna(subset=["price", "quantity", "unit"])
    unit = scores.per_unit(F.col("price"), F.col("quantity"), F.col("unit"))
    df = df.withColumns({"_ppu": unit, "_conf": scores.confidence_with_upc(F.col("price"), F.col("quantity"), F.col("unit"), F.col("title"), F.col("valid_upc"), F.col("matches"))})
    df = df.filter((F.col("_conf") >= 0.5) & F.col("_ppu").isNotNull())
    return df.withColumns({
        "price_per_unit": half_up(F.col("_ppu"), 4), "price_per_unit_usd": half_up(scores.usd(F.col("_ppu"), F.col("currency")), 4), "confidence": half_up(F.col("_conf"), 2),
        "unit_basis": F.when(scores.grams(F.col("quantity"), F.col("unit")) > 0, "g").otherwise(F.col("unit")),
    }).drop("_ppu", "_conf")


def scored(df: DataFrame, on: str = "price_per_unit") -> DataFrame:
    """df with deal_score (3 digits). The mean of all is one row that is broadcast; records are stored first, as they are read for it and again for their scores."""
    shipping = F.col("shipping")["cost"] if "shipping" in df.columns else field(df, "shipping_cost", "double")
    free = F.col("shipping")["isFree"] if "shipping" in df.columns else field(df, "free_shipping", "boolean")
    coupon = F.col("promotion")["hasCoupon"] if "promotion" in df.columns else field(df, "coupon", "boolean")
    df = kept(df.withColumn("_eff", scores.effective(F.col(on), shipping, F.col("quantity"))), "priced")
    mean = F.broadcast(df.agg(F.avg("_eff").alias("_mean")))
    score = scores.deal(F.col("_eff"), F.col("_mean"), F.col("confidence"), F.col("valid_upc"), F.col("matches"), free, field(df, "discount_percent", "long"), coupon)
    return df.join(mean).withColumn("deal_score", half_up(score, 3)).drop("_eff", "_mean")


def first_of(df: DataFrame, keys: list, *order: Column) -> DataFrame:
    """The first row of each key in an order. Of each task only its first rows of a key move."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def one_per_vendor_price(df: DataFrame, *order: Column) -> DataFrame:
    return first_of(df, ["vendor", half_up(F.col("price_per_unit") * 100)], *order)


def rank_offers(records: DataFrame, top: int = 50, upc: str = "primaryUpc", on: str = "price_per_unit") -> DataFrame:
    """The best offers of records (ordinal, title, price, currency, quantity, unit, url, vendor, ...), best first, with rank."""
    order = (F.desc("deal_score"), F.asc("ordinal"))
    best = one_per_vendor_price(scored(priced(verified(records, upc)), on), *order).orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_deal(ranked: DataFrame, least: float = 0.7) -> DataFrame:
    """The first row that is sure enough, else the first row."""
    return ranked.orderBy((F.col("confidence") >= least).desc(), "rank").limit(1)


def savings(df: DataFrame) -> DataFrame:
    """df with savings: percent below the mean price per unit, half up."""
    mean = F.broadcast(df.agg(F.avg("price_per_unit").alias("_mean"), F.count(F.lit(1)).alias("_n")))
    part = half_up((F.col("_mean") - F.col("price_per_unit")) / F.col("_mean") * 100)
    return df.join(mean).withColumn("savings", F.when(F.col("_n") > 1, part)).drop("_mean", "_n")


def other_results(ranked: DataFrame, best: DataFrame) -> DataFrame:
    return ranked.join(best.select("url"), "url", "left_anti")

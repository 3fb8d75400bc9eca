"""Rows as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.numbers import fixed, half_up, plain


def _or(x: Column, other: str) -> Column:
    return F.coalesce(x, F.lit(other))


def shipping_text(shipping: Column) -> Column:
    return F.when(shipping["isFree"], "Free").when(shipping["cost"].isNotNull(), F.concat(F.lit("$"), fixed(shipping["cost"], 2))).otherwise("Unknown")


def stock_text(status: Column) -> Column:
    return F.when(status == "in-stock", "In Stock").when(status == "out-of-stock", "Out of Stock").otherwise("Unknown")


def panel_rows(df: DataFrame) -> DataFrame:
    """Price per watt, price, watts, type, efficiency and brand as texts, and the details below them."""
    s, d = F.col("specs"), F.col("specs.dimensions")
    side = lambda c: _or(plain(d[c]), "?")
    return df.select(
        "url", F.concat(F.lit("$"), fixed(F.col("pricePerWattUsd"), 3)).alias("per_watt"), fixed(F.col("priceUsd"), 2).alias("price"), F.concat(s["wattage"].cast("string"), F.lit("W")).alias("watts"),
        formats.type_label(s["panelType"]).alias("type"), _or(F.concat(fixed(s["efficiency"], 1), F.lit("%")), "-").alias("efficiency"), _or(s["brand"], "-").alias("brand"),
        F.when(d.isNotNull(), F.concat(side("lengthMm"), F.lit(" x "), side("widthMm"), F.lit(" x "), side("depthMm"), F.lit(" mm"))).otherwise("-").alias("dimensions"),
        _or(F.concat(plain(s["weightKg"]), F.lit(" kg")), "-").alias("weight"), shipping_text(F.col("shipping")).alias("shipping"),
        stock_text(F.col("stockStatus") if "stockStatus" in df.columns else F.lit(None).cast("string")).alias("stock"), F.concat(half_up(F.col("confidence") * 100).cast("long").cast("string"), F.lit("%")).alias("confidence"),
    )


def result_rows(ranked: DataFrame, upc: str = "primaryUpc") -> DataFrame:
    """Offers as a search answers with them: upc, what was verified in one column, four decimals of unit prices and two of confidence."""
    also = [c for c in ("rank", "ordinal", "identifiers", "original_price", "discount_percent", "shipping", "promotion", "deal_score") if c in ranked.columns]
    checks = F.struct(F.col("valid_upc").alias("hasValidUpc"), F.col("matches").alias("crossVendorMatches"), F.col("verification_score").alias("verificationScore"))
    rounded = [half_up(F.col(c), n).alias(c) for c, n in (("price_per_unit", 4), ("price_per_unit_usd", 4), ("confidence", 2))]
    return ranked.select(*also, "title", "price", "currency", "quantity", "unit", "vendor", "url", *rounded, F.col(upc).alias("upc"), checks.alias("verification"))


def flagged(df: DataFrame, saved: DataFrame, key: str = "url") -> DataFrame:
    """df with saved: whether its url is among the saved ones, however often those are repeated."""
    known = saved.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("saved", F.lit(True))
    return df.join(known, key, "left").withColumn("saved", F.coalesce("saved", F.lit(False)))


def saved_rows(df: DataFrame) -> DataFrame:
    return df.select("url", formats.truncated(F.col("title"), 60).alias("title"), formats.currency(F.col("price"), F.col("currency")).alias("price"), formats.price_per_unit(F.col("price_per_unit"), F.col("unit")).alias("per_unit"), "vendor", formats.quantity(F.col("quantity"), F.col("unit")).alias("quantity"))


def toggled(active: list[str], country: str) -> list[str]:
    """The countries after one is switched; the last one stays."""
    if country not in active:
        return [*active, country]
    return [c for c in active if c != country] or active


def report(df: DataFrame, n: int = 10) -> list:
    """The first rows of a sorted frame, for a summary."""
    return df.limit(n).collect()

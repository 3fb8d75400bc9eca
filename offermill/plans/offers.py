"""Test relations: offers and panels derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ["g", "kg", "mg", "lb", "oz", "capsules", "tablets", "ml"]
CURRENCIES = ["USD", "EUR", "GBP", "CAD", "JPY", "XXX"]
#: Lines that a task takes at most, about, and below which it takes no fewer.
MOST_LINES, LEAST_LINES = 250_000, 20_000
ENDINGS = [".com", ".co.uk", ".de", ".com.au", ".jp", ".net"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for rows as many as lines, which grow with the table beyond Spark's number of shuffle partitions. The count is read from file footers."""
    n = table(spark, sf_dir, "lineitem").count()
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_LINES), n // MOST_LINES)


def _pick(values: list[str], index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer for each part and supplier, at its least price per piece. Only three columns of lineitem are read; what follows from a part or a supplier alone is made before it meets its offers.
    Most lines are the only ones of their offer, so they move once, by part, before they are added up."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount").repartition(tasks(spark, sf_dir), "l_partkey")
    lines = lines.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.min("l_discount").alias("_discount"))
    unit = _pick(UNITS, F.col("p_partkey"))
    body = F.lpad((F.col("p_partkey") * 7919 % F.lit(100000000000)).cast("string"), 11, "0")
    odd = sum((F.substring(body, i + 1, 1).cast("int") for i in range(0, 11, 2)), F.lit(0))
    even = sum((F.substring(body, i + 1, 1).cast("int") for i in range(1, 11, 2)), F.lit(0))
    check = (10 - (3 * odd + even) % 10) % 10
    wrong = F.when(F.col("p_partkey") % 5 == 0, (check + 1) % 10).otherwise(check)
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.concat_ws(" ", "p_name", "p_brand", F.concat(F.col("p_size").cast("string"), unit)).alias("title"),
        F.col("p_size").cast("double").alias("quantity"), unit.alias("unit"), F.concat(body, wrong.cast("string")).alias("primaryUpc"),
    )
    host = F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")), _pick(ENDINGS, F.col("s_nationkey")))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", host.alias("vendor"), _pick(CURRENCIES, F.col("s_nationkey")).alias("currency"))
    df = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return df.select(
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("ordinal"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nation"),
        "title", "price", "currency", "quantity", "unit", "vendor", F.concat(F.lit("https://www."), "vendor", F.lit("/product/"), F.col("p_partkey").cast("string")).alias("url"), "primaryUpc",
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(4.99)).cast("double").alias("shipping_cost"), (F.col("l_suppkey") % 4 == 0).alias("free_shipping"),
        (F.col("_discount") * 300).cast("long").alias("discount_percent"), (F.col("l_partkey") % 6 == 0).alias("coupon"),
        F.floor(F.col("price") * 100 + 0.5).cast("long").alias("cents"), F.col("p_size").alias("size"),
    )


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as panels of 20 to 1000 watts."""
    return offers(spark, sf_dir).select(
        "ordinal", "title", (F.col("price") / 10).alias("price"), "currency", (F.col("size") * 20).cast("long").alias("wattage"), "vendor", "url",
        _pick(["US", "UK", "DE", "AU"], F.col("nation")).alias("country"), _pick(["monocrystalline", "bifacial", "unknown"], F.col("partkey")).alias("panelType"),
        F.when(F.col("partkey") % 4 != 0, F.col("size") * 0.5 + 1).alias("efficiency"), (F.col("partkey") % 10 / F.lit(10.0)).alias("confidence"),
    )

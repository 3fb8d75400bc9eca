"""Counters of runs that merge without the rows they count.

A run keeps, for each of its groups, counts, sums, and a sketch of each column whose distinct values are wanted; below LISTED
values also the values themselves. Kept counters add up over runs in any order: sketches are united, lists are put
together while they stay short. So what many runs saw together costs as many rows as they have groups, however much they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values that a counter lists, at most; bits of a sketch's buckets (an error of about 1.04 / 2^(bits / 2), 0.8 %).
LISTED, BITS = 256, 14


def counted(rows: DataFrame, groups: list[str], distinct: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """groups, n, the sums, sketch and listed (null beyond LISTED) of rows.

    Values are counted once a group before any list is made, so no list is longer than LISTED.
    """
    value = F.col(distinct).cast("string")
    own = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in (sums or {}).items()), F.hll_sketch_agg(value, BITS).alias("sketch"))
    once = rows.filter(value.isNotNull()).select(*groups, value.alias("_value")).distinct()
    few = once.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= LISTED)
    same = [_same("o", "f", g) for g in groups]
    lists = once.alias("o").join(few.alias("f"), same).groupBy(*(F.col(f"o.{g}").alias(g) for g in groups)).agg(F.sort_array(F.collect_list("_value")).alias("listed"))
    none = rows.groupBy(*groups).agg(F.count(value).alias("_known")).filter("_known = 0").select(*groups, F.array().cast("array<string>").alias("listed"))
    every = lists.unionByName(none)
    return own.alias("o").join(every.alias("f"), same, "left").select(*(F.col(f"o.{c}").alias(c) for c in own.columns), F.col("f.listed").alias("listed"))


def _same(a: str, b: str, column: str) -> Column:
    return F.col(f"{a}.{column}").eqNullSafe(F.col(f"{b}.{column}"))


def merged(kept: DataFrame, groups: list[str], sums: list[str] | None = None) -> DataFrame:
    """Kept counters with fewer groups. A list survives if all have one and together they have few values, which are counted first."""
    own = kept.groupBy(*groups).agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums or []), F.hll_union_agg("sketch").alias("sketch"), (F.count_if(F.col("listed").isNull()) == 0).alias("_all"))
    once = kept.filter("listed IS NOT NULL").select(*groups, F.explode("listed").alias("_value")).distinct()
    few = once.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= LISTED)
    many = once.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LISTED).select(*groups, F.lit(True).alias("_many"))
    join = lambda x, y, how: x.alias("o").join(y.alias("f"), [_same("o", "f", g) for g in groups] or F.lit(True), how)
    lists = join(once, few, "inner").groupBy(*(F.col(f"o.{g}").alias(g) for g in groups)).agg(F.sort_array(F.collect_list("_value")).alias("listed"))
    lists = lists.withColumn("_many", F.lit(False)).unionByName(many.withColumn("listed", F.lit(None).cast("array<string>")))
    out = join(own, lists, "left").select(*(F.col(f"o.{c}").alias(c) for c in own.columns), F.coalesce("f._many", F.lit(False)).alias("_many"), F.col("f.listed").alias("listed"))
    return out.withColumn("listed", F.when(F.col("_all") & ~F.col("_many"), F.coalesce("listed", F.array().cast("array<string>")))).drop("_all", "_many")


def read(kept: DataFrame) -> DataFrame:
    """Counters with distinct, how many different values there are, and exact, whether that is a count or an estimate."""
    known = F.col("listed").isNotNull()
    return kept.withColumns({"distinct": F.when(known, F.size("listed").cast("long")).otherwise(F.hll_sketch_estimate("sketch")), "exact": known}).drop("sketch", "listed")

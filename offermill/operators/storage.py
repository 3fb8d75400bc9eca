"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below spark.checkpoint.dir; a temporary one only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="offermill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as a stored table: its lineage ends there, and its size is known to whatever joins it."""
    folder = folder or shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranked(df: DataFrame, *order, start: int = 0, name: str = "rank") -> DataFrame:
    """df with the place of each row in an order, from 1 and a start, at any size: no task sees more than its own range.

    Rows go to ranges by borders that Spark samples, are sorted there and stored with their place in the range; the counts
    of ranges, a row each, say where a range begins. Rows that the order doesn't tell apart are in one range, so an order
    should end in a key.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    place = F.monotonically_increasing_id()
    rows = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "ranked")
    rows = rows.withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)})
    ranges = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, as many as there are partitions
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return rows.join(ranges, "_range").withColumn(name, F.col("_ahead") + F.col("_place") + 1 + start).drop("_range", "_place", "_ahead")


def after(df: DataFrame, order: list[tuple[str, bool]], last: dict | None, limit: int = 50) -> DataFrame:
    """A page by key: the first rows of an order (column, ascending) behind a row's values; nulls come last. No row before it is sorted or counted."""
    from functools import reduce

    from pyspark.sql import functions as F

    sorts = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    if last is not None:
        tests, same = [], F.lit(True)
        for c, up in order:
            v = F.lit(last[c])
            behind = (F.col(c) > v if up else F.col(c) < v) | F.col(c).isNull() if last[c] is not None else F.lit(False)
            tests.append(same & F.coalesce(behind, F.lit(False)))
            same = same & F.col(c).eqNullSafe(v)
        df = df.filter(reduce(lambda a, b: a | b, tests))
    return df.orderBy(*sorts).limit(limit)

"""JSON documents of many shapes, each read once, as variants.

A document is a list of products, {products, panels}, or {key: {products}}. A list with one product a line is never held
whole: its lines are parsed where they are read, so that a file of any size is split among tasks. Any other document is put
together from its lines and parsed once.

Defined results: a malformed document has no products, whole or split: every line of a split list must hold, with commas
between them. An object that repeats a key is malformed, elements that are no objects have no fields, and an empty file or
folder has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import kept


def lines(spark: SparkSession, folder: str, pattern: str = "*.json", without: tuple[str, ...] = ()) -> DataFrame:
    """file, name, part and at (in order within a file) and value of every line."""
    place = F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    df = spark.read.option("pathGlobFilter", pattern).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), place.alias("place"), "value")
    return df.filter(~F.col("name").isin(*without)) if without else df


BLANK, OPEN, CLOSE, MORE, LAST, PIECE = range(6)


def parsed(rows: DataFrame) -> DataFrame:
    """lines with what each is by itself: blank, '[', ']', a product with or without a comma behind it, or a piece of something."""
    text = F.btrim("value", F.lit(" \t\r"))
    comma = text.endswith(",")
    v = F.when(text.startswith("{"), F.try_parse_json(F.when(comma, F.left(text, F.length(text) - 1)).otherwise(text)))
    product = F.when(F.col("v").isNotNull(), F.when(comma, MORE).otherwise(LAST)).otherwise(PIECE)
    return rows.withColumn("v", v).withColumn("kind", F.when(text == "", BLANK).when(text == "[", OPEN).when(text == "]", CLOSE).otherwise(product))


def split_files(rows: DataFrame) -> DataFrame:
    """The files whose lines are '[', products with commas between them, and ']'. Lines are counted in the splits in which they
    are read, and only a row a split moves."""
    kind, at = F.col("kind"), F.when(F.col("kind") != BLANK, F.col("place.at"))
    of = lambda k: F.count_if(kind == k)
    counts = [of(PIECE).alias("pieces"), of(OPEN).alias("opens"), of(CLOSE).alias("closes"), of(MORE).alias("mores"), of(LAST).alias("lasts")]
    ends = [F.min_by(kind, at).alias("first"), F.max_by(kind, at).alias("end"), F.max(F.when(kind == LAST, at)).alias("last"), F.max(F.when(kind == MORE, at)).alias("more")]
    splits = rows.select("file", F.col("place.part").alias("part"), "place", "kind").groupBy("file", "part").agg(*counts, *ends)
    there = F.when(F.col("end").isNotNull(), F.col("part"))
    place = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("part", c))).alias(c)
    found = splits.groupBy("file").agg(*(F.sum(c).alias(c) for c in ("pieces", "opens", "closes", "mores", "lasts")), F.min_by("first", there).alias("first"), F.max_by("end", there).alias("end"), place("last"), place("more"))
    ended = ((F.col("lasts") == 1) & (F.col("more").isNull() | (F.struct(F.col("more.part"), F.col("more.more").alias("at")) < F.struct(F.col("last.part"), F.col("last.last").alias("at"))))) | (F.col("lasts") + F.col("mores") == 0)
    return found.filter((F.col("pieces") == 0) & (F.col("opens") == 1) & (F.col("closes") == 1) & (F.col("first") == OPEN) & (F.col("end") == CLOSE) & ended).select("file")


def _groups(text: Column) -> Column:
    """Lists of products in a document's variant, with their place: a list, products, panels, then each key's products."""
    whole = F.try_variant_get("v", "$", "array<variant>")
    group = lambda part, items: F.struct(part.cast("long").alias("part"), items.alias("items"))

    def of(entry: Column) -> Column:
        items = F.try_variant_get(entry["value"], "$", "array<variant>")
        key = F.array_position(F.json_object_keys(text), entry["key"]) + 1
        return (
            F.when(entry["key"] == "products", group(F.lit(0), items))
            .when(entry["key"] == "panels", group(F.lit(1), items))
            .otherwise(group(key, F.try_variant_get(entry["value"], "$.products", "array<variant>")))
        )

    entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    return F.coalesce(F.transform(entries, of), F.array(group(F.lit(0), whole)))


def elements(spark: SparkSession, folder: str, pattern: str = "*.json", without: tuple[str, ...] = ()) -> DataFrame:
    """ordinal (name, part, at: in the order of files and of places in them) and v, a variant, of every product of all documents."""
    rows = parsed(lines(spark, folder, pattern, without))
    split = kept(split_files(rows), "split-files")
    ordinal = lambda part, at: F.struct("name", part.cast("long").alias("part"), at.cast("long").alias("at")).alias("ordinal")
    by_line = rows.filter("v IS NOT NULL").join(split, "file", "left_semi").select(ordinal(F.col("place.part"), F.col("place.at")), "v")
    rest = rows.select("file", "name", "place", "value").join(split, "file", "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n")
    whole = rest.groupBy("file", "name").agg(text.alias("text")).withColumn("v", F.try_parse_json("text"))
    groups = whole.select("name", F.explode(_groups(F.col("text"))).alias("g")).select("name", "g.part", F.posexplode("g.items").alias("at", "v"))
    return by_line.unionByName(groups.select(ordinal(F.col("part"), F.col("at")), "v"))


def fields(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with fields of v as text, whatever their type; null where there are none."""
    return rows.select(*[c for c in rows.columns if c != "v"], *(F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in names))

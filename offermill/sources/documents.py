"""JSON documents and streams of events: read, merged, written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import prefix_integer, prefix_number
from ..functions.urls import encoded
from . import shapes

#: Numbers may be strings; everything is read as text first.
PRODUCT = ["title", "price", "wattage", "panelType", "vendor", "source", "url", "country", "currency"]


def whole(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """name and value of each file; one document is one row."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    return df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value")


def batches(spark: SparkSession, folder: str, pattern: str = "solar-*.json") -> DataFrame:
    """Products of all batch files of any shape: a list, {products, panels}, or {key: {products}}; bad files have none.

    ordinal numbers them by file name, shape and place, for whatever keeps the first.
    """
    rows = shapes.fields(shapes.elements(spark, folder, pattern, ("solar-leaderboard.json", "solar-vendor-urls.json")), PRODUCT)
    price = F.coalesce(prefix_number(F.col("price")), F.lit(0.0))
    watts = F.coalesce(prefix_integer(F.col("wattage")), F.lit(0))
    rows = rows.filter((price != 0) & (watts != 0) & (F.col("title") != ""))
    source = F.nullif("source", F.lit(""))
    vendor = F.coalesce(F.nullif("vendor", F.lit("")), source)
    made = F.concat(F.lit("https://"), F.coalesce(vendor, F.lit("unknown")), F.lit("/"), F.substring(encoded(F.col("title")), 1, 80))
    url = F.coalesce(F.nullif("url", F.lit("")), source, made)
    return rows.select("ordinal", "title", price.alias("price"), watts.alias("wattage"), "panelType", vendor.alias("vendor"), url.alias("url"), "country", "currency")


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """url, status and ordinal of all stock files: a map, or one under results."""
    files = whole(spark, folder, "stock-results-*.json")
    inner = F.from_json("value", "results map<string,string>")["results"]
    entries = F.map_entries(F.coalesce(inner, F.from_json("value", "map<string,string>")))
    rows = files.select("name", F.posexplode(entries).alias("place", "e"))
    return rows.select(F.col("e.key").alias("url"), F.col("e.value").alias("status"), F.struct("name", "place").alias("ordinal"))


def leaderboard(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a leaderboard document; a missing or malformed one has none."""
    document = T.StructType([T.StructField("results", T.ArrayType(schema))])
    try:
        df = spark.read.option("wholetext", True).text(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return df.select(F.inline(F.from_json("value", document)["results"]))


def first_readable(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first path's leaderboard that has rows."""
    for p in paths:
        df = leaderboard(spark, p, schema)
        if df.limit(1).count():
            return df
    return spark.createDataFrame([], schema)


def document(results: DataFrame, metadata: DataFrame, *order) -> DataFrame:
    """One row, one JSON document, of results in order and metadata. For documents of bounded size, such as top lists."""
    ranked = results.orderBy(*order) if order else results
    rows = ranked.agg(F.collect_list(F.struct("*")).alias("results"))
    return rows.join(metadata.select(F.struct("*").alias("metadata"))).select(F.to_json(F.struct("results", "metadata"), {"ignoreNullFields": "false"}).alias("value"))


def write_document(one: DataFrame, path: str) -> None:
    """Staged beside its place by Spark's writer, which renames it when it is whole; so a document can be written over what it was read from."""
    spark = one.sparkSession
    one = spark.createDataFrame(one.collect(), one.schema)
    one.coalesce(1).write.mode("overwrite").text(path)


def envelope(ranked: DataFrame, best: DataFrame, query: dict) -> DataFrame:
    """The answer to a search in one row: its query, results by rank, and the best deal."""
    results = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in ranked.columns if c != "rank")))).alias("results"))
    deal = best.agg(F.first(F.struct("*")).alias("best_deal"))
    head = [F.lit(query["query"]).alias("query"), F.lit(query["category"]).alias("category"), F.array(*(F.lit(c) for c in query["countries"])).alias("countries")]
    return results.join(deal).select(*head, "results", "best_deal", F.current_timestamp().alias("timestamp"))


def insert_absent(saved: DataFrame, new: DataFrame) -> DataFrame:
    """saved with the rows of new whose url it lacks."""
    return new.join(saved.select("url"), "url", "left_anti").select(saved.columns).unionByName(saved)


def removed(saved: DataFrame, url: str) -> DataFrame:
    return saved.filter(F.col("url") != url)


def event_text(events: DataFrame, event: str = "event", data: str = "data") -> DataFrame:
    """Server-sent events as text."""
    return events.select(F.concat(F.lit("event: "), F.col(event), F.lit("\ndata: "), F.col(data), F.lit("\n\n")).alias("value"))


def parsed_events(streams: DataFrame, text: str = "value") -> DataFrame:
    """seq, event and data of each event in texts of them; an unfinished one at the end is left out."""
    whole_ = F.slice(F.split(text, "\n\n"), 1, F.greatest(F.size(F.split(text, "\n\n")) - 1, F.lit(0)))
    rows = streams.select(*[c for c in streams.columns if c != text], F.posexplode(whole_).alias("seq", "_e"))
    event, data = F.regexp_extract("_e", r"(?m)^event: (.*)$", 1), F.regexp_extract("_e", r"(?m)^data: (.*)$", 1)
    return rows.withColumns({"event": event, "data": data}).filter("event <> '' AND data <> ''").drop("_e")


def to_lines(rows: DataFrame) -> list[str]:
    return [json.dumps(json.loads(r), ensure_ascii=False) for r in rows.toJSON().toLocalIterator()]

"""Queries about tables that change and orders of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue_sql as sql
from .offers import offers, table
from .register import query


@query("""WITH v1 AS (SELECT p_partkey AS k, p_size AS size FROM part),
v2 AS (SELECT k, CASE WHEN k % 3 = 0 THEN size + 100 ELSE size END AS size FROM v1 UNION ALL SELECT k + 1000000, size FROM v1 WHERE k % 5 = 0),
v3 AS (SELECT * FROM v2 WHERE k % 7 <> 0), v4 AS (SELECT k, CASE WHEN size > 120 THEN 0 ELSE size END AS size FROM v3)
SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4""")
def versions_of_a_table(spark, sf_dir):
    """All parts, changed in place three times, the last time from what the table itself holds; every version as it was. A part that is added keeps apart from one that has its number already."""
    from ..operators.storage import shared_folder
    from ..sources.versions import VersionedTable

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("int").alias("size"))
    parts = parts.withColumn("id", F.col("k") * 2)
    own = VersionedTable(spark, shared_folder(spark, "parts"), "id long, k long, size int", "id", 16)
    own.upsert(parts)
    added = parts.filter("k % 5 = 0").withColumns({"k": F.col("k") + 1_000_000, "id": (F.col("k") + 1_000_000) * 2 + 1})
    own.upsert(parts.filter("k % 3 = 0").withColumn("size", F.col("size") + 100).unionByName(added))
    own.delete(own.read().filter("k % 7 = 0"))
    own.upsert(own.read().filter("size > 120").withColumn("size", F.lit(0)))
    out = own.read(1).withColumn("version", F.lit(1))
    for v in (2, 3, 4):
        out = out.unionByName(own.read(v).withColumn("version", F.lit(v)))
    return out.drop("id")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id")
def stream_into_versions(spark, sf_dir):
    """All events in micro-batches of a fifth, combined into one row a user; every batch is handed over twice."""
    from ..operators.storage import shared_folder
    from ..sources.versions import VersionedTable, sink

    folder = shared_folder(spark, "micro-batches")
    events = table(spark, sf_dir, "events").select("user_id", F.lit(1).cast("long").alias("n"), F.col("event_id").alias("last"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    events.repartition(5, F.col("last")).write.parquet(f"{folder}/in")
    own = VersionedTable(spark, f"{folder}/table", events.schema, "user_id", 8)
    fold = lambda rows: rows.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("cents").alias("cents"))
    write = sink(own, "events", fold, {"rows": F.count(F.lit(1))})

    def twice(rows, batch):
        write(rows, batch)
        write(rows, batch)

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return own.read()


@query(f"WITH {sql.OFFERS} SELECT ordinal, price, row_number() OVER (ORDER BY price DESC, ordinal) AS rank FROM offers")
def ranks_of_all_offers(spark, sf_dir):
    """The place of every offer by price, without a task that sees all."""
    from ..operators.storage import ranked

    return ranked(offers(spark, sf_dir).select("ordinal", "price"), F.desc("price"), F.asc("ordinal"))


@query(f"WITH {sql.OFFERS} SELECT ordinal, price FROM offers ORDER BY price DESC NULLS LAST, ordinal LIMIT 100 OFFSET 300")
def page_after_a_row(spark, sf_dir):
    """The fourth hundred of all offers by price, by key: each page begins behind the last row of the one before."""
    from ..operators.storage import after

    rows, last = offers(spark, sf_dir).select("ordinal", "price"), None
    for _ in range(3):
        last = after(rows, [("price", False), ("ordinal", True)], last, 100).tail(1)[0].asDict()
    return after(rows, [("price", False), ("ordinal", True)], last, 100)


@query(f"""WITH {sql.RANKED} SELECT ordinal, upc, {sql.js('price_per_unit', 4)} AS ppu, {sql.js('price_per_unit_usd', 4)} AS ppu_usd, {sql.js('confidence', 2)} AS confidence,
 CASE WHEN upc <> '' THEN 'UPC: ...' || right(upc, 4) END AS code_text, valid_upc AS valid, CAST(matches AS BIGINT) AS matches FROM priced""")
def result_records(spark, sf_dir):
    """All priced offers as a search answers with them."""
    from ..functions import barcodes, formats
    from ..operators import display, ranking

    df = ranking.scored(ranking.priced(ranking.verified(offers(spark, sf_dir).withColumn("valid_upc", barcodes.upc_a(F.col("primaryUpc"))))))
    v = F.col("verification")
    return display.result_rows(df).select("ordinal", "upc", F.col("price_per_unit").alias("ppu"), F.col("price_per_unit_usd").alias("ppu_usd"), "confidence", formats.last_four(F.col("upc")).alias("code_text"), v["hasValidUpc"].alias("valid"), v["crossVendorMatches"].alias("matches"))


@query(f"""WITH {sql.PANELS} SELECT ordinal, CASE currency WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'AUD' THEN 'A$' ELSE '$' END AS symbol, CASE "panelType" WHEN 'monocrystalline' THEN 'Mono' WHEN 'bifacial' THEN 'Bifa' ELSE '-' END AS label FROM panels""")
def panel_labels(spark, sf_dir):
    from ..functions import formats
    from .offers import panels

    return panels(spark, sf_dir).select("ordinal", formats.panel_symbol(F.col("currency")).alias("symbol"), formats.type_label(F.col("panelType")).alias("label"))


@query("""SELECT event_id, (['www.google.com', 'notgoogle.com', 'shop.ebay.com', 'iherb.com', 'amazon.com', ''])[event_id % 6 + 1] IN ('www.google.com', 'shop.ebay.com', 'amazon.com') AS protected FROM events""")
def guarded_urls(spark, sf_dir):
    from ..operators import frontier

    hosts = F.array(*(F.lit(h) for h in ("www.google.com", "notgoogle.com", "shop.ebay.com", "iherb.com", "amazon.com", "")))
    urls = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://"), F.element_at(hosts, (F.col("event_id") % 6 + 1).cast("int")), F.lit("/"), F.col("event_id").cast("string")).alias("url"))
    return frontier.guarded(urls).select("event_id", "protected")


@query("""WITH d AS (SELECT 'month' AS part, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders GROUP BY 2
 UNION ALL SELECT 'year', date_trunc('year', o_orderdate)::DATE, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY 2)
SELECT part, month, n, CASE WHEN k <= 256 THEN k END AS counted, true AS close FROM d""")
def customers_of_runs(spark, sf_dir):
    """Distinct customers of each month's orders, kept as a run's counters, and of each year by merging months alone; beyond 256 by sketches within 3 % of the truth."""
    from ..operators import counters
    from ..operators.storage import kept

    orders = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month"), "o_custkey")
    months = kept(counters.counted(orders, ["month"], "o_custkey"), "months")
    years = counters.merged(months.withColumn("month", F.trunc("month", "year")), ["month"])
    both = counters.read(months).withColumn("part", F.lit("month")).unionByName(counters.read(years).withColumn("part", F.lit("year")))
    truth = orders.groupBy("month").agg(F.countDistinct("o_custkey").alias("k")).withColumn("part", F.lit("month"))
    truth = truth.unionByName(orders.groupBy(F.trunc("month", "year").alias("month")).agg(F.countDistinct("o_custkey").alias("k")).withColumn("part", F.lit("year")))
    close = F.abs(F.col("distinct") - F.col("k")) <= F.when(F.col("exact"), 0).otherwise(0.03 * F.col("k"))
    return both.join(truth, ["part", "month"]).select("part", "month", "n", F.when(F.col("exact"), F.col("distinct")).alias("counted"), close.alias("close"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS country, p_name AS title, p_retailprice AS price, p_size AS wattage, p_type AS "panelType", p_brand AS vendor,
 CASE WHEN p_partkey % 2 = 0 THEN 'https://shop/' || p_partkey ELSE 'https://' || p_brand || '/' || replace(p_name, ' ', '%20') END AS url
FROM part WHERE p_retailprice <> 0 AND p_size <> 0 AND p_name <> ''""")
def documents_of_many_shapes(spark, sf_dir):
    """All parts as documents of 400 products in four shapes and with numbers of two kinds, written as files and read back."""
    from ..operators.storage import shared_folder
    from ..sources import documents

    part = table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 2 == 1
    common = [F.col("p_name").alias("title"), F.col("p_type").alias("panelType"), F.col("p_brand").alias("vendor"), F.col("p_partkey").cast("string").alias("country"), F.when(~odd, F.concat(F.lit("https://shop/"), "p_partkey")).alias("url")]
    texts = [F.concat("p_retailprice", F.lit(" USD")).alias("price"), F.concat("p_size", F.lit("W")).alias("wattage")]
    numbers = [F.col("p_retailprice").alias("price"), F.col("p_size").alias("wattage")]
    products = part.select(F.expr("p_partkey DIV 400").alias("doc"), F.when(odd, F.to_json(F.struct(*common, *texts))).otherwise(F.to_json(F.struct(*common, *numbers))).alias("p"))
    docs = products.groupBy("doc").agg(F.collect_list("p").alias("p"))  # 400 a document
    joined = lambda a, by=",": F.array_join(a, by)
    some, others = F.slice("p", 1, 150), F.slice("p", 151, 400)
    value = (
        F.when(F.col("doc") % 4 == 0, F.format_string("[\n  %s\n]", joined("p", ",\n  ")))
        .when(F.col("doc") % 4 == 1, F.format_string("[%s]", joined("p")))
        .when(F.col("doc") % 4 == 2, F.format_string('{"n": 2,\n "panels": [%s],\n "products": [%s]}', joined(some), joined(others)))
        .otherwise(F.format_string('{"z": {"products": [%s]}, "n": 1, "a": {"n": 2, "products": [%s]}}', joined(some), joined(others)))
    )
    folder = shared_folder(spark, "documents")
    docs.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return documents.batches(spark, folder, "part-*").drop("ordinal", "currency")

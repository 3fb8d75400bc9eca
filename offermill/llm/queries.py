"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pack import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrapper import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whiten import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private import find

    return find(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_language, op3_pack, op4_token_files, op5_main_text, op6_token_counts, op7_suffixes, op8_warc, op9_jaccard, op10_neighbours, op11_divergence, op12_whiten, op13_private)}
ORACLES = {"op1_decontaminate": sql.DECONTAMINATE, "op8_warc": sql.WARC, "op10_neighbours": sql.NEIGHBOURS, "op11_divergence": sql.DIVERGENCE}

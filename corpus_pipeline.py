"""From raw documents to packed sequences: each stage works on all that the one before kept.

Every stage but the last returns the columns of its documents, whatever they are called: columns that have an operator's
own names are carried apart from it. Defined results: an empty table passes through all stages; what null and empty texts,
repeated rows and rows without doc_id come to is said at each stage; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.common import scratch, table
from offermill.llm.decontaminate import decontaminate
from offermill.llm.jaccard import keep_one
from offermill.llm.langid import identify, train
from offermill.llm.pack import pack_documents
from offermill.llm.suffixes import deduplicate

#: A document whose best language has a lower mean probability is in none of the languages known.
LEAST_SCORE = 0.3


def apart(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns but the text in one, so that no operator meets their names."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))


def together(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs again, with those that changed."""
    return rows.select(*(changed.get(c, F.col("text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, as null and empty ones are, go. If no row is labelled, no
    language is known and all stay. Copies fare alike."""
    network = train(docs)
    if not network.labels:
        return docs
    return together(identify(apart(docs), network).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; rows without doc_id or words stay."""
    return keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that a document with a smaller doc_id has; a text that is repeated whole goes. Null texts
    become empty ones; n_chars, if there is one, follows the text."""
    out = deduplicate(apart(docs)).filter("n_bytes = 0 OR n_bytes > n_removed")
    changed = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return together(out, docs, **changed)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; null and empty texts aren't."""
    return together(decontaminate(apart(docs), table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is one piece, the end id."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("benchmark_passages", benchmark_passages), ("packed", packed)]

#: The language of a text can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"pipeline-{name}")
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
    return docs

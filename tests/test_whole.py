"""Queries that read their whole tables, against brute force in plain Python."""

import html
import math
import re
from collections import Counter
from fractions import Fraction

import __spark_entry__ as entry
from offermill.operators import ranking
from offermill.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_result_links_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    assert any("?" in p.url for p in pages) and any("#" in p.url for p in pages)
    want = Counter((p.page_id, ["Google", "Yahoo", "Mojeek"][p.page_id % 3], i, f"{p.url}/{i}") for p in pages for i in range(3))
    assert Counter(tuple(r) for r in entry.queries()["result_links"](spark, SF).collect()) == want


def test_savings_against_the_mean_of_all_priced_offers(spark):
    priced = {r.ordinal: Fraction(repr(r.price_per_unit)) for r in ranking.priced(ranking.verified(catalogue._coded(spark, SF))).select("ordinal", "price_per_unit").collect()}
    mean = sum(priced.values()) / len(priced)
    assert sum(p >= 10 for p in priced.values()) > len(priced) / 2
    want = {k: math.floor((mean - p) / mean * 100 + Fraction(1, 2)) for k, p in priced.items()}
    got = entry.queries()["savings_vs_avg"](spark, SF).collect()
    assert len(got) == len(want) and {r.ordinal: r.savings for r in got} == want


def test_queries_are_told_apart_by_their_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    first = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        words = re.split(r"\s+", re.sub(r"[^a-z0-9_\s]", "", d.text.lower(), flags=re.A), flags=re.A)
        first.setdefault(" ".join(sorted(w for w in words if len(w) > 2)), (d.doc_id, d.text))
    assert any(len(t) > 24 for _, t in first.values())
    assert {tuple(r) for r in entry.queries()["query_dedupe"](spark, SF).collect()} == set(first.values())


def test_all_parts_meet_by_ean(spark):
    rows = catalogue.offers(spark, SF).select("ordinal", "partkey", "primaryUpc").collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.primaryUpc, set()).add(r.partkey)
    want = Counter((r.ordinal, p) for r in rows for p in parts[r.primaryUpc])
    assert Counter(tuple(r) for r in entry.queries()["upc_to_ean_join"](spark, SF).collect()) == want


def test_titles_cut_in_a_character_reference(spark, tmp_path):
    heads = ["Salt &am", "Salt &amp", "Oil &quo", "Oil &quot", "Tea &a", "Tea &amp; more"]
    spark.createDataFrame([(i, "http://h.example/", f"<html><body><h1>{h}</h1></body></html>") for i, h in enumerate(heads)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {i: re.sub(r"[^A-Za-z0-9_\s\-.,()]", "", html.unescape(h)).strip() for i, h in enumerate(heads)}
    assert dict(map(tuple, entry.queries()["page_titles"](spark, str(tmp_path)).collect())) == want

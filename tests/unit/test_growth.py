"""Steps that grew faster than their input: how their plans look now, and the same results."""

import random
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from offermill.operators import limits
from offermill.sources import chunks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("engine", [False, True])
def test_a_run_of_requests_is_sorted_in_packs(spark, monkeypatch, engine):
    monkeypatch.setattr(limits, "PACK", 7)
    rnd = random.Random(5)
    rows = [(i, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=rnd.randint(0, 400) * 500), rnd.randint(0, 3), rnd.random() < 0.6, "x" * 50) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, engine int, failed boolean, more string").repartition(5)
    out = limits.budgeted(df, "ts", "id", ms=60_000, **({"engine": "engine", "failed": "failed"} if engine else {}))
    assert "inline" in plan(out)  # the one task that sees all gets lists, not rows
    made, engines, want = deque(), {}, []
    for i, ts, e, bad, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        while made and ts - made[0] >= timedelta(minutes=1):
            made.popleft()
        n, wrong = engines.get(e, (0, 0))
        allowed = len(made) < 60 and not (engine and wrong > 2 * (n - wrong) and n > 5)
        want.append((i, len(made), allowed))
        if allowed:
            made.append(ts)
            engines[e] = n + 1, wrong + bad
    assert sorted((r.id, r.recent, r.allowed) for r in out.collect()) == sorted(want)
    assert out.columns == [*df.columns, "recent", "allowed"] and all(r.more == "x" * 50 for r in out.collect())


def test_chunks_move_once(spark):
    rows = [("s", i, c.encode()) for i, c in enumerate("event: a\ndata: 1\n\nda|ta: 2\nevent: b\nda|ta: 3\r\r\n".split("|"))]
    df = chunks.events(spark.createDataFrame(rows, "stream string, seq long, chunk binary"), 1)
    assert "Window" not in plan(df)  # all windows over chunks are gone: what a block leaves open is one row
    assert sorted(map(tuple, df.collect())) == [("s", 1, "a", "1"), ("s", 5, "b", "3\r")]


@pytest.mark.parametrize("name", ["offers_ranked_top50", "best_deal", "other_results", "vendor_price_dedupe"])
def test_ranking_reads_its_tables_once(spark, name):
    from offermill.plans import catalogue

    assert "lineitem" not in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))  # offers are stored before codes and means are counted


@pytest.mark.parametrize("name", ["leaderboard_builder", "leaderboard_metadata"])
def test_tasks_of_a_leaderboard_grow_with_its_lines(spark, monkeypatch, name):
    from offermill.plans import catalogue, offers

    folder = "/root/testdata/sf0.001"
    want = catalogue.QUERIES[name](spark, folder).collect()
    monkeypatch.setattr(offers, "MOST_LINES", 100)
    df = catalogue.QUERIES[name](spark, folder)
    n = offers.table(spark, folder, "lineitem").count() // 100
    assert n > 50 and "hashpartitioning(_key#" in plan(df) and f", {n}), REPARTITION_BY_NUM" in plan(df)  # before, 4 tasks whatever the table
    assert df.collect() == want  # the same rows, in the same order
    ids = offers.offers(spark, folder).select(F.spark_partition_id().alias("p")).distinct().count()
    assert ids > 40


def test_batches_of_a_leaderboard_in_parts(spark):
    from offermill.operators import leaderboard

    rnd = random.Random(1)
    url = lambda i: rnd.choice([f"http://a/{i % 9}", "made up", None])
    rows = [(i, f"t{i % 7}", round(rnd.uniform(5, 400), 2), rnd.choice(["USD", "eur", None]), 100 + i % 3, "v", url(i), "US", None) for i in range(400)]
    df = spark.createDataFrame(rows, "ordinal long, title string, price double, currency string, wattage long, vendor string, url string, country string, panelType string")
    want = leaderboard.build(df).collect()
    assert 9 < len(want) < 60 and leaderboard.build(df, 7).collect() == want
    assert sorted(leaderboard.build(df, 7, ordered=False).collect()) == sorted(want)

"""Versioned tables, streams into them, ranks and pages at any size, and cool-downs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from offermill.operators import counters, limits, storage
from offermill.sources import shapes
from offermill.sources.versions import Conflict, VersionedTable, sink

SCHEMA = "k string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(df):
    return sorted(map(tuple, df.collect()))


def test_versions_stay_what_they_were(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 4)
    assert held(t.read()) == [] and t.versions() == [] and t.manifest()["version"] == 0
    assert t.upsert(rows(spark, ("a", 1), ("b", 2), ("b", 3), (None, 4)), F.desc("v")) == 1
    pinned = t.read()
    assert t.upsert(rows(spark, ("b", 20), ("c", 30))) == 2
    assert t.delete(rows(spark, ("a", 0), ("none", 0))) == 3
    assert t.insert_absent(rows(spark, ("c", 0), ("d", 4), ("d", 5)), F.asc("v")) == 4
    assert t.upsert(t.read().withColumn("v", -F.col("v"))) == 5  # from itself
    assert held(pinned) == held(t.read(1)) == [("a", 1), ("b", 3)]
    assert [held(t.read(v)) for v in (2, 3, 4, 5)] == [[("a", 1), ("b", 20), ("c", 30)], [("b", 20), ("c", 30)], [("b", 20), ("c", 30), ("d", 4)], [("b", -20), ("c", -30), ("d", -4)]]
    assert t.delete(t.read()) == 6 and held(t.read()) == [] and [m["what"] for m in t.history()] == ["upsert", "upsert", "delete", "insert", "upsert", "delete"]
    with pytest.raises(ValueError, match="no version"):
        t.read(9)


def test_a_write_rewrites_only_buckets_with_changes(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 16)
    t.upsert(rows(spark, *((f"k{i}", i) for i in range(200))))
    t.upsert(rows(spark, ("k7", 0)))
    one, two = t.manifest(1)["folders"], t.manifest(2)["folders"]
    assert len(one) == 16 and sum(one[b] != two[b] for b in one) == 1 and one.keys() == two.keys()


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 2)
    t.upsert(rows(spark, ("a", 1)))
    before = t.manifest()
    t.upsert(rows(spark, ("b", 2)))
    with pytest.raises(Conflict):
        t._commit({**before, "version": 2})
    assert held(t.read()) == [("a", 1), ("b", 2)] and t.versions() == [1, 2]


def test_batches_are_written_once_and_measured(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 2)
    write = sink(t, "app", lambda x: x.groupBy("k").agg(F.sum("v").alias("v")), {"rows": F.count(F.lit(1)), "most": F.max("v")})
    for batch in (0, 0, 1, 0, 1):
        write(rows(spark, ("a", 1 + batch), ("b", 5)), batch)
    sink(t, "other", lambda x: x.groupBy("k").agg(F.sum("v").alias("v")))(rows(spark, ("a", 100)), 0)
    assert held(t.read()) == [("a", 103), ("b", 10)] and [m["metrics"] for m in t.history()] == [{"rows": 2, "most": 5}, {"rows": 2, "most": 5}, {}]
    assert t.manifest()["batches"] == {"app": 1, "other": 0}


def test_a_stream_that_fails_after_writing_goes_on_from_its_checkpoint(spark, tmp_path):
    pairs = [(f"k{i % 7}", i) for i in range(60)]
    rows(spark, *pairs).repartition(4, "v").write.parquet(str(tmp_path / "in"))
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 4)
    write, calls = sink(t, "s", lambda x: x.groupBy("k").agg(F.sum("v").alias("v")), {"rows": F.count(F.lit(1))}), []

    def start(fails_at):
        def step(df, batch):
            write(df, batch)
            calls.append(batch)
            if batch == fails_at:  # the table holds the batch, but the stream doesn't know
                raise RuntimeError("stop here")

        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="stop here"):
        start(1).awaitTermination()
    start(None).awaitTermination()
    assert calls.count(1) == 2 and sum(m["metrics"]["rows"] for m in t.history()) == 60
    assert held(t.read()) == sorted((k, sum(v for x, v in pairs if x == k)) for k in {x for x, _ in pairs})


def test_ranks_over_all_rows(spark):
    rnd = random.Random(1)
    pairs = [(i, rnd.choice([None, 1.0, 1.0, 2.5, rnd.random()])) for i in range(3000)]
    df = spark.createDataFrame(pairs, "id long, price double").repartition(7)
    got = storage.ranked(df, F.asc_nulls_last("price"), F.desc("id"), start=10)
    want = {i: n for n, (i, _) in enumerate(sorted(pairs, key=lambda x: (x[1] is None, x[1] or 0, -x[0])), 11)}
    assert {r.id: r["rank"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate [_range")  # the window without partitions stands on the counts of ranges
    assert storage.ranked(df.limit(0), F.asc("id")).collect() == []


@pytest.mark.parametrize("order", [[("price", True), ("id", True)], [("price", False), ("id", True)], [("price", False), ("id", False)]])
def test_pages_by_key_cover_all_rows_once(spark, order):
    rnd = random.Random(2)
    pairs = [(i, rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(45)]
    df, last, seen = spark.createDataFrame(pairs, "id long, price double"), None, []
    while page := [r.asDict() for r in storage.after(df, order, last, 7).collect()]:
        seen += page
        last = page[-1]
    (_, a), (_, b) = order
    assert [(r["id"], r["price"]) for r in seen] == sorted(pairs, key=lambda x: (x[1] is None, (x[1] or 0) * (1 if a else -1), x[0] * (1 if b else -1)))


def test_a_success_does_not_end_a_cool_down(spark):
    df = spark.createDataFrame([("e", 0, True), ("e", 1000, True), ("e", 2000, False), ("e", 200_000, True), ("f", 5, False)], "k string, ms long, failed boolean").withColumn("ts", F.timestamp_millis("ms"))
    got = limits.failure_runs(df, "k", F.col("failed"), "ts", at="ts").orderBy("k", "ms").select("run", "cooldown_ms", "until_ms").collect()
    assert [tuple(r) for r in got] == [(1, 30000, 30000), (2, 60000, 61000), (0, 0, 61000), (1, 30000, 230000), (0, 0, None)]


def test_counters_of_runs_merge(spark):
    rnd = random.Random(4)
    pairs = [(d, f"v{rnd.randrange(40 if d in (1, 2, 3, 4) else 3000)}", i % 9) for i in range(8000) for d in [rnd.choice([1, 2, 3, 4, 5, 6, None])]] + [(7, None, 1), (8, None, 2)]
    df = spark.createDataFrame(pairs, "day int, vendor string, x long")
    days = counters.counted(df, ["day"], "vendor", {"x": F.col("x")})
    truth = lambda days: len({v for d, v, _ in pairs if d in days and v})
    for r in counters.read(days).collect():
        n = truth([r.day])
        assert r.n == sum(d == r.day for d, _, _ in pairs) and r.x == sum(x for d, _, x in pairs if d == r.day)
        assert r.exact == (n <= counters.LISTED) and abs(r["distinct"] - n) <= (0 if r.exact else 0.04 * n)
    low = counters.merged(days.filter("day < 5"), [], ["x"])
    assert [(r["distinct"], r.exact) for r in counters.read(low).collect()] == [(truth([1, 2, 3, 4]), True)]
    every = counters.read(counters.merged(days.withColumn("g", F.lit(1)), ["g"])).first()
    assert not every.exact and abs(every["distinct"] - truth([1, 2, 3, 4, 5, 6, 7, 8, None])) < 0.04 * 3000 and every.n == len(pairs)
    none = counters.read(counters.merged(days.filter("day > 6"), [])).first()
    assert (none["distinct"], none.exact, none.n) == (0, True, 2)


def plain_elements(text):
    """Products of a document in order; none of a malformed one."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key twice")
        return dict(pairs)

    try:
        doc = json.loads(text, object_pairs_hook=once)
    except ValueError:
        return []
    if isinstance(doc, list):
        return doc
    if not isinstance(doc, dict):
        return []
    known = [x for k in ("products", "panels") if isinstance(doc.get(k), list) for x in doc[k]]
    return known + [x for k, v in doc.items() if k not in ("products", "panels") and isinstance(v, dict) and isinstance(v.get("products"), list) for x in v["products"]]


def test_documents_of_every_shape_against_plain_json(spark, tmp_path):
    rnd, made = random.Random(3), {}
    for i in range(240):
        items = [{"title": f"{i}-{j} ,]\\n\u00e9", "price": rnd.choice([j + 0.5, f"{j} USD", None, True])} for j in range(rnd.choice([0, 1, 2, 9]))]
        lines = [json.dumps(x) for x in items]
        keyed = {k: {"products": items[n::3], "n": 1} for n, k in enumerate("zaq")}
        text = rnd.choice([
            "[\n" + ",\n".join(lines) + "\n]", "\n [ \r\n\t" + " , \r\n".join(lines) + "\n\n]\n\n", json.dumps(items), json.dumps(items, indent=2), "[\n" + ",\n".join(lines) + ",\n]", "[\n" + "\n".join(lines) + "\n]",
            "[\n" + ",\n".join(lines), "\n".join(lines), json.dumps({"panels": items[:1], "x": 1, "products": items[1:]}, indent=1), json.dumps(keyed), json.dumps(keyed | {"panels": items}), "[\n" + ",\n".join([*lines, '{"title": "a", "title": "b"}']) + "\n]",
            "", "{bad", "7", '[\n{"title": "1"},\n[]\n]', "[\n" + ",\n".join([*lines, "{bad}"]) + "\n]", "]\n" + ",\n".join(lines) + "\n[",
        ])
        made[f"d{i:03}.json"] = text
        (tmp_path / f"d{i:03}.json").write_bytes(text.encode())
    rows = shapes.fields(shapes.elements(spark, str(tmp_path)), ["title", "price"]).orderBy("ordinal").collect()
    own = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    want = [(n, x.get("title"), own(x.get("price"))) if isinstance(x, dict) else (n, None, None) for n, text in sorted(made.items()) for x in plain_elements(text)]
    assert [(r.ordinal["name"], r.title, r.price) for r in rows] == want and len(want) > 100
    # a list with a product a line is split among tasks and read in order
    many = [json.dumps({"title": f"t{i}", "price": i}) for i in range(4000)]
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "a.json").write_text("[\n" + ",\n".join(many) + "\n]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert shapes.lines(spark, str(tmp_path / "big")).rdd.getNumPartitions() > 4
        assert shapes.split_files(shapes.parsed(shapes.lines(spark, str(tmp_path / "big")))).count() == 1
        got = shapes.fields(shapes.elements(spark, str(tmp_path / "big")), ["title"]).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.title for r in got] == [f"t{i}" for i in range(4000)]

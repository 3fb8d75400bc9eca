"""Request budgets, cool-downs, circuit breakers and statistics, over logged requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed


def in_last(df: DataFrame, ts: str = "ts", ms: int = 60_000, keys: list[str] | None = None) -> DataFrame:
    """df with recent: how many earlier requests are younger than ms.

    With keys each key has its own budget. A budget for all is counted by time steps: a step's rows and those of the
    step before are all that a row can see, so no task gets all rows.
    """
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    if keys:
        return df.withColumn("recent", F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-(ms - 1), 0)) - 1)
    # each row counts in its own step and is seen, uncounted, in the next one
    rows = df.withColumns({"_at": at, "_step": F.floor(at / ms)})
    seen = rows.withColumn("_place", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_step", F.col("_step") + F.col("_place"))
    out = seen.withColumn("recent", F.count(F.lit(1)).over(Window.partitionBy("_step").orderBy("_at").rangeBetween(-(ms - 1), 0)) - 1)
    return out.filter("_place = 0").drop("_at", "_step", "_place")


_TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


#: Rows of a step that travel together, at most.
PACK = 4096


def _packed(df: DataFrame, keys: list[str], order: list[str], steps: Column) -> DataFrame:
    """df by keys in order, as sorted by steps first: a task that gets a whole key sorts packs, which take little more than their values."""
    rows = df.withColumn("_step", steps)
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_step").orderBy(*order)))
    rows = rows.groupBy(*keys, "_step", F.expr(f"_nth DIV {PACK}").alias("_part")).agg(F.collect_list(F.struct("_nth", *(c for c in df.columns if c not in keys))).alias("_rows"))
    rows = rows.withColumn("_rows", F.array_sort("_rows", lambda a, b: a["_nth"] - b["_nth"]))
    lists = [F.col("_rows")[c].alias(c) for c in df.columns if c not in keys]
    packs = rows.select(*keys, "_step", "_part", *lists).repartition(*keys).sortWithinPartitions(*keys, "_step", "_part")
    return packs.select(*keys, F.inline(F.arrays_zip(*(c for c in df.columns if c not in keys)))).select(*df.columns)


def folded(df: DataFrame, keys: list[str], order: list[str], read: list[str], new: list[tuple[str, str]], start: Callable[[], object], step: Callable[..., tuple], steps: Column | None = None) -> DataFrame:
    """df with new columns: what step makes of a key's state and the columns read, row by row in order.

    A task holds one key's state, whatever the number of its rows. steps, which never falls along the order, is for keys with
    very many rows: these are then sorted in other tasks, step by step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for key, *row in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), *(b.column(c).to_pylist() for c in read), strict=True):
                if state is None or key != at:
                    at, state = key, start()
                out.append(step(state, *row))
            columns = [pa.array(x, _TYPES[t]) for x, (_, t) in zip(zip(*out, strict=True), new, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *(n for n, _ in new)])

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[t]) for n, t in new)])
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order) if steps is None else _packed(df, keys, order, steps)
    return rows.mapInArrow(run, schema)


def _islands(df: DataFrame, at: str, ms: int) -> DataFrame:
    """df with _island, which rises where nothing happens for ms; told from one row for each time step that has rows."""
    rows = df.withColumn("_step", F.floor(F.col(at) / ms))
    by = Window.orderBy("_step")
    steps = rows.groupBy("_step").agg(F.min(at).alias("_x"), F.max(at).alias("_y"))
    steps = steps.withColumn("_pause", F.coalesce((F.col("_x") - F.lag("_y").over(by) >= ms).cast("long"), F.lit(0)))
    return rows.join(steps.select("_step", F.sum("_pause").over(by).alias("_island")), "_step").drop("_step")


def budgeted(df: DataFrame, ts: str, *order: str, ms: int = 60_000, most: int = fixed.BUDGET_PER_MINUTE, engine: str | None = None, failed: str | None = None) -> DataFrame:
    """df with recent, how many requests were made within ms before, and allowed; only allowed requests are made.

    One budget serves all requests, so they are taken in order; after a pause of ms it is full again, and what lies between
    such pauses goes to different tasks. With engine and failed, an engine whose made requests failed too often is denied,
    and as that lasts, all requests are one run. Requests without a time are neither allowed nor denied.
    """
    rows = df.withColumn("_at", F.unix_millis(F.col(ts).cast("timestamp")))
    timed = rows.filter("_at IS NOT NULL")
    timed = timed.withColumn("_island", F.lit(0).cast("long")) if engine else _islands(timed, "_at", ms)
    read = ["_at", *([engine, failed] if engine else [])]

    def step(state: tuple[deque, dict], at: int, name: object = None, bad: bool | None = None) -> tuple[int, bool]:
        made, engines = state
        while made and at - made[0] >= ms:
            made.popleft()
        recent, (n, wrong) = len(made), engines.get(name, (0, 0))
        allowed = recent < most and not (wrong > 2 * (n - wrong) and n > 5)
        if allowed:
            made.append(at)
            if engine:
                engines[name] = n + 1, wrong + bool(bad)
        return recent, allowed

    out = folded(timed, ["_island"], ["_at", *order], read, [("recent", "long"), ("allowed", "boolean")], lambda: (deque(), {}), step, steps=F.floor(F.col("_at") / 60_000))
    none = rows.filter("_at IS NULL").withColumns({"recent": F.lit(None).cast("long"), "allowed": F.lit(None).cast("boolean")})
    return out.drop("_island").unionByName(none).drop("_at")


def healthy(requests: Column, succeeded: Column, failed: Column) -> Column:
    return ~((failed > 2 * succeeded) & (requests > 5))


def proxy_blocked(succeeded: Column, failed: Column) -> Column:
    return (failed > 3) & (failed > 2 * succeeded)


def failure_runs(df: DataFrame, key: str, failed: Column, *order: str, base_ms: Column | int = 30_000, at: str | None = None) -> DataFrame:
    """df with run (failures in a row up to the row, 0 for a success) and cooldown_ms, doubled by each, at most ten minutes.

    With at, the column of the time, also until_ms: when the cool-downs up to the row end. A success ends a run of
    failures, not a cool-down that has begun.
    """
    window = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_failed", failed).withColumn("_island", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(window))
    run = F.sum(F.col("_failed").cast("long")).over(Window.partitionBy(key, "_island").orderBy(*order))
    base = base_ms if isinstance(base_ms, Column) else F.lit(base_ms)
    cooldown = F.least(base * F.pow(F.lit(2.0), F.least(F.col("run"), F.lit(60)) - 1), F.lit(float(fixed.COOLDOWN_CAP_MS))).cast("long")
    df = df.withColumn("run", run).withColumn("cooldown_ms", F.when(F.col("run") > 0, cooldown).otherwise(0)).drop("_failed", "_island")
    if at:
        ends = F.when(F.col("run") > 0, F.unix_millis(F.col(at).cast("timestamp")) + F.col("cooldown_ms"))
        df = df.withColumn("until_ms", F.max(ends).over(window))
    return df


def circuit_breaker(df: DataFrame, domain: str, failed: Column, ordinal: str, size: int = 8) -> DataFrame:
    """df with chunk and skipped: its domain failed in an earlier chunk of so many rows. ordinal counts from 0 without gaps."""
    df = df.withColumn("chunk", F.floor(F.col(ordinal) / size))
    first = df.filter(failed).groupBy(domain).agg(F.min("chunk").alias("_first"))
    return df.join(first, domain, "left").withColumn("skipped", F.coalesce(F.col("chunk") > F.col("_first"), F.lit(False))).drop("_first")


def numbered(df: DataFrame, *order: Column, by: Column, into: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in a total order without sorting them in one task.

    by never falls along the order, as the hour of a time by which rows are ordered; rows of one value are sorted together.
    """
    rows = df.withColumn("_bucket", by)
    before = F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_bucket").count().select(F.col("_bucket").alias("_own"), before.alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    rows = rows.withColumn("_nth", nth).join(starts, F.col("_bucket").eqNullSafe(F.col("_own")))
    return rows.withColumn(into, F.col("_start") + F.col("_nth")).drop("_bucket", "_own", "_nth", "_start")


def engine_stats(df: DataFrame, key: str, failed: Column) -> DataFrame:
    n = F.count(F.lit(1))
    fails = F.sum(failed.cast("long"))
    return df.groupBy(key).agg(n.alias("requests"), (n - fails).alias("succeeded"), fails.alias("failed"), F.max("ts").alias("last_request")).withColumn("healthy", healthy(F.col("requests"), F.col("succeeded"), F.col("failed")))


def moving_mean(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each key's mean, from 0, that each value in order moves halfway; a null value counts as 0."""

    def step(state: list[float], x: float | None) -> tuple[float]:
        state[0] = (state[0] + (x or 0.0)) / 2
        return (state[0],)

    out = folded(df.select(key, order, F.col(value).cast("double").alias("_value")), [key], [order], ["_value"], [("_mean", "double")], lambda: [0.0], step)
    return out.groupBy(key).agg(F.max_by("_mean", order).alias("mean"))


def cache_hits(df: DataFrame, key: str, ts: str, ttl_ms: int) -> DataFrame:
    """key, at (ms) and hit of every request: the key's entry, which a miss sets anew, is at most ttl_ms old. A request without
    a time misses and sets nothing."""

    def step(state: list[int | None], at: int | None) -> tuple[bool]:
        hit = at is not None and state[0] is not None and at - state[0] <= ttl_ms
        if not hit and at is not None:
            state[0] = at
        return (hit,)

    rows = df.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("at"))
    return folded(rows, [key], ["at"], ["at"], [("hit", "boolean")], lambda: [None], step)

"""Which lists a domain is on, whatever their length.

A dimension of domains has a row for each name of each list: name, label (the list) and how (below: the domain is the name
or below it; ending: it ends with the name, even within a word; within: it contains it). A list whose names take up to
MOST_BYTES is sent to the workers, which build one automaton of all names and read each distinct domain of a batch once;
nothing moves, and only the domain leaves the JVM. Beyond that, distinct domains meet the dimension by hash joins on their
endings, or substrings, of the lengths that names have.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, urls

MOST_BYTES = 32 << 20
HOWS = ("below", "ending", "within")

_AUTOMATA: dict[str, object] = {}


def dimension(spark: SparkSession, lists: dict[str, tuple[str, Iterable[str]]]) -> DataFrame:
    """name, label and how, of lists by label."""
    return spark.createDataFrame([(n, label, how) for label, (how, names) in lists.items() for n in names], "name string, label string, how string")


def _automaton(token: str, rows: list[tuple[str, str, str]]):
    if token not in _AUTOMATA:
        import ahocorasick

        by_name: dict[str, list[tuple[str, str]]] = {}
        for name, label, how in rows:
            if name:
                by_name.setdefault(name, []).append((label, how))
        a = ahocorasick.Automaton()
        for name, uses in by_name.items():
            a.add_word(name, (len(name), uses))
        if by_name:
            a.make_automaton()
        _AUTOMATA.clear()  # a worker serves one query's lists at a time
        _AUTOMATA[token] = a if by_name else None
    return _AUTOMATA[token]


def _labels(a, domain: str | None) -> list[str]:
    out = set()
    for end, (size, uses) in a.iter(domain) if a is not None and domain else ():
        start, last = end + 1 - size, end + 1 == len(domain)
        for label, how in uses:
            if how == "within" or last and (how == "ending" or start == 0 or domain[start - 1] == "."):
                out.add(label)
    return sorted(out)


def labels(domain: Column, rows: list[tuple[str, str, str]]) -> Column:
    """The labels of a domain in order, by the names (name, label, how) of a dimension that is small enough to send."""
    if (size := sum(len(n) + len(label) for n, label, _ in rows)) > MOST_BYTES:
        raise ValueError(f"names of {size} bytes are too many to send; use labelled")
    token = uuid.uuid4().hex

    @F.arrow_udf("array<string>")
    def found(column: pa.Array) -> pa.Array:
        own = column.dictionary_encode()
        a = _automaton(token, rows)
        each = pa.array([_labels(a, d) for d in own.dictionary.to_pylist()], pa.list_(pa.string()))
        return each.take(own.indices) if not own.indices.null_count else pa.array([_labels(a, d) for d in column.to_pylist()], pa.list_(pa.string()))

    return found(domain)


def by_joins(domains: DataFrame, names: DataFrame) -> DataFrame:
    """domain and labels of each distinct domain that has any, by joins with the dimension."""
    lengths = lambda *how: [r[0] for r in names.filter(F.col("how").isin(*how) & (F.col("name") != "")).select(F.length("name").alias("n")).distinct().orderBy("n").collect()]
    once = domains.select("domain").filter("domain IS NOT NULL").distinct()
    size = F.length("domain")
    array = lambda x: F.array(*(F.lit(n) for n in x)) if x else F.array().cast("array<int>")
    ends = once.select("domain", F.explode(F.filter(array(lengths("below", "ending")), lambda n: n <= size)).alias("n")).withColumn("at", size - F.col("n") + 1)
    inner = once.select("domain", F.explode(F.filter(array(lengths("within")), lambda n: n <= size)).alias("n")).select("domain", "n", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("at"))
    part = lambda df: df.withColumn("name", F.substring("domain", F.col("at"), F.col("n")))
    whole = (F.col("at") == 1) | (F.substring("domain", F.col("at") - 1, F.lit(1)) == ".")
    found = part(ends).join(names.filter("how <> 'within'"), "name").filter((F.col("how") == "ending") | whole).select("domain", "label")
    found = found.unionByName(part(inner).join(names.filter("how = 'within'"), "name").select("domain", "label"))
    return found.groupBy("domain").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # as many as there are lists


def labelled(found: DataFrame, names: DataFrame, url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """found with the domain of its url and the labels of that domain."""
    df = found.withColumn("domain", urls.domain(F.col(url)))
    size = names.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("label")), F.lit(0))).first()[0]
    if size <= most_bytes:
        return df.withColumn("labels", labels(F.col("domain"), [tuple(r) for r in names.select("name", "label", "how").collect()]))
    rows = by_joins(df, names)
    return df.join(rows, "domain", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).select(*found.columns, "domain", "labels")


def lists_of(category: str | None) -> dict[str, tuple[str, list[str]]]:
    """The lists that decide about a category's urls; None: panels."""
    if category is None:
        return {"vendor": ("ending", fixed.SOLAR_VENDORS), "deal": ("ending", fixed.SOLAR_DEAL_SITES), "browser": ("below", fixed.BROWSER_DOMAINS), "protected": ("below", fixed.PROTECTED_DOMAINS), "excluded": ("below", fixed.SOLAR_EXCLUDED)}
    return {"vendor": ("ending", fixed.VENDORS[category]), "deal": ("ending", fixed.DEAL_SITES[category]), "browser": ("below", fixed.BROWSER_DOMAINS), "excluded": ("within", urls.excluded(category))}


def rows_of(lists: dict[str, tuple[str, list[str]]], prefix: str = "") -> list[tuple[str, str, str]]:
    return [(n, prefix + label, how) for label, (how, names) in lists.items() for n in names]


def on(label: str, column: str = "_labels") -> Column:
    return F.array_contains(column, label)


def tier(url: Column, renderer: bool = False, more: str = "", prefix: str = "", column: str = "_labels") -> Column:
    """urls.tier by labels."""
    shop = F.coalesce(urls.looks_like_shop(url, more), F.lit(False))
    return F.when(F.lit(not renderer) & on(prefix + "browser", column), 5).when(on(prefix + "vendor", column), 1).when(on(prefix + "deal", column), 2).when(shop, 3).otherwise(4)

"""How the sources of each language differ from it and from each other, in exact arithmetic.

A term's probability in a group is p = 1 + floor(10^9 (count + 1) / (N + V)), and p diverges from q by floor((p - q)^2 / q).
Texts are counted in tasks, slice by slice, and summed by Spark; only terms in enough documents of a language are kept.

Terms of a source against its language: the divergence grows with p and, below p, falls as q grows, so the largest p and
the smallest q of a bucket of terms (a group's terms with like counts) bound what any of them reaches. Buckets are
evaluated best bound first, a few at a time, and a group is done when what is unseen is bounded strictly below its kth.

Sources against each other: what a term adds to a pair is a part for each side alone, which counts of counts give for all
terms at once, and a part for terms that both have, which their postings give: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
with the probabilities p0 and q0 of a term that isn't there. Pairs of sources are the result; pairs of rows are never made.

Defined results: null text, lang and source are empty strings; repeated rows are documents of their own; a text's case is
folded for A-Z alone; groups without terms have pairs (of value 0 if their language keeps no term) and no terms; an empty
table has no rows; columns but text, lang and source are not read. A text of any length is counted in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, slices, stored, views

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP = 200
STEP = 4 << 20
#: Postings of a block, about, in which one task meets sources; pairs that it holds at a time; salts of a language.
BLOCK, PAIRS, SALTS = 200_000, 1 << 20, 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = np.arange(256) >= 0x80
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def _count(texts: list[memoryview], group: np.ndarray) -> pa.Table:
    """g, term, n and docs of some texts, which belong to numbered groups."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    letter = _LETTER[data]
    edge = np.diff(letter.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = rows_of(_LOWER[data[letter]].tobytes(), np.append(0, np.cumsum(end - start))).dictionary_encode()
    many = max(1, len(words.dictionary))
    doc = np.searchsorted(begin, start, side="right") - 1
    pair, n = np.unique(doc * many + words.indices.to_numpy(), return_counts=True)
    key = group[pair // many] * many + pair % many
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    docs = np.diff(np.append(first, len(key)))
    n = np.add.reduceat(n, first) if len(first) else n
    key = key[first]
    term = words.dictionary.take(pa.array(key % many)).cast(pa.binary()).cast(pa.string())
    return pa.table({"g": key // many, "term": term, "n": n.astype(np.int64), "docs": docs.astype(np.int64)})


def _pieces(text: memoryview, limit: int) -> Iterator[memoryview]:
    """A long text in pieces that end between terms."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        to = min(at + limit, len(data))
        while to < len(data):
            rest = np.flatnonzero(~_LETTER[data[to : to + limit]])
            if len(rest):
                to += int(rest[0])
                break
            to = min(to + limit, len(data))
        yield text[at:to]
        at = to


def counted(docs: DataFrame, step: int = STEP) -> DataFrame:
    """lang, source, term, n and docs: occurrences, and documents that have the term, added up by slices of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", step):
            lang, source = b.column("lang").dictionary_encode(), b.column("source").dictionary_encode()
            whole = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            texts = views(b.column("text"))
            if len(texts) == 1 and len(texts[0]) > step:
                parts = pa.concat_tables([_count([p], whole) for p in _pieces(texts[0], step)])
                t = parts.group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "max")]).rename_columns(["g", "term", "n", "docs"])
            else:
                t = _count(texts, whole)
            g = t.column("g").to_numpy()
            names = [d.dictionary.take(pa.array(i)) for d, i in ((lang, g // len(source.dictionary)), (source, g % len(source.dictionary)))]
            yield from pa.table([*names, t.column("term"), t.column("n"), t.column("docs")], names=["lang", "source", "term", "n", "docs"]).to_batches(100_000)

    return _source(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def probability(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)); 1 if there are no terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) DIV ({total} + {terms}) ELSE 1 END").cast("long")


def f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV ({q}))"


def postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Kept terms by source (lang, source, term, n, p, q, p0, bucket), and all groups (lang, source, terms, p0)."""
    same = Window.partitionBy("lang", "term")
    rows = counted(docs).withColumns({"lang_n": F.sum("n").over(same), "in_docs": F.sum("docs").over(same), "lead": F.row_number().over(same.orderBy("source")) == 1})
    kept = stored(rows.filter(F.col("in_docs") >= least).select("lang", "source", "term", "n", "lang_n", "lead"), "kept-terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("leads"))
    langs = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("leads").alias("terms"))
    every = _source(docs).select("lang", "source").distinct().join(own.select("lang", "source", "total"), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    groups = stored(every.withColumn("p0", probability("0", "total", "terms")), "groups")
    known = kept.join(groups, ["lang", "source"]).withColumns({"p": probability("n", "total", "terms"), "q": probability("lang_n", "lang_total", "terms"), "bucket": F.floor(F.log2("n")).cast("int")})
    return stored(known.select("lang", "source", "term", "n", "p", "q", "p0", "bucket"), "postings"), groups


def best_of(rows: DataFrame, k: int) -> DataFrame:
    """The k largest values of each group, ties to the smaller item; with their rank."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_terms(rows: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value and rank of the k terms of each group that stand out most from its language."""
    group = ["lang", "source"]
    ahead = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("size"), F.max("p").alias("p"), F.min("q").alias("q")).filter("p > q").withColumn("bound", F.expr(f("p", "q")))
    buckets = stored(buckets.withColumn("step", F.ceil(F.log(8.0, F.greatest(F.coalesce(F.sum("size").over(ahead), F.lit(0)), F.lit(k)) / k)).cast("int")), "buckets")
    steps, best, left = buckets.agg(F.max("step")).first()[0], None, None
    for step in range((steps or 0) + 1):
        now = buckets.filter(F.col("step") == step)
        now = (now.join(left, group, "left_semi") if left is not None else now).select(*group, "bucket")
        new = rows.join(now, [*group, "bucket"]).filter("p > q").select(*group, F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))
        best = stored(best_of(best.drop("rank").unionByName(new) if best is not None else new, k), "best-terms")
        reached = best.groupBy(*group).agg(F.count(F.lit(1)).alias("found"), F.min("value").alias("kth"))
        unseen = buckets.filter(F.col("step") > step).groupBy(*group).agg(F.max("bound").alias("bound"))
        left = stored(unseen.join(reached, group, "left").filter((F.coalesce("found", F.lit(0)) < k) | (F.col("bound") >= F.col("kth"))).select(*group), "open-groups")
        if left.isEmpty():
            break
    return best


def _added(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(value[order], first) if len(first) else value


def _meet(block: pa.Table) -> pa.Table:
    """What terms that both have add to each ordered pair of sources, by the postings of some terms."""
    code = lambda *names: np.unique(np.stack([block[n].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for n in names]), axis=1, return_index=True, return_inverse=True)[1:]
    at, who = code("lang", "source")
    _, term = code("lang", "term")
    order = np.argsort(term, kind="stable")
    who, term = who[order], term[order]
    p, p0 = (block[c].to_numpy()[order] for c in ("p", "p0"))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    size = np.diff(np.append(first, len(term)))
    size, begin = np.repeat(size, size), np.repeat(first, size)
    ends, many = np.cumsum(size), len(at)
    g = lambda a, b: (a - b) * (a - b) // b
    keys, values, a = [], [], 0
    while a < len(term):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(a, z), size[a:z])
        j = np.arange(len(i)) - np.repeat(np.cumsum(size[a:z]) - size[a:z], size[a:z]) + begin[i]
        i, j = i[i != j], j[i != j]
        k, v = _added(who[i] * many + who[j], g(p[i], p[j]) - g(p[i], p0[j]) - g(p0[i], p[j]) + g(p0[i], p0[j]))
        keys.append(k)
        values.append(v)
        a = z
        if sum(map(len, keys)) > 4 * PAIRS:
            k, v = _added(np.concatenate(keys), np.concatenate(values))
            keys, values = [k], [v]
    k, v = _added(np.concatenate(keys), np.concatenate(values))
    name = lambda c, i: block[c].combine_chunks().take(pa.array(at[i]))
    return pa.table({"lang": name("lang", k // many), "source": name("source", k // many), "other": name("source", k % many), "value": v})


def divergences(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of each source and each other one of its language."""
    blocks = max(1, -(-rows.count() // BLOCK))
    both = rows.select("lang", "source", "term", "p", "p0").withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)))
    both = both.groupBy("block").applyInArrow(_meet, "lang string, source string, other string, value long")
    # a term that isn't there is a count of 0, which all of the language's terms have, less those that are there
    alone = rows.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("m")).withColumn("there", F.lit(1))
    alone = alone.unionByName(groups.select("lang", "source", "p0", F.col("p0").alias("p"), F.col("terms").alias("m"), F.lit(0).alias("there")))
    alone = alone.withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = alone.join(others, ["lang", "salt"]).filter("source <> other")
    none = f"there * {f('p0', 'q0')}"
    met = met.groupBy("lang", "source", "other").agg(F.expr(f"sum(m * ({f('p', 'q0')} - {none}))").alias("value"), F.expr(f"sum(m * there * ({f('q0', 'p')} - {f('q0', 'p0')}))").alias("back"))
    back = met.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value"))
    every = met.drop("back").unionByName(back).unionByName(both)
    return every.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value and rank: each source against the others, and its top terms against the language."""
    rows, groups = postings(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = divergences(rows, groups).withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})
    terms = top_terms(rows, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))

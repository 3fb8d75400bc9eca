"""Engines and extractors that a user adds, called by name from SQL.

An extractor is a function of a page (html, url) that yields dicts. It is registered as a table function, so that SQL calls
it laterally: each page is a row on one side, what the function finds on it are rows on the other. Its columns are fixed,
or follow from constant arguments of the call: the function's schema may itself be a function of these options, which
Spark asks when it plans the query. An engine is a named rule (or function) for links on result pages with a tier and a
cool-down; it becomes a table function of links too, and a row of the table of engines, so plans that assign queries to
engines need no other list. A page on which an extractor fails gives one row with its error and null columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import fixed
from .html import Page, facts, listing_cards, only_closed, result_links

#: Errors that a page's markup can cause; others are faults of the extractor and end the query.
PAGE_ERRORS = (ValueError, RecursionError, AssertionError)


def table_function(schema: str | Callable[..., T.StructType], function: Callable[..., Iterable[dict]]):
    """A table function of (html, url, options by name) whose rows are the dicts, an ordinal and an error."""

    fixed_columns = None if callable(schema) else T.StructType.fromDDL(schema)

    def columns(options: dict) -> T.StructType:
        return fixed_columns or schema(**options)

    class Extract:
        @staticmethod
        def analyze(html: AnalyzeArgument, url: AnalyzeArgument | None = None, **options: AnalyzeArgument) -> AnalyzeResult:
            if html.isTable or html.dataType not in (T.StringType(), T.NullType()):
                raise ValueError("the first argument must be a page's html")
            if fixed_columns is None and (bad := [k for k, v in options.items() if not v.isConstantExpression]):
                raise ValueError(f"columns follow from these options, so they must be constants: {', '.join(bad)}")
            own = columns({k: v.value for k, v in options.items()})
            if {"ordinal", "error"} & {f.name.lower() for f in own}:
                raise ValueError("ordinal and error are columns of every extractor")
            return AnalyzeResult(T.StructType([T.StructField("ordinal", T.LongType()), *own.fields, T.StructField("error", T.StringType())]))

        def __init__(self):
            self.names = None  # options that decide columns are the same for all rows

        def eval(self, html: str, url: str | None = None, **options):
            self.names, count = self.names or columns(options).names, 0
            try:
                for row in function(html or "", url, **options):
                    yield (count, *(row.get(n) for n in self.names), None)
                    count += 1
            except PAGE_ERRORS as e:
                yield (count, *[None] * len(self.names), f"{type(e).__name__}: {e}"[:500])

    from pyspark.sql.functions import udtf

    return udtf(Extract)


@dataclass
class Registry:
    """What install() makes known to a session. With defaults, the engines and extractors of the library are there from the start."""

    defaults: bool = True
    engines: dict[str, tuple[int, int, object]] = field(default_factory=dict)
    extractors: dict[str, tuple[object, Callable]] = field(default_factory=dict)

    def __post_init__(self):
        if self.defaults:
            for name, (tier, cooldown) in fixed.ENGINES.items():
                self.engine(name, tier, cooldown, fixed.ENGINE_LINKS.get(name, {"selectors": [], "own": []}))
            self.extractor("listing_cards", "title string, price_text string, link string, classes string", listing_cards)
            self.extractor("page_fields", _field_schema, _fields)

    def extractor(self, name: str, schema: str | Callable[..., T.StructType], function: Callable[..., Iterable[dict]]) -> Registry:
        """function(html, url, **options) yields dicts with the columns of the schema, a DDL string or a function of the options that gives a StructType."""
        if not name.isidentifier():
            raise ValueError(f"{name!r} can't be the name of a function")
        self.extractors[name] = (schema, function)
        return self

    def engine(self, name: str, tier: int, cooldown_ms: int, links: dict | Callable[[str], Iterable[str]]) -> Registry:
        """links: a rule (selectors in order, own: parts of links that lead back, fallback, enough), or a function of the html that yields links."""
        if tier not in (1, 2, 3) or cooldown_ms < 0:
            raise ValueError("an engine has a tier from 1 to 3 and a cool-down of 0 ms or more")
        self.engines[name] = (tier, cooldown_ms, links)
        return self

    def install(self, spark: SparkSession) -> Registry:
        """Registers extractors by name, engine_links(html, engine => ...), and a view of engines."""
        for name, (schema, function) in self.extractors.items():
            spark.udtf.register(name, table_function(schema, function))
        rules = {name: links for name, (_, _, links) in self.engines.items()}

        def found(html: str, url: str | None = None, engine: str | None = None):
            rule = rules.get(engine)
            if callable(rule):
                return ({"href": h} for h in rule(html))
            return result_links(html, engine, rules) if rule else ()

        spark.udtf.register("engine_links", table_function("href string", found))
        rows = [(n, t, c, i) for i, (n, (t, c, _)) in enumerate(self.engines.items())]
        spark.createDataFrame(rows, "engine string, tier int, cooldown_ms long, engine_ordinal int").createOrReplaceTempView("engines")
        return self

    def query_engines(self, queries: DataFrame, most_tier: int = 3) -> DataFrame:
        """queries × the engines of the registry up to a tier."""
        rows = F.array(*(F.struct(F.lit(n).alias("engine"), F.lit(t).alias("tier"), F.lit(c).cast("long").alias("cooldown_ms")) for n, (t, c, _) in self.engines.items() if t <= most_tier))
        return queries.select("*", F.inline(rows))


def _field_schema(fields: str = "title_tag", closed: bool = False) -> T.StructType:
    return T.StructType([T.StructField(_known(n), T.StringType()) for n in fields.split(",")])


def _known(name: str) -> str:
    if (name := name.strip()) not in ("title_tag", "h1", "og_title", "price_meta", "description", "body_text", "json_price", "json_currency", "json_brand"):
        raise ValueError(f"pages have no field {name!r}")
    return name


def _fields(html: str, url: str | None = None, fields: str = "title_tag", closed: bool = False) -> Iterable[dict]:
    """One row of a page's facts, those that are asked for. Character references without a semicolon count as browsers take
    them, or as text if only closed ones are to be decoded."""
    found = facts(only_closed(html) if closed else html)
    return [{n.strip(): found[n.strip()] for n in fields.split(",")}]


def selected(html: str, url: str | None, selector: str, attribute: str | None = None) -> Iterable[dict]:
    """For extractors of one's own: text, or an attribute, of all elements that a selector finds."""
    return [{"value": e.get(attribute) if attribute else e.text()} for e in Page(html).select(selector)]

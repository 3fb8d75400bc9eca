"""Numbers as double arithmetic gives them: rounding half up, numeric prefixes, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half towards plus infinity, on the binary value; F.round would round the decimal expansion, away from 0."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def prefix_number(text: Column) -> Column:
    """The longest numeric prefix as a double, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def prefix_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long")


def lookup(table: dict, key: Column) -> Column:
    """A literal map's value, null where the key is unknown."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", half_up(x, digits))


def plain(x: Column) -> Column:
    """A number without a trailing .0."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))

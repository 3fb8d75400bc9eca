"""Strings for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numbers import fixed as decimals
from .numbers import half_up, lookup, plain

DASH = "—"


def currency(value: Column, code: Column) -> Column:
    symbol = F.coalesce(lookup(fixed.DISPLAY_SYMBOLS, code), F.concat(code, F.lit(" ")))
    return F.when(value.isNull() | F.isnan(value), DASH).otherwise(F.concat(symbol, decimals(value, 2)))


def price_per_unit(value: Column, unit: Column) -> Column:
    return F.concat(F.when(value.isNull() | F.isnan(value), DASH).when(value < 0.01, decimals(value, 4)).otherwise(decimals(value, 2)), F.lit("/"), unit)


def quantity(value: Column, unit: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), DASH).otherwise(F.concat(plain(value), F.lit(" "), unit))


def truncated(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 3), F.lit("...")))


def elapsed(ms: Column) -> Column:
    """Milliseconds below a second, whole seconds below a minute, else minutes and seconds."""
    s = F.floor(ms / 1000)
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def type_label(panel_type: Column) -> Column:
    """The first four letters, the first one large; a dash for an unknown type."""
    return F.when(panel_type == "unknown", "-").otherwise(F.concat(F.upper(F.substring(panel_type, 1, 1)), F.substring(panel_type, 2, 3)))


def panel_symbol(currency: Column) -> Column:
    """The sign before a panel's price; a dollar's for any other currency."""
    return F.when(currency == "EUR", "€").when(currency == "GBP", "£").when(currency == "AUD", "A$").otherwise("$")


def last_four(code: Column) -> Column:
    """A code as it is shown, by its last four signs; null without a code."""
    return F.when(code != "", F.concat(F.lit("UPC: ..."), F.right(code, F.lit(4))))


def badges(valid_upc: Column, matches: Column, discount: Column, savings: Column, coupon: Column, free: Column) -> Column:
    text = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value)
    return F.array_compact(F.array(
        text(valid_upc, F.lit("UPC")), text(matches > 0, F.concat((matches + 1).cast("string"), F.lit(" vendors"))), text(discount > 5, F.concat(discount.cast("string"), F.lit("% off"))),
        text(savings > 10, F.concat(savings.cast("long").cast("string"), F.lit("% below avg"))), text(coupon, F.lit("coupon")), text(free, F.lit("free shipping")),
    ))


def progress(stage: Column, done: Column, total: Column) -> Column:
    """Percent: searching fills 5 to 40 and crawling 40 to 80, by what is done of the total if both are known."""
    part = lambda low, size, unknown: F.when((total > 0) & (done >= 0), low + done.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * size).otherwise(unknown)
    known = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in (("starting", 2.0), ("extracting", 85.0), ("ranking", 95.0), ("complete", 100.0)) for x in kv)), stage), F.lit(0.0))
    return F.when(stage == "searching", F.when(done > 0, part(5.0, 35.0, 10.0)).otherwise(10.0)).when(stage == "crawling", part(40.0, 40.0, 50.0)).otherwise(known)

"""Typed values out of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numbers import found, half_up, lookup

#: ASCII word ends; Java's own \b looks at all letters.
END = "(?![A-Za-z0-9_])"
_SPACE = "[\\s\\x{00A0}]"


def _s(pattern: str) -> str:
    return pattern.replace("\\s", _SPACE)


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return found(text, pattern, group).try_cast("double")


def first_of(tries: list[tuple], names: tuple[str, str], fine) -> Column:
    """The first struct that is fine; each is written once in the expression."""
    options = F.array(*(F.struct(a.alias(names[0]), b.alias(names[1])) for a, b in tries))
    return F.get(F.filter(options, lambda x: F.coalesce(fine(x[names[0]]), F.lit(False))), F.lit(0))


def price(text: Column, thousands: bool = False) -> Column:
    """struct(value, currency) or null: a symbol and number, a number and code, or a number with two decimals.

    A comma is a decimal comma, so $1,299.99 is 1.29; with thousands, commas before three digits are dropped first.
    """
    if thousands:
        text = F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")
    amount = r"(\d+(?:[.,]\d{2})?)"
    symbol, code = "([£$€₹¥])" + _SPACE + "*" + amount, "(?i)" + amount + _SPACE + "*(USD|EUR|GBP|INR|AUD|CAD|JPY)"
    value = lambda p, g: F.replace(found(text, p, g), F.lit(","), F.lit(".")).try_cast("double")
    tries = [
        (value(symbol, 2), lookup(fixed.SYMBOL_CURRENCY, found(text, symbol, 1))),
        (value(code, 1), F.upper(found(text, code, 2))),
        (value(r"(\d+(?:\.\d{2}))", 1), F.lit("USD")),
    ]
    return first_of(tries, ("value", "currency"), lambda v: v > 0)


def unit_name(unit: Column) -> Column:
    unit = F.lower(unit)
    return F.when(unit.contains("fl") & unit.contains("oz"), "fl oz").when(unit.contains("veggie") & unit.contains("cap"), "capsules").otherwise(F.coalesce(lookup(fixed.UNIT_NAMES, unit), unit))


def quantity(text: Column) -> Column:
    """struct(value, unit) or null: weights and volumes, then counted things, then packs of several."""
    t = F.trim(F.lower(text))
    number = r"(\d+(?:\.\d+)?)" + _SPACE + "*"
    weight, count = number + "(" + _s(fixed.WEIGHT_UNITS) + ")" + END, number + "(" + _s(fixed.COUNT_UNITS) + ")"
    pack = r"(\d+)" + _SPACE + "*x" + _SPACE + "*" + number + "(" + fixed.PACK_UNITS + ")"
    tries = [(_number(t, p), found(t, p, 2)) for p in (weight, count)]
    tries.append((_number(t, pack) * _number(t, pack, 2), found(t, pack, 3)))
    q = F.array(first_of(tries, ("value", "unit"), lambda v: v.isNotNull()))
    named = F.transform(q, lambda x: F.when(x.isNotNull(), F.struct(x["value"].alias("value"), unit_name(x["unit"]).alias("unit"))))
    return F.get(named, F.lit(0))


def wattage(text: Column) -> Column:
    kilo, watt = _number(text, "(?i)(\\d+(?:\\.\\d+)?)" + _SPACE + "*kw"), _number(text, "(?i)(\\d+(?:\\.\\d+)?)" + _SPACE + "*[-]?" + _SPACE + "*(?:watt(?:s)?|w)" + END)
    return F.coalesce(F.when((kilo > 0) & (kilo < 100), half_up(kilo * 1000)), F.when((watt > 0) & (watt < 100000), half_up(watt))).cast("long")


def panel_type(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("bifacial"), "bifacial").when(t.contains("mono"), "monocrystalline").when(t.contains("poly"), "polycrystalline").when(t.rlike("thin[\\s-]?film|amorphous"), "thin-film").otherwise("unknown")


def efficiency(text: Column) -> Column:
    n, s = r"(\d+(?:\.\d+)?)", _SPACE + "*"
    patterns = [f"(?i)efficiency{s}[:=]?{s}{n}{s}%", f"(?i){n}{s}%{s}efficiency", f"(?i){n}{s}percent{s}efficiency", f"(?i)efficiency{s}[:=]?{s}{n}{s}percent", f"{n}{s}%", f"(?i){n}{_SPACE}+percent"]
    return F.coalesce(*(F.when(v.between(5, 50), v) for v in (_number(text, p) for p in patterns)))


def dimensions(text: Column) -> Column:
    """struct(lengthMm, widthMm, depthMm): three or two sides, in mm or inches."""
    n, s = r"(\d+(?:\.\d+)?)", _SPACE + "*"
    inch = f'(?:in(?:ch(?:es)?)?{END}|"(?=[A-Za-z0-9_]))'
    tries = []
    for sides in (3, 2):
        for end, scale in (("mm", None), (inch, 25.4)):
            p = "(?i)" + f"{s}[x×]{s}".join([n] * sides) + s + end
            get = lambda g, p=p, scale=scale: _number(text, p, g) if scale is None else half_up(_number(text, p, g) * scale * 10) / 10
            depth = get(3) if sides == 3 else F.lit(None).cast("double")
            tries.append(F.when(get(1).isNotNull(), F.struct(get(1).alias("lengthMm"), get(2).alias("widthMm"), depth.alias("depthMm"))))
    return F.coalesce(*tries)


def weight_kg(text: Column) -> Column:
    kg, lb = _number(text, "(?i)(\\d+(?:\\.\\d+)?)" + _SPACE + "*kg"), _number(text, "(?i)(\\d+(?:\\.\\d+)?)" + _SPACE + "*(?:lbs?|pounds?)")
    return F.coalesce(F.when((kg > 0) & (kg < 500), kg), F.when((lb > 0) & (lb < 1000), half_up(lb * 0.453592, 2)))


def title(text: Column) -> Column:
    """White space as single spaces, then only ASCII word characters and - . , ( ); at most 200 characters."""
    t = F.regexp_replace(text, _SPACE + "+", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"[^A-Za-z0-9_\s\-.,()]", "")), 1, 200)

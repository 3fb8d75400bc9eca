"""Check digits and kinds of product codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(code: Column, size: int) -> Column:
    """All digits of that number, and the last one the weighted sum's check digit; the digit before it weighs 3."""
    weighted = sum((F.substring(code, i + 1, 1).try_cast("int") * (3 if (size - i) % 2 == 0 else 1) for i in range(size - 1)), F.lit(0))
    check = (F.lit(10) - weighted % 10) % 10
    return F.coalesce(code.rlike(f"^[0-9]{{{size}}}$") & (check == F.substring(code, size, 1).try_cast("int")), F.lit(False))


def upc_a(code: Column) -> Column:
    return _checked(code, 12)


def ean_13(code: Column) -> Column:
    return _checked(code, 13)


def gtin_14(code: Column) -> Column:
    return _checked(code, 14)


def normal(code: Column) -> Column:
    """Without spaces and hyphens; eleven digits get a leading 0."""
    c = F.regexp_replace(code, "[\\s-]", "")
    return F.when(c.rlike("^[0-9]{11}$"), F.concat(F.lit("0"), c)).otherwise(c)


def kind(code: Column) -> Column:
    """struct(type, isValid)."""
    of = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("isValid"))
    return (
        F.when(code.rlike("^[0-9]{12}$"), of("upc-a", upc_a(code))).when(code.rlike("^[0-9]{13}$"), of("ean-13", ean_13(code))).when(code.rlike("^[0-9]{14}$"), of("gtin-14", gtin_14(code)))
        .when(code.rlike("(?i)^[A-Z0-9-]{4,30}$"), of("sku", F.lit(True))).otherwise(of("unknown", F.lit(False)))
    )


def as_ean(code: Column) -> Column:
    return F.when(code.rlike("^[0-9]{12}$"), F.concat(F.lit("0"), code)).otherwise(code)

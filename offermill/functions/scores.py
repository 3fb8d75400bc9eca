"""Confidence, verification, price and deal scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numbers import half_up, lookup


def usd(price: Column, currency: Column) -> Column:
    return price * F.coalesce(lookup(fixed.USD_RATES, F.upper(currency)), F.lit(1.0))


def grams(value: Column, unit: Column) -> Column:
    return value * lookup(fixed.GRAMS, F.trim(F.lower(unit)))


def _part(test: Column, weight) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), weight if isinstance(weight, Column) else F.lit(weight)).otherwise(F.lit(0.0))


def _names_quantity(title: Column) -> Column:
    return title.rlike("(?i)\\d+\\s*(g|kg|mg|capsules|tablets)")


def _known(unit: Column) -> Column:
    return F.lower(unit).isin(fixed.KNOWN_UNITS)


def confidence(price: Column, quantity: Column, unit: Column, title: Column) -> Column:
    long = F.length(title) > 10
    return F.least(F.lit(1.0), _part(price > 0, 0.3) + _part(quantity > 0, 0.3) + _part(_known(unit), 0.2) + _part(long, 0.1) + _part(long & _names_quantity(title), 0.1))


def confidence_with_upc(price: Column, quantity: Column, unit: Column, title: Column, valid_upc: Column, matches: Column) -> Column:
    long = F.length(title) > 10
    total = _part(price > 0, 0.25) + _part(quantity > 0, 0.25) + _part(_known(unit), 0.15) + _part(long, 0.1) + _part(long & _names_quantity(title), 0.05) + _part(valid_upc, 0.15)
    total = total + _part(matches > 0, F.least(matches * F.lit(0.05), F.lit(0.15)))
    return F.least(total / F.lit(1.2), F.lit(1.0))


def verification(valid_upc: Column, sources: Column, matches: Column) -> Column:
    """sources: how many distinct ones the identifiers have."""
    return F.least(_part(valid_upc, 0.4) + _part(sources >= 2, 0.2) + _part(matches > 0, F.least(matches * F.lit(0.1), F.lit(0.4))), F.lit(1.0))


def per_unit(price: Column, quantity: Column, unit: Column) -> Column:
    """Per gram where the unit is a weight, else per unit as it is counted; null for quantity 0."""
    g = grams(quantity, unit)
    return F.when(g > 0, price / F.nullif(g, F.lit(0.0))).otherwise(F.try_divide(price, quantity))


def effective(per_unit_price: Column, shipping_cost: Column, quantity: Column) -> Column:
    """The price per unit with shipping spread over the raw quantity."""
    return per_unit_price + F.when((shipping_cost > 0) & (quantity != 0), shipping_cost / F.nullif(quantity, F.lit(0.0))).otherwise(0.0)


def deal(eff: Column, mean: Column, conf: Column, valid_upc: Column, matches: Column, free: Column, discount: Column, coupon: Column) -> Column:
    """Unrounded; a lower effective price is better, and what is known about the offer multiplies it."""
    below = F.try_divide(mean - eff, mean)
    times = lambda test, factor: F.when(F.coalesce(test, F.lit(False)), factor).otherwise(F.lit(1.0))
    score = F.lit(1.0) / (eff + F.lit(0.001))
    score = score * times(below > 0.2, F.lit(1.0) + below * F.lit(0.5)) * (F.lit(0.8) + conf * F.lit(0.4)) * times(valid_upc, F.lit(1.15))
    score = score * times(matches > 0, F.lit(1.0) + F.lit(0.05) * matches) * times(free, F.lit(1.05))
    return score * times(discount > 10, F.lit(1.0) + discount / F.lit(200.0)) * times(coupon, F.lit(1.05))


def discount_percent(original: Column, price: Column) -> Column:
    return F.when(original > price, half_up((original - price) / original * 100)).cast("long")


def solar_confidence(price: Column, structured: Column, wattage: Column, efficiency: Column, shipping_known: Column, brand: Column, product_data: Column) -> Column:
    return (
        _part(price > 0, F.when(structured, 0.3).otherwise(0.15)) + _part(wattage > 0, 0.25) + _part(efficiency.isNotNull(), 0.1)
        + _part(shipping_known, 0.15) + _part(brand.isNotNull() & (brand != ""), 0.1) + _part(product_data, 0.1)
    )

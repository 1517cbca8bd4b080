"""Fixed-point prices and quantities as LONG columns: grouping and equality are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a price of 1.
SCALE = 100_000_000


def price_units(price: Column) -> Column:
    return F.round(price * F.lit(SCALE)).cast("long")


def to_price(units: Column) -> Column:
    return units / F.lit(SCALE)


def floor_div(a: Column, b: Column | int) -> Column:
    """Euclidean division for a positive divisor: rounds down for negatives as well."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def floor_to_step(units: Column, step: int) -> Column:
    return units - F.pmod(units, F.lit(step))


def ceil_to_step(units: Column, step: int) -> Column:
    return units + F.pmod(-units, F.lit(step))


def round_to_step(units: Column, step: int) -> Column:
    """Nearest multiple of ``step``; halves go up, for negatives too."""
    return floor_to_step(units + F.lit(step // 2), step)


def round_to_side_step(units: Column, is_sell: Column, step: int) -> Column:
    """Sells and bids go down, buys and asks up."""
    return F.when(is_sell, floor_to_step(units, step)).otherwise(ceil_to_step(units, step))


def steps_between(low: Column, high: Column, step: int) -> Column:
    """Levels from ``low`` to ``high`` with both ends; null if the range is reversed."""
    return F.when(high >= low, floor_div(high - low, step) + 1)


def lots(qty: Column, least: int) -> Column:
    """Whole lots, halves away from zero."""
    half = F.lit(least // 2)
    return F.when(qty >= 0, floor_div(qty + half, least)).otherwise(-floor_div(-qty + half, least))


def notional(qty: Column, price: Column, in_quote: Column) -> Column:
    """Value in quote currency; inverse contracts hold it already."""
    return F.when(in_quote, qty).otherwise(qty * price)


def floor_time(ts_ms: Column, interval_ms: int) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(interval_ms))


def offset_time(ts_ms: Column, interval_ms: int, intervals: int) -> Column:
    return F.greatest(F.lit(0), ts_ms + F.lit(interval_ms * intervals))

"""Scalar rules on prices, flow and text: relations, gates, ramps, slippage, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def imbalance(buy: Column, sell: Column) -> Column:
    """(buy - sell) / (buy + sell), 0 for no volume."""
    return F.coalesce(F.try_divide((buy - sell).cast("double"), (buy + sell).cast("double")), F.lit(0.0))


def price_relation(price: Column, level: Column) -> Column:
    return F.when(level.isNull(), "unknown").when(price > level, "above").when(price < level, "below").otherwise("at")


def value_location(price: Column, high: Column, low: Column) -> Column:
    return F.when(high.isNull() | low.isNull(), "unknown").when(price > high, "above_value").when(price < low, "below_value").otherwise("in_value")


def funding_long_ok(rate: Column) -> Column:
    return F.coalesce(rate < 0.0008, F.lit(True))


def funding_short_ok(rate: Column) -> Column:
    return F.coalesce(rate > -0.0005, F.lit(True))


def basis_ok(basis: Column, is_long: Column) -> Column:
    return F.coalesce(F.when(is_long, basis < 0.5).otherwise(basis > -0.5), F.lit(True))


def ramp(value: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, held outside."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def nearest_round(price: Column, step: float) -> Column:
    return F.round(price / step) * step


def slippage_entry(price: Column, is_long: Column, bps: float) -> Column:
    return F.when(is_long, price * (1 + bps / 1e4)).otherwise(price * (1 - bps / 1e4))


def slippage_exit(price: Column, is_long: Column, bps: float) -> Column:
    return slippage_entry(price, ~is_long, bps)


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The name of the first gate whose condition fails; null if all pass. A null condition fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in gates])


def abbreviated(value: Column) -> Column:
    """1.23k, 4.56m, 7.89b."""
    size = F.abs(value)
    return (
        F.when(size >= 1e9, F.format_string("%.2fb", value / 1e9))
        .when(size >= 1e6, F.format_string("%.2fm", value / 1e6))
        .when(size >= 1e3, F.format_string("%.2fk", value / 1e3))
        .otherwise(F.format_string("%.2f", value))
    )


def duration_text(ms: Column) -> Column:
    """Largest two units: ``1d 2h``, ``3h 4m``, ``5m 6s``, ``7s``."""
    s = F.floor(ms / 1000)
    d, h, m = F.floor(s / 86_400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    return (
        F.when(d > 0, F.format_string("%dd %dh", d, h))
        .when(h > 0, F.format_string("%dh %dm", h, m))
        .when(m > 0, F.format_string("%dm %ds", m, s % 60))
        .otherwise(F.format_string("%ds", s))
    )

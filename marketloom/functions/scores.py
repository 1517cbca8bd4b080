"""Scalar rules of scores and context: units, bonuses, penalties, zones, biases and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = (1 << 63) - 1


def add_steps(units: Column, steps: Column, step: Column) -> Column:
    """``units`` moved by ``steps``; the move saturates, a sum beyond a long is null."""
    move = F.coalesce(F.try_multiply(steps, step), F.when((steps > 0) == (step > 0), F.lit(MOST)).otherwise(F.lit(-MOST)))
    return F.try_add(units, move)


def quantity(qty: Column, price: Column, inverse: Column, contract: Column, in_quote: Column) -> Column:
    """Quantity in base or quote currency; inverse contracts stay contracts unless the size is in quote."""
    sized = qty * F.coalesce(contract, F.lit(1.0))
    linear = F.when(in_quote, sized * price).otherwise(sized)
    return F.when(contract.isNotNull() & inverse, F.when(in_quote, sized).otherwise(qty)).otherwise(linear)


def raw_quantity(qty: Column, price: Column, unit: Column, inverse: Column, contract: Column, in_quote: Column) -> Column:
    """The same from a stated unit: ``base``, ``quote`` or ``contracts``; a price of zero counts as one where it divides."""
    safe, sized = F.when(price == 0, 1.0).otherwise(price), qty * F.coalesce(contract, F.lit(1.0))
    base = F.when(unit == "base", qty).when(unit == "quote", qty / safe).otherwise(F.when(inverse, sized / safe).otherwise(sized))
    quote = F.when(unit == "base", qty * price).when(unit == "quote", qty).otherwise(F.when(inverse, sized).otherwise(sized * price))
    return F.when(inverse | in_quote, quote).otherwise(base)


def wall_nearby(walls: Column, price: Column, atr: Column) -> Column:
    return (atr > 0) & F.exists(walls, lambda w: F.abs(w - price) <= atr)


def wall_bonus(bid_near: Column, ask_near: Column, is_long: Column) -> Column:
    return F.when(F.when(is_long, bid_near).otherwise(ask_near), 0.08).otherwise(0.0)


def reversals(closes: Column) -> Column:
    """Changes of direction between moves in a row."""
    moves = F.zip_with(F.slice(closes, 2, F.greatest(F.size(closes) - 1, F.lit(0))), closes, lambda b, a: b - a)
    turns = F.zip_with(F.slice(moves, 2, F.greatest(F.size(moves) - 1, F.lit(0))), moves, lambda b, a: (a * b < 0).cast("int"))
    return F.aggregate(turns, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def clean_bonus(turns: Column) -> Column:
    return F.when(turns <= 2, 0.05).otherwise(0.0)


def funding_penalty(rate: Column, is_long: Column) -> Column:
    against = F.when(is_long, rate).otherwise(-rate)
    return F.when(against > 0.0006, -0.20).when(against > 0.0003, -0.10).otherwise(0.0)


def aligned_bonus(aligned: Column) -> Column:
    return F.when(F.coalesce(aligned, F.lit(False)), 0.10).otherwise(0.0)


def toxic_reason(regime: Column, flow_live: Column, profile_live: Column, book_live: Column, spread: Column, most_spread: float, vpin: Column, most_vpin: float, spoofed: Column) -> Column:
    """The first reason not to trade, null if there is none; an unknown spread, VPIN or spoof is none."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(regime.isin("stress", "aftermath"), "blocked_regime").when(no(flow_live), "flow_not_live").when(no(profile_live), "profile_not_live")
        .when(no(book_live), "book_not_live").when(spread > most_spread, "spread_too_wide").when(vpin > most_vpin, "toxic_flow").when(spoofed, "spoofed")
    )


def zone(price: Column, low: Column, high: Column) -> Column:
    """The outer quarters of a swing range are premium and discount."""
    size = high - low
    known = F.when(price > low + size * 0.75, "premium").when(price < low + size * 0.25, "discount").otherwise("equilibrium")
    return F.when(size > 0, known).otherwise("unknown")


def effective_regime(regime: Column, fast_slope: Column) -> Column:
    """A trend whose last bars run hard the other way counts as the other trend."""
    return F.when((regime == "trend_up") & (fast_slope < -0.35), "trend_down").when((regime == "trend_down") & (fast_slope > 0.35), "trend_up").otherwise(regime)


def basis_pct(price: Column, spot: Column) -> Column:
    return F.when(spot > 0, (price / spot - 1) * 100)


def first_sided(*sides: Column) -> Column:
    """The first that names a side; else the last."""
    return F.coalesce(*[F.when(s.isin("bullish", "bearish", "bid", "ask"), s) for s in sides[:-1]], sides[-1])


def open_interest_multiplier(now: Column, hour_ago: Column) -> Column:
    change = F.when(hour_ago > 0, (now - hour_ago) / hour_ago * 100)
    return F.when(change > 0.1, 2.0).when(change < -0.1, 0.5).otherwise(1.0)


def bias_factor(weekly: Column, monthly: Column, is_long: Column) -> Column:
    """Score factor of the value locations of two wider profiles, null ones being unknown."""
    with_ = F.when(is_long, "above_value").otherwise("below_value")
    aligned = sum(F.coalesce((x == with_).cast("int"), F.lit(0)) for x in (weekly, monthly))
    against = sum(F.coalesce((x.isin("above_value", "below_value") & (x != with_)).cast("int"), F.lit(0)) for x in (weekly, monthly))
    return F.when((aligned > 0) & (against == 0), 1.08).when(aligned > 0, 1.03).when(against > 0, 0.90).otherwise(1.0)


def opening_bias(open_: Column, value_low: Column, value_high: Column, low: Column, high: Column, accepted: Column) -> Column:
    """Where a session opens against the one before: inside value, outside value within its range, or a gap."""
    inside = (open_ >= value_low) & (open_ <= value_high)
    within = (open_ > low) & (open_ < high)
    return F.when(inside, "inside_value").when(accepted, "fade_gap").when(within, "outside_value").otherwise("trend_day")


def crowd_divergence(top: Column, retail: Column) -> Column:
    """What large and retail accounts' long shares say together; a missing share is one half."""
    t, r = F.coalesce(top, F.lit(0.5)), F.coalesce(retail, F.lit(0.5))
    near = (F.abs(t - 0.5) < 0.10) & (F.abs(r - 0.5) < 0.10)
    return F.when(r - t > 0.15, "smart_short_retail_long").when(r - t < -0.15, "smart_long_retail_short").when(near, "neutral").otherwise("aligned")


def percent_text(change: Column) -> Column:
    return F.when(change > 0, F.format_string("+%.2f%%", change)).otherwise(F.format_string("%.2f%%", change))


def utc_text(ms: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Needs a session in UTC."""
    return F.date_format(F.timestamp_millis(ms), form)


def market_parts(name: Column) -> tuple[Column, Column]:
    """Venue and kind of ``VenueLinear``, ``Venue Spot``: the kind is lower case, null where there is none."""
    kind = F.regexp_extract(name, r"(Linear|Inverse|Spot)$", 1)
    return F.trim(F.regexp_replace(name, r"\s*(Linear|Inverse|Spot)$", "")), F.when(kind != "", F.lower(kind))


def display_symbol(symbol: Column, shown: Column, bare: Column) -> Column:
    """The symbol as shown: its own display form, else with the quote currency where the venue leaves it out."""
    return F.coalesce(shown, F.when(bare, F.concat(symbol, F.lit("USDT"))).otherwise(symbol))

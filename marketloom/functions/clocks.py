"""Trading-session clocks on epoch milliseconds, UTC. The clocks differ and stay separate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
HOUR = 3_600_000
MINUTE = 60_000


def minute_of_day(ts_ms: Column) -> Column:
    return F.floor(F.pmod(ts_ms, F.lit(DAY)) / MINUTE).cast("int")


def day(ts_ms: Column) -> Column:
    return F.floor(ts_ms / DAY).cast("long")


def weekday(ts_ms: Column) -> Column:
    """Days since Monday."""
    return F.pmod(day(ts_ms) + 3, F.lit(7)).cast("int")


def week_start(ts_ms: Column) -> Column:
    return (day(ts_ms) - weekday(ts_ms)) * F.lit(DAY)


def region(ts_ms: Column) -> Column:
    """One region at a time: the London and New York overlap comes before each of them."""
    m = minute_of_day(ts_ms)
    return (
        F.when((m >= 13 * 60) & (m < 16 * 60), "overlap")
        .when((m >= 13 * 60) & (m < 21 * 60), "new_york")
        .when((m >= 8 * 60) & (m < 16 * 60), "london")
        .when(m < 8 * 60, "asia")
        .otherwise("off_hours")
    )


def kill_zone(ts_ms: Column) -> Column:
    h = F.floor(minute_of_day(ts_ms) / 60)
    return (
        F.when(h < 2, "asia")
        .when(h < 5, "london_zone")
        .when(h < 7, "london")
        .when(h < 10, "new_york_zone")
        .when(h < 20, "new_york")
        .otherwise("off")
    )


#: First and end hour of sessions that may overlap.
SESSIONS = {"asia": (0, 8), "london": (8, 16), "new_york": (13, 21)}


def in_session(ts_ms: Column, name: str) -> Column:
    first, end = SESSIONS[name]
    m = minute_of_day(ts_ms)
    return (m >= first * 60) & (m < end * 60)

"""Periods, calendar slots and elapsed time. Nothing here reads the clock."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_PER_UNIT = {"hour": 1, "day": 24, "week": 24 * 7, "month": 24 * 30}
UNIT_OF_LETTER = {"h": "hour", "d": "day", "w": "week"}
DEFAULT_PERIOD_DAYS = 30.0


def instant(as_of: str | date | datetime | Column) -> Column:
    """A foldable timestamp literal, so period filters reach the parquet scan."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def parse_period(text: str) -> float:
    """Days in a phrase such as ``last 30 days``, ``12 hours``, ``last_7d``, ``2 weeks``.

    The first number anywhere counts and defaults to 1; an unknown unit means 30 days.
    """
    lowered = text.lower()
    number = re.search(r"\d+", lowered)
    count = int(number.group()) if number else 1
    for unit, hours in HOURS_PER_UNIT.items():
        if unit in lowered:
            return count * hours / 24
    short = re.search(r"\d+\s*([hdw])\b", lowered)
    if short:
        return count * HOURS_PER_UNIT[UNIT_OF_LETTER[short.group(1)]] / 24
    return DEFAULT_PERIOD_DAYS


def period_days(period: str | float) -> float:
    return parse_period(period) if isinstance(period, str) else float(period)


def days_before(as_of, days: float) -> Column:
    seconds = round(days * 86400)
    return instant(as_of) - F.expr(f"INTERVAL '{seconds}' SECOND")


def in_period(ts: str | Column, as_of, period: str | float) -> Column:
    """``as_of - period <= ts < as_of``, the one period rule used everywhere."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return (column >= days_before(as_of, period_days(period))) & (column < instant(as_of))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour units between two timestamps, rounded down."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("int")


def bucket_start(ts: Column, grain: str) -> Column:
    """Start of the hourly / daily / weekly / monthly bucket; weeks begin on Sunday."""
    if grain == "hourly":
        return F.date_trunc("hour", ts)
    if grain == "weekly":
        day = F.expr("INTERVAL 1 DAY")
        return F.date_trunc("week", ts + day) - day
    if grain == "monthly":
        return F.date_trunc("month", ts)
    return F.date_trunc("day", ts)


def seasonal_slot(ts: Column, pattern: str) -> Column:
    """Slots of the seasonal index: day of month, ISO weekday (1-7) or month."""
    slots = {"daily": F.dayofmonth(ts), "weekly": F.weekday(ts) + 1, "monthly": F.month(ts)}
    if pattern not in slots:
        raise ValueError(f"unknown seasonal pattern: {pattern}")
    return slots[pattern].cast("int")


def pattern_slot(ts: Column, pattern: str) -> Column:
    """Slots of the pattern detector: hour, weekday (Monday 0) or day of month."""
    slots = {"daily": F.hour(ts), "weekly": F.weekday(ts), "monthly": F.dayofmonth(ts)}
    if pattern not in slots:
        raise ValueError(f"unknown pattern: {pattern}")
    return slots[pattern].cast("int")

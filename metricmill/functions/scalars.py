"""Scalar helpers for text, money and scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricmill.schemas import EFFORT_LEVEL, IMPACT_LEVEL, URGENCY_LEVEL, lookup

WEIGHTS = {"confidence": 0.3, "impact": 0.3, "urgency": 0.25, "effort": 0.15}


def composite_score(
    confidence: Column, impact: Column, urgency: Column, effort: Column, weights: Mapping[str, float] | None = None
) -> Column:
    """Weighted score; an unknown label counts as level 2. Not rounded."""
    w = {**WEIGHTS, **(weights or {})}
    return (
        confidence * w["confidence"]
        + lookup(IMPACT_LEVEL, impact, 2) / 3 * w["impact"]
        + lookup(URGENCY_LEVEL, urgency, 2) / 4 * w["urgency"]
        + lookup(EFFORT_LEVEL, effort, 2) / 3 * w["effort"]
    )


def shortened(text: Column, limit: int = 500) -> Column:
    """Text of at most ``limit`` characters, the cut marked by three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def first_json(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def rupiah(amount: Column) -> Column:
    """Whole amounts with dots between thousands: Rp12.500."""
    return F.concat(F.lit("Rp"), F.translate(F.format_number(amount, 0), ",", "."))


def rupiah_short(amount: Column) -> Column:
    """Billions and millions with one decimal and a suffix, smaller amounts in full."""
    return (
        F.when(amount >= 1_000_000_000, F.format_string("Rp%.1fB", amount / 1_000_000_000))
        .when(amount >= 1_000_000, F.format_string("Rp%.1fM", amount / 1_000_000))
        .otherwise(rupiah(amount))
    )


def fixed_id(prefix: str, content: Column, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(content), 1, digits))

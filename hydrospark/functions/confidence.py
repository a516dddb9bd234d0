"""Confidence values and the reasons behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISCLAIMER = "Relative satellite indicators for decision support, no laboratory measurements. Sampling and laboratory verification are required before any decision."


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


def reasons(*parts: Column) -> Column:
    """The distinct reasons of all arrays in the order in which they come first; empty ones and nulls drop out."""
    all_ = F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))
    return F.array_distinct(F.filter(all_, lambda x: F.coalesce(x, F.lit("")) != ""))


def merged(*parts: tuple[Column, Column]) -> Column:
    """The least of 1 and all clamped values, and the reasons of all parts."""
    value = F.least(F.lit(1.0), F.lit(1.0), *(clamp(v) for v, _ in parts))
    return F.struct(value.alias("confidence"), reasons(*(r for _, r in parts)).alias("reasons"))


def stamp(confidence: Column, why: Column, disclaimer: str = DISCLAIMER) -> Column:
    """What every published row bears."""
    return F.struct(clamp(confidence).alias("confidence"), reasons(why).alias("confidence_reasons"), F.lit(True).alias("lab_verification_required"), F.lit(disclaimer).alias("disclaimer"))

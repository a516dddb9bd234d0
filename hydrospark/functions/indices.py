"""Per-pixel indices, masks and scores as column expressions; NULL stands for what has no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HIDDEN_CLASSES


def finite(c: Column) -> Column:
    """True for a number; false for NULL, NaN and infinities."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def valid_pixel(scl: Column) -> Column:
    return ~F.coalesce(scl, F.lit(0)).isin(*HIDDEN_CLASSES)


def normalised_difference(a: Column, b: Column) -> Column:
    """(a-b)/(a+b); NULL where the sum is 0."""
    return F.try_divide(a - b, a + b)


def safe_difference(a: Column, b: Column) -> Column:
    """The history path's form: 0 where the quotient isn't finite."""
    d = normalised_difference(a, b)
    return F.when(finite(d), d).otherwise(0.0)


def is_water(green: Column, nir: Column, threshold: float = 0.0) -> Column:
    index = normalised_difference(green, nir)
    return finite(index) & (index > threshold)


def transparency(blue: Column, green: Column) -> Column:
    return F.try_divide(blue, green)


def chlorophyll(red: Column, edge1: Column, edge2: Column) -> Column:
    """Three-band form (1/red - 1/edge1) * edge2."""
    return (F.try_divide(F.lit(1.0), red) - F.try_divide(F.lit(1.0), edge1)) * edge2


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """NULL without a deviation; 0 or infinity where it is 0 or less."""
    flat = F.when(value == mean, 0.0).otherwise(float("inf"))
    return F.when(std.isNull(), None).when(std <= 0, flat).otherwise((value - mean) / F.when(std > 0, std))


def severity_label(sigma: Column) -> Column:
    return F.when(sigma > 5, "severe").when(sigma > 4, "warning").otherwise("watch")


def normalised_severity(sigma: Column, cap: float) -> Column:
    return F.when(~finite(sigma), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sigma / (cap if cap > 0 else 1.0))))


def season_of(day: Column) -> Column:
    """Season of a yyyyMMdd text; any month that isn't in the first three seasons is autumn."""
    m = F.substring(day, 5, 2)
    return F.when(m.isin("12", "01", "02"), "DJF").when(m.isin("03", "04", "05"), "MAM").when(m.isin("06", "07", "08"), "JJA").otherwise("SON")


def falloff(distance_m: Column, scale_m: float) -> Column:
    return F.when(distance_m.isNull(), 0.0).otherwise(1.0 / (1.0 + distance_m / (scale_m if scale_m > 0 else 1.0)))


def history_score(value: Column, mean: Column, std: Column, high: float = 3.2, warning: float = 2.0) -> Column:
    """(status, score, confidence, sigma) of the history path: the score has two sides, the status one; its cuts are parameters."""
    d = (value - mean) / F.when(std > 0, std)
    score = F.when(d.isNotNull(), F.least(F.lit(100.0), F.abs(d) / 4 * 100)).cast("int")  # bounded before the cast, which would overflow; null is no bound
    status = F.when(d > high, "HIGH").when(d > warning, "WARNING").otherwise("NORMAL")
    return F.struct(
        F.when(d.isNull(), "NORMAL").otherwise(status).alias("status"), F.coalesce(score, F.lit(0)).alias("score"),
        F.when(d.isNull(), 0.0).otherwise(F.bround(F.least(F.lit(1.0), F.abs(d) / 5), 2)).alias("confidence"), F.bround(d, 2).alias("sigma"),
    )


def history_priority(score: Column, days: Column, proximity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.5 * score + 10 * days + 20 * proximity)).cast("int")


def pixel_area(width: Column, height: Column, lat: Column, geographic: Column) -> Column:
    """Square metres of a pixel; degrees are scaled by the latitude, and what is within 1 of 100 is 100."""
    degrees = geographic | (F.abs(width) < 1)
    metre = F.lit(111_320.0)
    area = F.when(degrees, F.abs(width * metre * F.cos(F.radians(lat)) * height * metre)).otherwise(F.abs(width * height))
    return F.when(F.abs(area - 100) < 1, 100.0).otherwise(area)

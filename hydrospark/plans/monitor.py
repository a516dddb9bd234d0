"""The monitoring plan: observations, baselines, scores, evidence and ranking, for all bodies and dates at once; what-ifs are separate steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators import scoring
from ..operators.places import least_metres
from ..operators.scenes import zone_observations
from ..sources.shared import small, written


def observed(pixels: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Zone observations, written once: a few rows per scene, from which all later steps start, so pixels are read once."""
    return written(zone_observations(pixels, s), "observations")


def compared(observations: DataFrame, s: Settings = DEFAULTS, adjustments: DataFrame | None = None) -> DataFrame:
    base = scoring.adjusted(scoring.fit_baselines(observations), adjustments)
    return scoring.compare(scoring.with_baseline(observations, base), s)


def distances(zones: DataFrame, intakes: DataFrame, settlements: DataFrame) -> DataFrame:
    """Metres from each zone's centre to the nearest intake and settlement of its body; a point without owner counts for all bodies; none: null."""
    key = ["body_id", "zone_id"]
    points = [p.select(F.lit(kind).alias("kind"), "owner", "lon", "lat") for kind, p in (("intake", intakes), ("settlement", settlements))]
    spots = written(zones.select(*key, F.col("body_id").alias("owner"), "lon", "lat"), "spots")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("metres"))).alias(f"{kind}_m")
    near = least_metres(spots, points[0].unionByName(points[1]), key).groupBy(*key).agg(of("intake"), of("settlement"))
    return spots.select(*key).join(near, key, "left")


def priority(scores: DataFrame, zones: DataFrame, intakes: DataFrame, settlements: DataFrame, bumps: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Ranked flagged zones of every (body, date) of `scores`, with persistence over all its dates."""
    return scoring.rank_zones(scores, scoring.persistence(scores), distances(zones, intakes, settlements), bumps, s)


def intensified(pixels: DataFrame, dates: DataFrame, band: str = "b04", factor: float = 3.0) -> DataFrame:
    """The pixels of some scenes with one band multiplied."""
    return pixels.join(small(dates.select("body_id", "date")), ["body_id", "date"], "left_semi").withColumn(band, F.col(band) * factor)


#: The band that drives each indicator of a plume; fixed values.
DRIVING = {"turbidity": "b04", "transparency": "b02", "chlorophyll": "b05"}


def pixel_of(lon: Column, lat: Column, a: Column | float, e: Column | float, c: Column | float, f: Column | float, height: Column | int, width: Column | int) -> Column:
    """(row, col) of a place on a grid; outside: null."""
    row, col = F.floor((lat - f) / e), F.floor((lon - c) / a)
    return F.when(row.between(0, height - 1) & col.between(0, width - 1), F.struct(row.cast("int").alias("row"), col.cast("int").alias("col")))


def radius_in_pixels(metres: float, width: float, lat: float) -> float:
    """A radius in pixels; widths below 1 are degrees."""
    import math

    size = abs(width) * 111_320.0 * math.cos(math.radians(lat)) if abs(width) < 1 else abs(width)
    return metres / size if size else 1.0


def with_plume(pixels: DataFrame, indicator: str, row: float, col: float, radius: float, magnitude: float) -> DataFrame:
    """Adds magnitude * clip(1 - distance / radius) to the band that drives the indicator; a radius of 0 or less changes nothing."""
    if radius <= 0:
        return pixels
    d = F.sqrt((F.col("row") - row) ** 2 + (F.col("col") - col) ** 2)
    band = DRIVING[indicator]
    return pixels.withColumn(band, F.col(band) + magnitude * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / radius)))


def plume_scores(pixels: DataFrame, baselines: DataFrame, indicator: str, row: float, col: float, radius: float, magnitude: float, s: Settings = DEFAULTS) -> DataFrame:
    """Zone scores of altered scenes against baselines of the real ones; synthetic_plume joins the reasons."""
    now = zone_observations(with_plume(pixels, indicator, row, col, radius, magnitude), s)
    x = scoring.zone_scores(scoring.compare(scoring.with_baseline(now, baselines), s), s)
    return x.withColumn("reasons", F.array_distinct(F.concat("reasons", F.array(F.lit("synthetic_plume")))))

"""From pixels to gates, extent and zone observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.indices import chlorophyll, finite, is_water, transparency, valid_pixel

SCENE = ("body_id", "date")


def masked(pixels: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds valid and water (valid, inside and of a positive index)."""
    valid = valid_pixel(F.col("scl"))
    return pixels.withColumn("valid", valid).withColumn("water", valid & F.col("inside") & is_water(F.col("b03"), F.col("b08"), s.ndwi_threshold))


def _counts() -> list:
    """Counts of masked pixels that gates are made of."""
    inside = F.col("inside")
    seen = F.col("valid") & inside
    return [
        F.count(F.lit(1)).alias("n"), F.sum(seen.cast("long")).alias("ok"), F.count(seen).alias("told"), F.count_if(inside).alias("n_inside"), F.sum(F.col("water").cast("long")).alias("water_pixels"),
    ]


def gates_of(counts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The gates from counts by scene, or by scene and zone as `zone_sums` gives them."""
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    g = counts.groupBy(*SCENE).agg(F.sum("n").alias("pixels"), share("ok", "told").alias("valid_fraction"), share("ok", "n_inside").alias("aoi_fraction"), F.sum("water_pixels").alias("water_pixels"))
    low = F.col("valid_fraction") < s.grid_minimum
    return g.withColumns({
        "status": F.when(low, "insufficient_data").otherwise("ok"), "reason": F.when(low, F.format_string("valid_fraction:%.3f", "valid_fraction")),
        "aoi_usable": F.col("aoi_fraction") >= s.aoi_minimum, "extent_m2": F.col("water_pixels") * s.pixel_area, "extent_ha": F.col("water_pixels") * s.pixel_area / 10_000,
    })


def scene_gates(pixels: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row per scene: the share of valid pixels of the grid and of the area, both verdicts and the reason."""
    return gates_of(masked(pixels, s).groupBy(*SCENE).agg(*_counts()), s)


def agreement(pixels: DataFrame, model: str, s: Settings = DEFAULTS) -> DataFrame:
    """Per scene, how far a model's mask (a boolean column) and the index mask agree on valid pixels."""
    m = masked(pixels, s).withColumn("index_mask", is_water(F.col("b03"), F.col("b08"), s.ndwi_threshold))
    same = F.avg(F.when(F.col("valid"), (F.col(model) == F.col("index_mask")).cast("double")))
    out = m.groupBy(*SCENE).agg(F.coalesce(same, F.lit(0.0)).alias("agreement"), F.coalesce(1 - same, F.lit(1.0)).alias("disagreement"))
    return out.withColumn("low_agreement", F.col("agreement") < s.agreement_minimum).withColumn("low_confidence", F.col("disagreement") > s.disagreement_limit)


def zone_sums(pixels: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """A few rows per scene, one for each zone and one for what lies in none: all that gates and observations need of the pixels. Written, it serves both and the pixels are read once."""
    m = masked(pixels, s).withColumns({"transparency": transparency(F.col("b02"), F.col("b03")), "chlorophyll": chlorophyll(F.col("b04"), F.col("b05"), F.col("b06"))})
    wet = lambda c: F.avg(F.when(F.col("water") & finite(F.col(c).cast("double")), F.col(c)))
    by = m.groupBy(*SCENE, "zone_id").agg(*_counts(), wet("b04").alias("turbidity"), wet("transparency").alias("transparency"), wet("chlorophyll").alias("chlorophyll"))
    return by.withColumn("extent", F.col("water_pixels") * s.pixel_area)


def observations_of(sums: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The observations from the sums by scene and zone."""
    gate = sums.groupBy(*SCENE).agg((F.sum("ok") / F.sum("n") >= s.grid_minimum).alias("pass")).filter("pass")
    wide = sums.filter("zone_id IS NOT NULL").join(gate.select(*SCENE), list(SCENE), "left_semi")
    long = wide.unpivot(["body_id", "zone_id", "date"], ["extent", "turbidity", "transparency", "chlorophyll"], "indicator", "value")
    return long.filter("value IS NOT NULL")


def zone_observations(pixels: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(body, zone, indicator, date, value), means of finite values, of all scenes that pass the grid gate; extent is there for a zone without water, too."""
    return observations_of(zone_sums(pixels, s), s)

"""Documented variants: rolling and monthly baselines, index classes, confidence bands, water by colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import normalised_difference

# Cuts of the index classes and of the confidence bands, and the colour rule.
TURBID, VERY_TURBID = 0.10, 0.25
BLOOM_NDCI, BLOOM_NDWI, EUTROPHIC_NDCI = 0.15, 0.30, 0.10
BAND_HIGH, BAND_LOW = 0.8, 0.6
COLOUR_CUT, BRIGHTEST, REDDEST, COLOUR_SHARE = -0.04, 165, 118, 0.06


def rolling_baselines(history: DataFrame, days: int = 90) -> DataFrame:
    """Adds mean, std and samples over the `days` days before each row's day.

    Days are summed first, on the map side, so the window runs over days and not over a body's rows; it then joins the rows again.
    """
    centre = history.groupBy("body_id").agg(F.coalesce(F.avg("ndti"), F.lit(0.0)).alias("centre"))  # sums of squares lose their digits far from 0
    x = history.join(centre, "body_id").withColumn("x", F.col("ndti") - F.col("centre"))
    by_day = x.groupBy("body_id", "day", "centre").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    w = Window.partitionBy("body_id").orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    d = by_day.select("body_id", "day", "centre", *(F.sum(c).over(w).alias(c) for c in ("n", "s", "ss")))
    spread = F.greatest(F.lit(0.0), F.try_divide(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1))
    std = F.when(F.col("n") > 1, F.sqrt(spread))
    d = d.select("body_id", "day", (F.col("centre") + F.try_divide("s", "n")).alias("mean"), std.alias("std"), F.coalesce("n", F.lit(0)).alias("samples"))
    return history.join(d, ["body_id", "day"])


def month_baselines(history: DataFrame) -> DataFrame:
    """Per body and month: mean, std and count over that month and its two neighbours, of all years."""
    m = F.month("day")
    around = F.explode(F.array((m + 10) % 12 + 1, m, m % 12 + 1))
    return history.select("body_id", "ndti", around.alias("month")).groupBy("body_id", "month").agg(F.avg("ndti").alias("mean"), F.stddev_samp("ndti").alias("std"), F.count("ndti").alias("samples"))


def index_classes() -> dict[str, Column]:
    """Absolute classes of a pixel from its bands."""
    nd = lambda a, b: normalised_difference(F.col(a), F.col(b))
    ndti, ndci, ndwi = nd("b04", "b03"), nd("b05", "b04"), nd("b03", "b08")
    return {
        "very_turbid": ndti > VERY_TURBID, "turbid": (ndti > TURBID) & (ndti <= VERY_TURBID),
        "bloom": (ndci > BLOOM_NDCI) & (ndwi > BLOOM_NDWI), "eutrophic": ndci > EUTROPHIC_NDCI,
    }


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence > BAND_HIGH, "high").when(confidence >= BAND_LOW, "medium").otherwise("low")


def water_by_colour(red: Column, green: Column, blue: Column) -> Column:
    return ((blue - red) / (blue + red + 1) > COLOUR_CUT) & ((red + green + blue) / 3 < BRIGHTEST) & (red < REDDEST)

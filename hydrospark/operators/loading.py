"""Scenes as they are loaded: statuses, stand-ins for missing bands, crops, pixel centres, extent batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.indices import finite, is_water, valid_pixel

SCENE = ["body_id", "date"]
REFERENCE = ("b02", "b03", "b04", "b08")


def valid_body_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[a-z0-9][a-z0-9-]*\z"), F.lit(False))


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A\d{8}\z"), F.lit(False))


def load_status(configured: DataFrame, bands: DataFrame, required: tuple[str, ...], folders: DataFrame | None = None) -> DataFrame:
    """(body, date, status, reason) of configured scenes from the bands (body, date, band) that are there, and the scene folders (body, date); without a list of these, a folder is where a band is.

    missing: no folder. incomplete: no reference band, or one of the required ones lacks. Else ok; `empty_aoi` comes from the pixels.
    """
    have = bands.groupBy(*SCENE).agg(F.collect_set("band").alias("have"))
    there = (folders if folders is not None else bands).select(*SCENE).distinct().withColumn("there", F.lit(True))
    x = configured.select(*SCENE).distinct().join(there, SCENE, "left").join(have, SCENE, "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    x = x.withColumn("gone", F.array_except(F.array(*map(F.lit, required)), "have"))
    absent, reference = F.col("there").isNull(), F.arrays_overlap("have", F.array(*map(F.lit, REFERENCE)))
    status = F.when(absent, "missing").when(~reference | (F.size("gone") > 0), "incomplete").otherwise("ok")
    reason = F.when(absent, "scene_folder_missing").when(~reference, "missing_reference_band").when(F.size("gone") > 0, F.concat(F.lit("missing_bands:"), F.array_join("gone", ",")))
    return x.select(*SCENE, status.alias("status"), reason.alias("reason"))


def empty_areas(statuses: DataFrame, pixels: DataFrame) -> DataFrame:
    """Scenes without a finite blue pixel inside the boundary become empty_aoi; an earlier reason stays."""
    seen = pixels.filter(F.col("inside") & finite(F.col("b02").cast("double"))).select(*SCENE).distinct().withColumn("seen", F.lit(True))
    empty = F.col("status").isin("ok", "incomplete") & F.col("seen").isNull()
    x = statuses.join(seen, SCENE, "left")
    return x.select(*SCENE, F.when(empty, "empty_aoi").otherwise(F.col("status")).alias("status"), F.when(empty, F.coalesce("reason", F.lit("aoi_outside_scene"))).otherwise(F.col("reason")).alias("reason"))


def filled(pixels: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """Missing reflectances become NaN, a missing scene class 0."""
    return pixels.withColumns({b: F.coalesce(F.col(b).cast("double"), F.lit(float("nan"))) for b in bands} | {"scl": F.coalesce("scl", F.lit(0))})


def scene_status(asked: DataFrame, bodies: DataFrame, scenes: DataFrame, gates: DataFrame, scores: DataFrame) -> DataFrame:
    """(body, date, status, reason) of asked scenes: the first rule that holds of unknown body or bad date, missing, missing bands, gate, no baseline, ok.

    `scenes` has the missing bands of each scene folder, `gates` the status and reason of its pixels, `scores` its scored zones.
    """
    known, scored = bodies.select("body_id", F.lit(True).alias("known")), scores.select(*SCENE).distinct().withColumn("scored", F.lit(True))
    gate = gates.select(*SCENE, F.col("status").alias("gate"), F.col("reason").alias("why"))
    x = asked.join(known, "body_id", "left").join(scenes.select(*SCENE, "missing"), SCENE, "left").join(gate, SCENE, "left").join(scored, SCENE, "left")
    bad = F.col("known").isNull() | ~valid_date(F.col("date"))
    lacks = F.size("missing") > 0
    no_base = F.col("gate").isNotNull() & F.col("scored").isNull()
    status = F.when(bad, "unusable").when(F.col("missing").isNull(), "missing").when(lacks, "unusable").when(F.col("gate") != "ok", F.col("gate")).when(no_base, "no_baseline").otherwise("ok")
    reason = F.when(bad, "unknown_water_body_or_date").when(F.col("missing").isNull(), "scene_folder_missing").when(lacks, F.concat(F.lit("missing_bands:"), F.array_join("missing", ",")))
    reason = reason.when(F.col("gate") != "ok", F.col("why")).when(no_base, "missing_baseline")
    return x.select(*SCENE, status.alias("status"), reason.alias("reason"))


def centres(pixels: DataFrame, a: float, e: float, c: float, f: float) -> DataFrame:
    """Adds x and y of the pixels' centres."""
    return pixels.withColumns({"x": c + (F.col("col") + 0.5) * a, "y": f + (F.col("row") + 0.5) * e})


def crop(pixels: DataFrame) -> DataFrame:
    """The rows and columns of each scene that hold a pixel inside, counted anew from the first one kept.

    A scene's kept rows and columns are tables of their own that pixels meet in two semi joins on (scene, row) and (scene, col), however many they are.
    """
    inside = pixels.filter("inside")
    first = inside.groupBy(*SCENE).agg(F.min("row").alias("row0"), F.min("col").alias("col0"))
    x = pixels.join(inside.select(*SCENE, "row").distinct(), [*SCENE, "row"], "left_semi").join(inside.select(*SCENE, "col").distinct(), [*SCENE, "col"], "left_semi").join(first, SCENE)
    return x.withColumns({"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")}).select(*pixels.columns)


def scaled(pixels: DataFrame, bands: tuple[str, ...], limit: float = 2.0, divisor: float = 10_000.0, share: float = 0.99) -> DataFrame:
    """Bands of a scene whose `share` quantile over all finite values of them is above `limit` are divided; what isn't finite stays as it is. A scene without any finite value is all 0.

    Whether the quantile is above the limit follows from how many values there are and how many are at most `limit`; only where the cut falls between the two that
    enclose the quantile are these needed: the largest at most `limit` and the smallest above it. Counts, a maximum and a minimum are all that a scene's pixels leave behind.
    """
    v = {b: F.col(b).cast("double") for b in bands}
    fine = {b: F.when(finite(v[b]), v[b]) for b in bands}
    total = lambda test: sum((F.count(F.when(test(c), 1)) for c in fine.values()), F.lit(0))
    below, above = ([f(F.when(test(c), c)) for c in fine.values()] for f, test in ((F.max, lambda c: c <= limit), (F.min, lambda c: c > limit)))
    least = lambda f, some: f(*some) if len(some) > 1 else some[0]
    g = pixels.groupBy(*SCENE).agg(total(lambda c: c.isNotNull()).alias("n"), total(lambda c: c <= limit).alias("under"), least(F.greatest, below).alias("below"), least(F.least, above).alias("above"))
    at = (F.col("n") - 1) * share
    low = F.floor(at)
    between = F.col("below") + (at - low) * (F.col("above") - F.col("below")) > limit
    high = F.when(F.col("under") <= low, True).when(F.col("under") == low + 1, F.coalesce(between, F.lit(False))).otherwise(False)
    by = g.select(*SCENE, F.when(F.col("n") == 0, 0.0).when(high, 1 / divisor).otherwise(1.0).alias("by"))
    scale = lambda c: F.when(F.col("by") == 0, 0.0).when(F.col("by") == 1, c).otherwise(c / divisor)
    return pixels.join(by, SCENE).withColumns({b: scale(c) for b, c in v.items()}).select(*pixels.columns)


def final_mask(model: Column, index: Column, valid: Column) -> Column:
    """The model's mask where there is one, else the index mask; valid pixels only."""
    return F.coalesce(model, index) & valid


def mask_confidence(has_model: Column, agreement: Column, s: Settings = DEFAULTS, no_model: float = 0.55, low: float = 0.6) -> Column:
    """(confidence, reasons) of a scene's mask."""
    why = F.when(~has_model, F.array(F.lit("segmentation_model_unavailable"))).when(agreement < s.agreement_minimum, F.array(F.lit("model_agreement"))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(~has_model, no_model).when(agreement < s.agreement_minimum, low).otherwise(1.0).alias("confidence"), why.alias("reasons"))


def mask_rows(pixels: DataFrame, model: str, s: Settings = DEFAULTS) -> DataFrame:
    """(body, date, row, col, water) for a table of masks."""
    index = is_water(F.col("b03"), F.col("b08"), s.ndwi_threshold)
    return pixels.select(*SCENE, "row", "col", final_mask(F.col(model), index, valid_pixel(F.col("scl"))).alias("water"))


def extent_batch(statuses: DataFrame, pixels: DataFrame, model: str, s: Settings = DEFAULTS) -> DataFrame:
    """One row per configured scene: status (load status, insufficient_data, low_confidence or ok), shares and extent, by body and date.

    The area is where green is finite. Scenes that didn't load keep their status and have no figures; pixels are summed in one pass.
    """
    aoi, valid = finite(F.col("b03").cast("double")), valid_pixel(F.col("scl"))
    good, index, m = aoi & valid, is_water(F.col("b03"), F.col("b08"), s.ndwi_threshold), F.col(model)
    g = pixels.groupBy(*SCENE).agg(F.count_if(aoi).alias("area"), F.count_if(good).alias("good"), F.count_if(good & (m != index)).alias("differ"), F.count_if(good & m).alias("water"))
    x = statuses.join(g, SCENE, "left")
    loaded = F.col("status") == "ok"
    share = F.when(loaded, F.coalesce(F.try_divide("good", "area"), F.lit(0.0)))
    usable = loaded & (share >= s.aoi_minimum)
    differ = F.when(usable, F.coalesce(F.try_divide("differ", "good"), F.lit(1.0)))
    low = differ > s.disagreement_limit
    pixels_ = F.when(usable, F.coalesce("water", F.lit(0)))
    return x.select(
        *SCENE, F.when(loaded & ~usable, "insufficient_data").when(low, "low_confidence").otherwise(F.col("status")).alias("status"), share.alias("valid_fraction"), differ.alias("disagreement_fraction"),
        F.coalesce(low, F.lit(False)).alias("low_confidence"), pixels_.alias("water_pixels"), (pixels_ * s.pixel_area).alias("extent_m2"), (pixels_ * s.pixel_area / 10_000).alias("extent_ha"),
    ).orderBy(*SCENE)


def not_computed(scenes: DataFrame, done: DataFrame) -> DataFrame:
    """Scenes whose (body, date, scene_hash) hasn't been computed yet."""
    return scenes.join(done.select(*SCENE, "scene_hash"), [*SCENE, "scene_hash"], "left_anti")

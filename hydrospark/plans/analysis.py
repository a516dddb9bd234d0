"""Asked scenes analysed as one plan: statuses, confidence, zones. What has been computed for a scene's files is read from the product store; pixels are read of the others only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULTS, Settings
from ..functions.confidence import merged
from ..operators import inventory, scenes, scoring
from ..operators.loading import mask_confidence, not_computed, valid_date
from ..sources.shared import small, written

SCENE = ["body_id", "date"]
KEY = [*SCENE, "scene_hash"]
_SCENES = "extent_m2 double, gate string, why string, mask_confidence double, mask_reasons array<string>, body_id string, date string, scene_hash string"
_PRODUCTS = "zone_id string, indicator string, value double, body_id string, date string, scene_hash string"


def write_pixels(pixels: DataFrame, path: str, files: int = 8) -> None:
    """The pixel table: partitions by body and date, each in up to `files` files, so that a large scene isn't one task's. What was there is replaced."""
    pixels.repartition(*SCENE, F.pmod(F.xxhash64("row"), F.lit(files))).write.mode("overwrite").partitionBy(*SCENE).parquet(path)


def read_pixels(spark: SparkSession, path: str, schema: StructType, wanted: DataFrame | None = None) -> DataFrame:
    """The pixel table, or of it the scenes (body, date) of a written table: their partitions are found from that table while the query runs, and no other is read."""
    p = spark.read.schema(schema).parquet(path)
    return p if wanted is None else p.join(small(wanted.select(*SCENE).filter(F.col("date").rlike(r"\A\d{8}\z"))), SCENE, "left_semi")


def write_baselines(baselines: DataFrame, path: str) -> int:
    """Replaces all baselines by these, and tells how many there are. The table to write must not be read from `path`."""
    baselines.select("body_id", "zone_id", "indicator", "season", "mean", "std", "samples").write.mode("overwrite").parquet(path)
    return baselines.sparkSession.read.parquet(path).count()


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the product store; before the first write it has no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def products(spark: SparkSession, store: str) -> DataFrame:
    """The observations (body, zone, date, indicator, value) that a product store holds."""
    return _stored(spark, f"{store}/products", _PRODUCTS).drop("scene_hash")


def _compute(pixels: DataFrame, todo: DataFrame, store: str, model: str | None, s: Settings) -> None:
    """Products of some scenes (with scene_hash and the red-edge bands they lack) into the store; a scene written again replaces itself only."""
    lacks = todo.filter(F.col("date").rlike(r"\A\d{8}\z")).select(*KEY, (F.size("no_red_edge") > 0).alias("no_red_edge"))  # a filter, for which Spark prunes partitions by this table
    p = pixels.join(small(lacks), SCENE).withColumns({b: F.when(~F.col("no_red_edge"), F.col(b)) for b in ("b05", "b06")}).drop("no_red_edge", "scene_hash")
    sums = written(scenes.zone_sums(p, s), "zone-sums")
    gates = scenes.gates_of(sums, s).select(*SCENE, F.col("extent_m2").cast("double").alias("extent_m2"), F.col("status").alias("gate"), F.col("reason").alias("why"))
    agreed = scenes.agreement(p, model, s).select(*SCENE, "agreement") if model else gates.select(*SCENE, F.lit(None).cast("double").alias("agreement"))
    x = lacks.join(gates, SCENE).join(agreed, SCENE).withColumn("m", mask_confidence(F.lit(bool(model)), F.col("agreement"), s))
    why = F.concat("m.reasons", F.when(F.col("no_red_edge"), F.array(F.lit("missing_red_edge_bands"))).otherwise(F.array().cast("array<string>")))
    rows = x.select("extent_m2", "gate", "why", F.col("m.confidence").alias("mask_confidence"), why.alias("mask_reasons"), *KEY)
    values = scenes.observations_of(sums, s).join(small(lacks.select(*KEY)), SCENE).select("zone_id", "indicator", F.col("value").cast("double").alias("value"), *KEY)
    for name, table in (("products", values), ("scenes", rows)):  # scenes last: a scene that is there has its products
        table.repartition(*SCENE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(f"{store}/{name}")


def analyze(
    spark: SparkSession, asked: DataFrame, bodies: DataFrame, manifest: DataFrame, pixels: DataFrame, baselines: DataFrame, store: str, model: str | None = None, s: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """(dates, zones) of asked scenes (body, date).

    dates: body, date, status, reason, confidence, confidence_reasons, scene_extent_m2. The first of these holds: unusable (body not in `bodies`, or no date), missing (no folder in `manifest`), unusable (a
    required band lacks), insufficient_data (gate), no_baseline (zones, none of which has a baseline), ok. zones: the scored zones of such dates, whose confidence and reasons
    include their scene's; a date is no surer than its least sure zone.

    `store` is the product store. A scene's fingerprint is that of its files; scenes without products for it are computed from `pixels`, joined by (body, date), which prunes a table
    partitioned by these. If nothing is to be computed, `pixels` isn't read. Repeated requests count once; `model` names a boolean column of `pixels`.
    """
    asked, bands = asked.select(*SCENE).distinct(), inventory.resolve_bands(manifest)
    red = inventory.scene_bands(bands, ("b05", "b06"), manifest).select(*SCENE, F.col("missing").alias("no_red_edge"))
    files = inventory.scene_bands(bands, folders=manifest).select(*SCENE, "missing", "scene_hash").join(red, SCENE)
    known = bodies.select("body_id").distinct().withColumn("known", F.lit(True))
    x = written(asked.join(known, "body_id", "left").join(files, SCENE, "left").withColumn("usable", F.coalesce(F.col("known") & valid_date(F.col("date")) & (F.size("missing") == 0), F.lit(False))), "asked")
    complete = x.filter("usable").select(*KEY, "no_red_edge")
    todo = written(not_computed(complete, _stored(spark, f"{store}/scenes", _SCENES)), "todo")
    if todo.take(1):
        _compute(pixels, todo, store, model, s)
    done = _stored(spark, f"{store}/scenes", _SCENES).join(small(complete.select(*KEY)), KEY, "left_semi")
    seen = _stored(spark, f"{store}/products", _PRODUCTS).join(small(complete.select(*KEY)), KEY, "left_semi").drop("scene_hash")
    compared = scoring.compare(scoring.with_baseline(seen, baselines), s)
    scores = scoring.zone_scores(compared, s).join(done.select(*SCENE, "mask_confidence", "mask_reasons"), SCENE)
    scores = scores.withColumn("m", merged((F.col("mask_confidence"), F.col("mask_reasons")), (F.col("confidence"), F.col("reasons"))))
    zones = scores.drop("confidence", "reasons", "mask_confidence", "mask_reasons").select("*", F.col("m.confidence").alias("confidence"), F.col("m.reasons").alias("reasons")).drop("m")
    zones = written(zones, "zones")
    least = zones.groupBy(*SCENE).agg(F.min("confidence").alias("least"))
    counted = seen.select(*SCENE).distinct().withColumn("zoned", F.lit(True))
    d = x.join(done.drop("scene_hash"), SCENE, "left").join(least, SCENE, "left").join(counted, SCENE, "left")
    bad, absent, lacks = F.col("known").isNull() | ~valid_date(F.col("date")), F.col("missing").isNull(), F.size("missing") > 0
    gated, bare = F.coalesce(F.col("gate") != "ok", F.lit(False)), F.coalesce("zoned", F.lit(False)) & F.col("least").isNull()
    word = lambda *w: F.array(*map(F.lit, w))
    rules = [
        (bad, "unusable", F.lit("unknown_water_body_or_date"), word("unknown_water_body")), (absent, "missing", F.lit("scene_folder_missing"), word("scene_missing")),
        (lacks, "unusable", F.concat(F.lit("missing_bands:"), F.array_join("missing", ",")), word("missing_bands")), (gated, F.col("gate"), F.col("why"), word("insufficient_data")),
        (bare, "no_baseline", F.lit("missing_baseline"), F.concat("mask_reasons", word("missing_baseline"))),
    ]
    status, reason, why = F.when(F.lit(False), ""), F.when(F.lit(False), ""), F.when(F.lit(False), F.array().cast("array<string>"))
    for test, name, because, reasons in rules:
        status, reason, why = status.when(test, name), reason.when(test, because), why.when(test, reasons)
    sure = F.when(bad | absent | lacks | gated, 0.0).otherwise(F.least("mask_confidence", F.coalesce("least", F.lit(1.0))))
    fine = ~(bad | absent | lacks | gated)
    dates = d.select(*SCENE, status.otherwise("ok").alias("status"), reason.alias("reason"), sure.alias("confidence"), why.otherwise(F.col("mask_reasons")).alias("confidence_reasons"), F.when(fine, F.col("extent_m2")).alias("scene_extent_m2"))
    return dates, zones

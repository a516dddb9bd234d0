"""Sinks and their scans: upserts, ledgers, products by scene, documents and GeoJSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with equal keys; of new rows that repeat a key, the last by `order` is left.

    The result has to go to another folder than the one that `old` reads.
    """
    fresh = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("r")).select("r.*")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def append_ledger(reports: DataFrame, path: str) -> None:
    """All verdicts are stored, refused ones too."""
    reports.write.mode("append").parquet(path)


def write_products(products: DataFrame, path: str) -> None:
    """Rows (body_id, date, scene_hash, indicator, value); a scene that is written again replaces itself only."""
    out = products.repartition("body_id", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("body_id", "date", "scene_hash").parquet(path)


def write_masks(masks: DataFrame, grids: DataFrame, path: str, files: int = 8) -> None:
    """Rows (body_id, date, row, col, x, y, water) of masks, water as 0 or 1, with the middle of each pixel on its scene's grid (body_id, date, a, e, c, f); without a grid x and y are null.

    Partitions are scenes, each in up to `files` files, so that a large scene isn't one task's; a scene that is written again replaces itself only, so the masks must not be read from `path`. Null water counts as 0.
    """
    scene = ["body_id", "date"]
    x = masks.select(*scene, "row", "col", F.coalesce(F.col("water").cast("byte"), F.lit(0).cast("byte")).alias("water")).join(small(grids.select(*scene, *"aecf")), scene, "left")
    middle = lambda start, step, n: (F.col(start) + F.col(step) * (F.col(n) + 0.5)).cast("double")
    rows = x.select("row", "col", middle("c", "a", "col").alias("x"), middle("f", "e", "row").alias("y"), "water", *scene)
    dealt = rows.repartition(*scene, F.pmod(F.xxhash64("row"), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scene).parquet(path)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """The mask rows; a filter on body_id and date reads these scenes only."""
    return spark.read.schema("row long, col long, x double, y double, water byte, body_id string, date string").parquet(path)


def read_products(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The products of scenes that have all `required` indicators."""
    p = spark.read.parquet(path)
    key = ["body_id", "date", "scene_hash"]
    has = [F.bool_or(F.col("indicator") == x) for x in required]
    return p.join(p.groupBy(*key).agg(reduce(lambda a, b: a & b, has).alias("all")).filter("all").select(*key), key, "left_semi")


def only_new(documents: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What a store doesn't have yet."""
    return documents.join(known.select(key), key, "left_anti")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all Markdown files under `root`, one file a row."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def feature_collections(zones: DataFrame, stamp: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON document per body: its zones in order, their properties, and a stamp of the collection. Zones of a body are few."""
    feature = F.struct("zone_id", F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties")).alias("f"))
    by = zones.groupBy("body_id").agg(stamp.alias("stamp"), F.sort_array(F.collect_list(feature)).alias("z"))
    doc = F.struct(F.lit("FeatureCollection").alias("type"), "stamp", F.col("z.f").alias("features"))
    return by.select("body_id", F.to_json(doc).alias("document"))

"""GeoJSON documents and the catalog of water bodies, read by Spark wherever they lie."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.zones import checked_boundaries, feature_id, polygons_of

_FEATURES = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
_CATALOG = "root string, boundary_crs string, water_bodies array<struct<id: string, name: string, boundary: struct<type: string, coordinates: string>, dates: array<string>>>"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, each one file; a path that isn't there has none."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, zone_id, properties, polygons) of GeoJSON documents, features numbered from 1 in their order; an absent path gives no rows."""
    doc = _documents(spark, path, _FEATURES)
    name = F.col("_metadata.file_path") if doc.inputFiles() else F.lit(None).cast("string")
    f = doc.select(name.alias("file"), F.posexplode("features").alias("at", "f")).withColumn("feature", F.col("at") + 1)
    named = lambda k: F.try_element_at("f.properties", F.lit(k))
    zone = feature_id(named("id"), named("name"), F.concat(F.lit("zone-"), F.col("feature").cast("string")))
    return f.select("file", "feature", zone.alias("zone_id"), F.col("f.properties").alias("properties"), polygons_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons"))


def load_catalog(spark: SparkSession, path: str, root: str = "data", crs: str = "EPSG:4326") -> DataFrame:
    """(body_id, name, type, polygons, dates, root, boundary_crs) of a catalog document, its defaults filled in; a boundary that is neither Polygon nor MultiPolygon ends the run with its body's name."""
    c = _documents(spark, path, _CATALOG).select(F.coalesce("root", F.lit(root)).alias("root"), F.coalesce("boundary_crs", F.lit(crs)).alias("boundary_crs"), F.explode("water_bodies").alias("b"))
    rows = c.select(F.col("b.id").alias("body_id"), "b.name", F.col("b.boundary.type").alias("type"), F.col("b.boundary.coordinates").alias("coordinates"), F.coalesce("b.dates", F.array().cast("array<string>")).alias("dates"), "root", "boundary_crs")
    return checked_boundaries(rows).select("body_id", "name", "type", polygons_of(F.col("type"), F.col("coordinates")).alias("polygons"), "dates", "root", "boundary_crs")


def body_of(catalog: DataFrame, body_id: str):
    """One body's row; a body that isn't there is a KeyError."""
    row = catalog.filter(F.col("body_id") == body_id).first()
    if row is None:
        raise KeyError(body_id)
    return row

"""Adapters from the given tables to the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observed pixel: body, date, row, col, bands, scene class."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('wb-', cast(l_suppkey % 4 as string)) AS body_id", "date_format(date_trunc('quarter', l_shipdate), 'yyyyMMdd') AS date",
        "l_partkey % 64 AS row", "l_orderkey % 64 AS col", "l_discount AS b02", "l_quantity / 50 AS b03", "l_extendedprice / 105000 AS b04",
        "(l_partkey % 97) / 97 AS b05", "(l_orderkey % 89) / 89 AS b06", "l_tax * 10 AS b08",
        "CASE WHEN l_partkey % 5 < 1 + year(l_shipdate) % 4 THEN 6 ELSE cast(l_partkey % 12 as int) END AS scl",
    ).withColumn("inside", (F.col("row") < 52) & (F.col("col") < 48)).withColumn("zone_id", F.when(F.col("inside"), F.concat(F.lit("z"), (F.col("col") / 16).cast("int").cast("string"))))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of scene folders from events: body, date, file name, size, time."""
    names = F.array(*map(F.lit, ("B02.tif", "B2.tif", "B03.tif", "B04.tif", "B08.tif", "B11.tif", "B12.tif", "SCL.tif", "scl.tif", "notes.txt")))
    i = F.col("event_id")
    return table(spark, sf_dir, "events").filter(i % 11 < F.col("user_id") % 9).select(
        F.concat(F.lit("wb-"), (F.col("user_id") % 4).cast("string")).alias("body_id"), F.date_format("ts", "yyyyMMdd").alias("date"),
        F.get(names, (i * 31 % 10).cast("int")).alias("file"), (i * 100).alias("size"), i.alias("mtime"),
    )


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(key, lon, lat) from customer, supplier or nation."""
    key = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey"}[name]
    k = F.col(key).cast("long")
    return table(spark, sf_dir, name).select(k.alias("key"), (k * 7919 % 36000 / 100 - 180).alias("lon"), (k * 104729 % 17000 / 100 - 85).alias("lat"), F.when(k % 5 < 4, F.concat(F.lit("wb-"), (k % 5).cast("string"))).alias("owner"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body_id, name), four of them."""
    n = (F.col("s_suppkey") % 4).cast("string")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("wb-"), n).alias("body_id"), F.concat(F.lit("Lake "), n).alias("name")).distinct()


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body_id, zone_id, lon, lat): three zones a body with their centres."""
    n, z = F.substring("body_id", 4, 9).cast("int"), F.col("z")
    x = bodies(spark, sf_dir).select("body_id", F.explode(F.array(*map(F.lit, range(3)))).alias("z"))
    return x.select("body_id", F.concat(F.lit("z"), z.cast("string")).alias("zone_id"), (n * 37 + z * 3).cast("double").alias("lon"), (n * 11 - 20).cast("double").alias("lat"))


def _boxes(spark: SparkSession, sf_dir: str, shapes: list[tuple[str, list[list[tuple[float, float]]]]]) -> DataFrame:
    rows = [(i + 1, name, [[[(float(x), float(y)) for x, y in ring] for ring in rings]]) for i, (name, rings) in enumerate(shapes)]
    f = spark.createDataFrame(rows, "feature int, zone_id string, polygons array<array<array<struct<lon: double, lat: double>>>>")
    return bodies(spark, sf_dir).select("body_id").join(F.broadcast(f))  # a few shapes for each of four bodies


def box(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diamond with a square hole, the same for every body."""
    return _boxes(spark, sf_dir, [("edge", [[(150, 0), (0, 150), (-150, 0), (0, -150)], box(-10, -10, 10, 10)])])


def zone_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boxes in degrees that overlap."""
    return _boxes(spark, sf_dir, [("z0", [box(-150, -60, -20, 60)]), ("z1", [box(-30, -60, 40, 60)]), ("z2", [box(30, -60, 150, 60)])])


def grid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boxes on the pixels' grid that overlap."""
    return _boxes(spark, sf_dir, [("z0", [box(0, 0, 20, 52)]), ("z1", [box(16, 0, 36, 52), box(20, 10, 24, 30)]), ("z2", [box(32, 0, 48, 52)])])


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo reports from events: body, user, time, place, image hash."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("report_id"), F.concat(F.lit("wb-"), (i % 4).cast("string")).alias("body_id"), "user_id", F.col("ts").cast("timestamp").alias("taken_at"),
        (i * 7919 % 36000 / 100 - 180).alias("lon"), (i * 104729 % 17000 / 100 - 85).alias("lat"),
        F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor("value").cast("string"))).alias("image_hash"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis history from events: one row per event."""
    status = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "click", "WARNING").otherwise("NORMAL")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("analysis_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("body_id"), F.col("ts").cast("date").alias("day"), (F.col("value") / 500).alias("ndti"), (F.col("value") % 97 / 97).alias("ndci"), status.alias("status"))

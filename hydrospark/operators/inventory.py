"""What lies in scene folders: dates, the file of each band, fingerprints, and a report of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE = ["body_id", "date"]
# The file names of each band, the preferred one first, and the bands that a scene must have.
ALIASES = {
    "b02": ("B02.tif", "B2.tif"), "b03": ("B03.tif", "B3.tif"), "b04": ("B04.tif", "B4.tif"), "b05": ("B05.tif", "B5.tif"), "b06": ("B06.tif", "B6.tif"), "b08": ("B08.tif", "B8.tif"),
    "b11": ("B11.tif",), "b12": ("B12.tif",), "scl": ("SCL.tif", "scl.tif"),
}
REQUIRED = ("b02", "b03", "b04", "b08", "b11", "b12", "scl")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(body_id, date, file, size, mtime) of root/body/date/file, mtime in microseconds as far as the file system tells them; the files' contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return f.select(part(-3).alias("body_id"), part(-2).alias("date"), part(-1).alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))


def scene_dates(manifest: DataFrame, configured: DataFrame) -> DataFrame:
    """Distinct (body_id, date) of both tables; what isn't eight digits is no date."""
    return manifest.select(*SCENE).unionByName(configured.select(*SCENE)).filter(F.col("date").rlike(r"^\d{8}$")).distinct()


def resolve_bands(manifest: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """(body_id, date, band, file, size, mtime): for each band the first of its names that is there; of equal names the smallest file."""
    table = [(name, band, i) for band, names in aliases.items() for i, name in enumerate(names)]
    known = F.broadcast(manifest.sparkSession.createDataFrame(table, "file string, band string, pref int"))  # one row per name
    best = F.min_by(F.struct("file", "size", "mtime"), F.struct("pref", "size"))
    return manifest.join(known, "file").groupBy(*SCENE, "band").agg(best.alias("x")).select(*SCENE, "band", "x.*")


def scene_bands(bands: DataFrame, required: tuple[str, ...] = REQUIRED, folders: DataFrame | None = None) -> DataFrame:
    """Per scene its files, missing bands in the order of `required`, and the fingerprint over (band, size, mtime).

    With a list of scene folders (body, date) there is a row for each, also for one without a known band; without, only scenes with a band have one.
    """
    each = F.sort_array(F.collect_list(F.struct("band", "file", "size", "mtime")))  # one entry per band
    s = bands.groupBy(*SCENE).agg(each.alias("b"))
    if folders is not None:
        s = folders.select(*SCENE).distinct().join(s, SCENE, "left").withColumn("b", F.coalesce("b", F.array().cast(s.schema["b"].dataType)))
    join = lambda f, sep: F.array_join(F.transform("b", f), sep)
    stamp = join(lambda x: F.concat_ws(":", x["band"], x["size"].cast("string"), x["mtime"].cast("string")), ";")
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("b.band"))
    return s.select(*SCENE, join(lambda x: F.concat_ws("=", x["band"], x["file"]), ",").alias("files"), missing.alias("missing"), F.substring(F.sha2(stamp, 256), 1, 16).alias("scene_hash"))


def inventory_report(dates: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per body: known dates, dates with files, and scenes that lack a required band."""
    there = F.col("missing").isNotNull()
    fails: Column = F.count_if(there & (F.size("missing") > 0))
    return dates.join(scenes, SCENE, "left").groupBy("body_id").agg(F.count(F.lit(1)).alias("dates"), F.count_if(there).alias("on_disk"), fails.alias("failures"))

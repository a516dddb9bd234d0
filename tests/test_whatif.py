"""Plumes on copies of scenes: which requests are refused, what is painted, and that the copy alone changes."""

import math

from pyspark.sql import functions as F

from hydrospark.config import Settings
from hydrospark.operators import scenes, scoring
from hydrospark.plans import whatif

BANDS = ("b02", "b03", "b04", "b05", "b06", "b08")
FILES = ("B02.tif", "B03.tif", "B04.tif", "B05.tif", "B06.tif", "B08.tif", "B11.tif", "B12.tif", "SCL.tif")
SIDE = 12
REQUEST = "request_id string, body_id string, date string, indicator string, lon double, lat double, radius_m double, magnitude double"


def tables(spark):
    """Eight dates of one lake of water, whose red band differs from date to date; the folder of the last one lacks B04, that before has no B02, and a second body has no baseline."""
    dates = [f"2020010{i}" for i in range(1, 9)]
    rows = [
        (body, date, r, c, 0.2, 0.3, 0.1 + 0.001 * (i % 3), 0.15, 0.2, 0.05, 6, True, "z" + str(c // 6))
        for body in ("wb-1", "wb-2") for i, date in enumerate(dates) for r in range(SIDE) for c in range(SIDE)
    ]
    bands = ", ".join(f"{b} double" for b in BANDS)
    pixels = spark.createDataFrame(rows, f"body_id string, date string, row long, col long, {bands}, scl int, inside boolean, zone_id string")
    gone = {(dates[-1], "B04.tif"), (dates[-2], "B02.tif"), (dates[-3], "B05.tif")}
    files = [(b, d, f, 1, 1) for b in ("wb-1", "wb-2") for d in dates for f in FILES if (d, f) not in gone]
    manifest = spark.createDataFrame(files, "body_id string, date string, file string, size long, mtime long")
    grids = pixels.select("body_id", "date").distinct().select("*", F.lit(10.0).alias("a"), F.lit(-10.0).alias("e"), F.lit(0.0).alias("c"), F.lit(120.0).alias("f"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    bodies = spark.createDataFrame([("wb-1", "Lake One"), ("wb-2", None)], "body_id string, name string")
    zones = spark.createDataFrame([(b, z, 10.0 * i, 5.0) for b in ("wb-1", "wb-2") for i, z in enumerate(("z0", "z1"))], "body_id string, zone_id string, lon double, lat double")
    points = spark.createDataFrame([("wb-1", 0.0, 5.0)], "owner string, lon double, lat double")
    base = scoring.fit_baselines(scenes.zone_observations(pixels.filter("body_id = 'wb-1'")))
    return bodies, manifest, grids, pixels, base, zones, points, points


def test_refusals_and_feeds(spark):
    """Each reason for refusal once, in its order; a strong plume flags the zone under it and no other, under the real scene's ids; a plume without radius or magnitude changes nothing."""
    asked = [
        ("unknown", "wb-9", "20200101", "turbidity", 5.0, 5.0, 30.0, 1.0), ("absent", "wb-1", "20300101", "turbidity", 5.0, 5.0, 30.0, 1.0), ("outside", "wb-1", "20200101", "turbidity", 120.0, 5.0, 30.0, 1.0),
        ("no place", "wb-1", "20200101", "turbidity", None, 5.0, 30.0, 1.0), ("no b02", "wb-1", "20200107", "turbidity", 5.0, 5.0, 30.0, 1.0), ("no b04", "wb-1", "20200108", "turbidity", 5.0, 5.0, 30.0, 1.0),
        ("no b05", "wb-1", "20200106", "chlorophyll", 5.0, 5.0, 30.0, 1.0), ("what", "wb-1", "20200101", "what", 5.0, 5.0, 30.0, 1.0), ("strong", "wb-1", "20200101", "turbidity", 25.0, 65.0, 30.0, 0.9),
        ("strong too", "wb-1", "20200101", "turbidity", 85.0, 65.0, 30.0, 0.9), ("no radius", "wb-1", "20200101", "turbidity", 25.0, 65.0, 0.0, 0.9), (None, "wb-1", "20200101", "turbidity", 25.0, 65.0, 30.0, None),
        ("no baseline", "wb-2", "20200101", "turbidity", 25.0, 65.0, 30.0, 0.9), ("strong", "wb-1", "20200101", "turbidity", 25.0, 65.0, 30.0, 0.9),
    ]
    out = whatif.plumes(spark, spark.createDataFrame(asked, REQUEST), *tables(spark), s=Settings(min_samples=1))
    got = {r.request_id: r for r in out.responses.collect()}
    assert len(got) == out.responses.count() == 13
    said = {k: (r.status, r.reason, r.confidence_reasons[-1]) for k, r in got.items()}
    assert said["unknown"] == ("unusable", "unknown_water_body", "unknown_water_body") and said["absent"] == ("missing", "scene_folder_missing", "scene_missing")
    assert said["outside"] == said["no place"] == said["no b02"] == ("unusable", "plume_outside_scene", "plume_outside_scene")
    assert said["no b04"] == said["what"] == ("unusable", "driving_band_missing", "driving_band_missing") and said["no b05"] == ("unusable", "chlorophyll_requires_red_edge", "driving_band_missing")
    assert said["strong"] == said[""] == said["no radius"] == ("ok", None, "synthetic_plume") and said["no baseline"] == ("no_baseline", "missing_baseline", "synthetic_plume")
    refused = [r for k, r in got.items() if r.status in ("unusable", "missing")]
    assert len(refused) == 8 and all((r.confidence, r.feed_confidence, r.scene_extent_m2) == (0.0, 0.0, None) for r in refused)
    assert got["strong"].scene_extent_m2 == 100.0 * SIDE * SIDE
    flagged = {(r.request_id, r.body_id, r.zone_id) for r in out.zones.filter("flagged").collect()}
    assert flagged == {("strong", "wb-1", "z0"), ("strong too", "wb-1", "z1")}
    alerts = {r.request_id: r for r in out.alerts.collect()}
    assert alerts["strong"].alert_id == "al-wb-1-z0-20200101-turbidity" and alerts["strong"].evidence_id == "ev-wb-1-z0-20200101" and "Lake One" in alerts["strong"].template and set(alerts) == {"strong", "strong too"}
    assert {(r.request_id, r.evidence_id) for r in out.evidence.filter("flagged").collect()} == {("strong", "ev-wb-1-z0-20200101"), ("strong too", "ev-wb-1-z1-20200101")}
    sites = {r.request_id: r for r in out.sites.collect()}
    assert set(sites) == {"strong", "strong too"} and all(r.rank == 1 and r.persistence == 1.0 for r in sites.values()) and sites["strong"].intake_m == 0.0 and sites["strong too"].intake_m > 1e6


def test_painted_pixels(spark):
    """Every pixel against the plain rule; two requests of one scene give two copies, other scenes none; degrees become metres by the request's latitude."""
    bodies, manifest, grids, pixels, *_ = tables(spark)
    asked = spark.createDataFrame([("a", "wb-1", "20200102", "transparency", 35.0, 65.0, 40.0, 0.5), ("b", "wb-1", "20200102", "chlorophyll", 5.0, 5.0, 25.0, -0.1)], REQUEST)
    x = whatif.located(asked, bodies, manifest, grids).withColumn("copy", F.col("request_id"))
    assert {r.request_id: (r.row, r.col, r.radius, r.refused) for r in x.collect()} == {"a": (5, 3, 4.0, None), "b": (11, 0, 2.5, None)}
    got = whatif.painted(pixels, x).collect()
    assert len(got) == 2 * SIDE * SIDE and set(got[0].asDict()) == set(pixels.columns)
    for r in got:
        row, col, radius, more = (5, 3, 4.0, 0.5) if r.body_id == "a" else (11, 0, 2.5, -0.1)
        add = more * max(0.0, min(1.0, 1 - math.hypot(r.row - row, r.col - col) / radius))
        assert math.isclose(r.b02, 0.2 + (add if r.body_id == "a" else 0)) and math.isclose(r.b05, 0.15 + (add if r.body_id == "b" else 0)) and r.b04 == 0.101
    degrees = grids.withColumns({"a": F.lit(0.001), "e": F.lit(-0.001), "c": F.lit(5.0), "f": F.lit(60.012)})
    one = whatif.located(spark.createDataFrame([("a", "wb-1", "20200102", "turbidity", 5.0025, 60.0065, 500.0, 1.0)], REQUEST), bodies, manifest, degrees).first()
    assert (one.row, one.col) == (5, 2) and math.isclose(one.radius, 500 / (0.001 * 111_320 * math.cos(math.radians(60.0065))))


def test_no_requests(spark):
    """Without requests all tables are empty."""
    out = whatif.plumes(spark, spark.createDataFrame([], REQUEST), *tables(spark))
    assert all(t.count() == 0 for t in out)

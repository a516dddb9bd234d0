"""Analyses that start from a product store, the pixel table, contracts, GeoJSON and the catalog."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from hydrospark.catalog import LOOSE
from hydrospark.catalog_analysis import NAMES, scene_files
from hydrospark.operators import scenes, scoring
from hydrospark.plans import analysis, feeds
from hydrospark.sources import contracts, geojson
from hydrospark.sources import tables as t

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pixels"))
    p = t.pixels(spark, SF).filter("date BETWEEN '19970101' AND '19981231'")
    analysis.write_pixels(p, path)
    base = scoring.fit_baselines(scenes.zone_observations(p, LOOSE))
    return path, p, base, p.select("body_id", "date").distinct(), t.bodies(spark, SF)


def trapped(p, test):
    """The pixels, where reading one of some scenes ends the run."""
    return p.withColumn("b03", F.when(test, F.raise_error(F.lit("read"))).otherwise(F.col("b03")))


def test_a_second_run_reads_no_pixel(spark, world, tmp_path):
    path, p, base, days, bodies = world
    store, files = str(tmp_path / "store"), scene_files(days)

    def run(pixels, f=files):
        dates, zones = analysis.analyze(spark, days, bodies, f, pixels, base, store, s=LOOSE)
        zones = zones.withColumns({c: F.round(c, 6) for c in ("fused_score", "max_sigma")})  # sums in another order differ in the last digits
        return [sorted(map(str, x.collect())) for x in (dates, zones)]

    first = run(analysis.read_pixels(spark, path, p.schema))
    assert len(first[0]) == days.count() and first[1]
    assert run(trapped(p, F.lit(True))) == first  # all products are there
    one = days.filter("body_id <> 'wb-1'").orderBy("date", "body_id").first()
    mine = (F.col("body_id") == one.body_id) & (F.col("date") == one.date)
    touched = files.withColumn("mtime", F.when(mine, F.lit(2).cast("long")).otherwise(F.col("mtime")))
    with pytest.raises(Exception, match="read"):
        run(trapped(p, mine), touched)
    assert run(trapped(p, ~mine), touched) == first  # only the scene whose files changed is read
    held = analysis._stored(spark, f"{store}/scenes", analysis._SCENES)
    assert held.count() == days.count() - days.filter("body_id = 'wb-1' AND date LIKE '____07__'").count() + 1
    assert run(trapped(p, F.lit(True)), files) == first  # the former products are kept by fingerprint


def test_pixels_are_read_once(spark, world, tmp_path):
    """Gates and observations come from the same sums; each of them used to read the pixels."""
    _, p, base, days, bodies = world
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    some = p.filter("date = '19970101'").withColumn("zone_id", F.coalesce("zone_id", F.lit("")))  # Arrow's rows as they are
    watched = some.mapInPandas(counted, some.schema).withColumn("zone_id", F.nullif("zone_id", F.lit("")))
    dates, _ = analysis.analyze(spark, days.filter("date = '19970101'"), bodies, scene_files(days), watched, base, str(tmp_path / "store"), s=LOOSE)
    assert dates.count() == 4 and read.value == some.count()
    sums = scenes.zone_sums(some.withColumn("zone_id", F.nullif("zone_id", F.lit(""))))
    assert sorted(map(str, scenes.gates_of(sums).collect())) == sorted(map(str, scenes.scene_gates(some).collect()))


def test_only_wanted_partitions_are_read(spark, world):
    path, p, _, days, _ = world
    some = analysis.written(days.filter("date = '19970401'"), "wanted")
    x = analysis.read_pixels(spark, path, p.schema, some)
    assert x.count() == p.filter("date = '19970401'").count()
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "dynamicpruning" in plan
    assert "dynamicpruning" in plan.lower()


def test_a_model_and_low_agreement(spark, world, tmp_path):
    _, p, base, days, bodies = world
    pixels = p.withColumn("model", F.rand(3) < 0.5)
    dates, _ = analysis.analyze(spark, days, bodies, scene_files(days), pixels, base, str(tmp_path / "s"), "model", LOOSE)
    ok = [r for r in dates.collect() if r.status == "ok"]
    assert ok and all(r.confidence <= 0.6 and "model_agreement" in r.confidence_reasons for r in ok)


def test_nothing_asked_and_no_files(spark, world, tmp_path):
    _, p, base, days, bodies = world
    files = scene_files(days)
    dates, zones = analysis.analyze(spark, days.limit(0), bodies, files, p, base, str(tmp_path / "a"))
    assert dates.count() == zones.count() == 0
    dates, zones = analysis.analyze(spark, days, bodies, files.limit(0), p, base, str(tmp_path / "b"))
    assert {(r.status, r.reason, r.confidence) for r in dates.collect()} == {("missing", "scene_folder_missing", 0.0)} and zones.count() == 0
    assert len(NAMES) == 9


def test_baselines_replace_all(spark, world, tmp_path):
    base, path = world[2], str(tmp_path / "baselines")
    n = base.count()
    assert analysis.write_baselines(base, path) == n == spark.read.parquet(path).count()
    assert analysis.write_baselines(base.limit(2), path) == 2 == spark.read.parquet(path).count()


GOOD = {
    "analysis_id": "a", "timestamp": "2024-01-01T00:00:00Z", "location": {"name": "Lake", "coordinates": [78.4, 17]}, "satellite_data": {"source": "S2", "scene_date": "2024-01-01", "cloud_cover_percentage": 3},
    "water_detection": {"model_used": "m", "water_surface_area_sq_km": 4.5, "mask_geojson_url": "u"}, "investigation_priority": {"score": 100, "recommendation": "go"},
    "contamination_detection": {"model_used": "n", "indicators": {"ndwi": 0, "ndti": -0.5}, "anomaly_status": "LOW", "confidence_score": 0, "detected_contaminants": ["x"]}, "more": [1, "let through"],
}


def spoilt(spec, path=()):
    """(reason, record) for every rule of the contract, each broken alone."""
    for field, rule in spec.items():
        name, where = field.rstrip("!"), (*path, field.rstrip("!"))

        def put(value, where=where):
            out = copy.deepcopy(GOOD)
            at = out
            for k in where[:-1]:
                at = at[k]
            if value is None:
                del at[where[-1]]
            else:
                at[where[-1]] = value[0]
            return json.dumps(out)

        label = ".".join(where)
        if field.endswith("!"):
            yield f"{label}:missing", put(None)
        yield f"{label}:type", put([7] if rule == "string" or isinstance(rule, tuple) and rule[0] == "string" else ["7"])
        yield f"{label}:type", put([None])
        if isinstance(rule, dict):
            yield from spoilt(rule, where)
        elif isinstance(rule, list):
            yield f"{label}:items", put([[1, "a", None]])
        elif isinstance(rule, tuple):
            yield (f"{label}:enum", put(["low"])) if rule[0] == "string" else (f"{label}:range", put([rule[2] + 0.5]))
            if rule[0] == "number":
                yield f"{label}:range", put([rule[1] - 1])


def test_every_rule_of_the_contract(spark, tmp_path):
    lean = {k: v for k, v in GOOD.items() if k != "more"}
    lean["satellite_data"] = {"source": "S2", "scene_date": "d"}
    cases = [(None, json.dumps(GOOD)), (None, json.dumps(lean)), ("json", "{"), ("json", "[1]"), ("json", None), ("json", ""), ("analysis_id:missing", "{}"), *spoilt(contracts.ANALYSIS)]
    cases.append(("location.name:type", json.dumps({**GOOD, "location": {"name": 1}, "timestamp": "t", "investigation_priority": 3})))  # the first of several
    rows = spark.createDataFrame([(i, record, "own") for i, (_, record) in enumerate(cases)], "i int, record string, note string")
    got = {r.i: r.reason for r in contracts.checked(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [reason for reason, _ in cases] and len(cases) > 60
    path = str(tmp_path / "records")
    contracts.store_checked(rows, path)
    assert spark.read.parquet(f"{path}/accepted=true").count() == 2 and spark.read.parquet(f"{path}/accepted=false").filter("reason IS NULL").count() == 0
    assert spark.read.parquet(path).count() == len(cases)


SQUARE = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]


def feature(properties, kind="Polygon", coordinates=SQUARE):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [feature({"id": "z0", "n": 1}), feature({"name": "Bay"}, "MultiPolygon", [SQUARE, SQUARE]), feature({}, "Point", [1, 2]), feature({"id": "", "name": ""})]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc, indent=1))
    rows = geojson.read_features(spark, str(tmp_path / "f.geojson")).orderBy("feature").collect()
    assert [(r.feature, r.zone_id, len(r.polygons)) for r in rows] == [(1, "z0", 1), (2, "Bay", 2), (3, "zone-3", 0), (4, "zone-4", 1)]
    assert [(p.lon, p.lat) for p in rows[0].polygons[0][0]] == [tuple(map(float, p)) for p in SQUARE[0]] and rows[0].properties == {"id": "z0", "n": "1"} and rows[0].file.endswith("f.geojson")
    assert geojson.read_features(spark, str(tmp_path / "absent.geojson")).count() == 0


def test_catalog(spark, tmp_path):
    body = lambda i, kind="Polygon", **more: {"id": i, "name": i.upper(), "boundary": {"type": kind, "coordinates": SQUARE}, **more}
    (tmp_path / "c.json").write_text(json.dumps({"water_bodies": [body("pond", dates=["20240101"]), body("lake")]}))
    c = geojson.load_catalog(spark, str(tmp_path / "c.json"))
    assert geojson.body_of(c, "pond").asDict()["dates"] == ["20240101"] and geojson.body_of(c, "lake").boundary_crs == "EPSG:4326" and len(geojson.body_of(c, "lake").polygons[0][0]) == 5
    with pytest.raises(KeyError):
        geojson.body_of(c, "sea")
    (tmp_path / "bad.json").write_text(json.dumps({"root": "r", "water_bodies": [body("pond", "Point")]}))
    with pytest.raises(Exception, match="pond must be Polygon"):
        geojson.load_catalog(spark, str(tmp_path / "bad.json")).collect()
    assert geojson.load_catalog(spark, str(tmp_path / "none.json")).count() == 0


DATES = "body_id string, date string, status string, reason string, confidence double, confidence_reasons array<string>"


def test_overview_and_trends_have_every_date(spark):
    days = [("b", "20240101", "ok", None, 0.9, ["x"]), ("b", "20240401", "missing", "scene_folder_missing", 0.0, ["scene_missing"]), ("b", "20240701", "ok", None, 1.0, ["x", "y"]), ("b", "latest", "unusable", "r", 0.0, ["z"]), ("c", "20240101", "no_baseline", "r", 0.5, [])]
    dates = spark.createDataFrame(days, DATES)
    zones = [("b", z, d, f, ("turbidity", s)) for z, d, f, s in (("z0", "20240701", False, "watch"), ("z2", "20240701", True, "watch"), ("z1", "20240701", True, "severe"), ("z0", "20240101", True, "warning"))]
    z = spark.createDataFrame(zones, "body_id string, zone_id string, date string, flagged boolean, dominant struct<indicator: string, severity: string>")
    bodies = spark.createDataFrame([(b, b.upper()) for b in "bcd"], "body_id string, name string")
    got = {r.body_id: r for r in feeds.overview(bodies, dates, z).collect()}
    assert (got["b"].latest_ok, got["b"].alert_zone, got["b"].alert_severity, got["b"].confidence) == ("20240701", "z1", "severe", 0.0)
    assert [d.status for d in got["b"].dates] == ["ok", "missing", "ok"] and got["b"].confidence_reasons == ["not_a_detection", "x", "scene_missing", "y"]
    assert (got["c"].latest_ok, got["c"].alert_zone, got["c"].confidence) == (None, None, 0.5) and (got["d"].dates, got["d"].confidence, got["d"].confidence_reasons) == ([], 1.0, ["not_a_detection"])
    seen = spark.createDataFrame([("b", "z0", "20240101", "turbidity", 1.0), ("b", "z0", "20240701", "turbidity", 4.0), ("b", "z0", "20240701", "extent", 9.0)], "body_id string, zone_id string, date string, indicator string, value double")
    base = spark.createDataFrame([("b", "z0", "turbidity", s, m, 0.5) for s, m in (("ALL", 2.0), ("DJF", 3.0))], "body_id string, zone_id string, indicator string, season string, mean double, std double")
    rows = {(r.indicator, r.date): r for r in feeds.changes(feeds.trends(dates, seen, base)).collect()}
    assert len(rows) == 4 * 3
    state = {k: (r.value, r.baseline_mean, r.change, r.status) for k, r in rows.items()}
    assert state["turbidity", "20240101"] == (1.0, 3.0, None, "ok") and state["turbidity", "20240401"] == (None, None, None, "missing") and state["turbidity", "20240701"] == (4.0, 2.0, 3.0, "ok")
    assert state["extent", "20240101"] == (None, None, None, "ok") and rows["extent", "20240101"].confidence == 0.0 and rows["extent", "20240101"].confidence_reasons == ["x", "scene_missing", "y"]

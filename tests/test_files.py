"""Queries on files, grids and variants against their SQL; sinks, scans and streams in round trips."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from hydrospark import catalog_files
from hydrospark.operators import grid, inventory
from hydrospark.sources import sinks
from hydrospark.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog_files.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "events", "orders", "part", "documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog_files.QUERIES[name](spark, SF).toPandas(), db.sql(catalog_files.SQL[name]).df()
    k = sorted(want.columns)
    text = lambda d: d[k].astype(str).replace({"None": "nan", "<NA>": "nan", "NaN": "nan"}).sort_values(k).reset_index(drop=True)
    assert sorted(got.columns) == k and len(want) and text(got).equals(text(want))


def test_window_origins():
    assert grid.window_origins(64, 32, 16) == [0, 16, 32] and grid.window_origins(50, 32, 16) == [0, 16, 18] and grid.window_origins(10, 32, 16) == [0]
    assert grid.grids_match(2, (2, 3), (4, 6)) and not grid.grids_match(2, (2, 3), (5, 6))


def test_predictor_on_tiles(spark):
    p = spark.createDataFrame([("b", "20240101", r, c, float(r)) for r in range(6) for c in range(6)], "body_id string, date string, row int, col int, v double")
    votes = grid.predict_tiles(grid.to_tiles(p, 6, 6, 4, 2), lambda: lambda x: x["v"] > 2)
    got = {(r.row, r.col): r.mask for r in grid.stitch(votes).collect()}
    assert got == {(r, c): r > 2 for r in range(6) for c in range(6)}


def test_scan_files(spark, tmp_path):
    for name in ("B02.tif", "B2.tif", "B8.tif", "scl.tif", "notes.txt"):
        f = tmp_path / "pond" / "20240101" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * len(name))
    r = inventory.scene_bands(inventory.resolve_bands(inventory.scan_files(spark, str(tmp_path)))).collect()
    assert [(x.body_id, x.date, x.files, x.missing, len(x.scene_hash)) for x in r] == [("pond", "20240101", "b02=B02.tif,b08=B8.tif,scl=scl.tif", ["b03", "b04", "b11", "b12"], 16)]


def test_products_replace_their_scene_only(spark, tmp_path):
    rows = lambda v, *scenes: spark.createDataFrame([("b", s, "h", i, v) for s in scenes for i in ("extent", "turbidity")], "body_id string, date string, scene_hash string, indicator string, value double")
    path = str(tmp_path / "p")
    sinks.write_products(rows(1.0, "20240101", "20240102"), path)
    sinks.write_products(rows(2.0, "20240102").filter("indicator = 'extent'"), path)
    assert sorted((str(r.date), r.value) for r in spark.read.parquet(path).collect()) == [("20240101", 1.0), ("20240101", 1.0), ("20240102", 2.0)]
    assert {str(r.date) for r in sinks.read_products(spark, path, ["extent", "turbidity"]).collect()} == {"20240101"}


def test_upsert_and_ledger(spark, tmp_path):
    df = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    assert sorted(tuple(r) for r in sinks.upsert(df(("a", 1), ("b", 1)), df(("b", 1), ("b", 2), ("c", 2)), ["k"], ["v"]).collect()) == [("a", 1), ("b", 2), ("c", 2)]
    for _ in range(2):
        sinks.append_ledger(df(("a", 1)), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2


def test_texts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# one\ntwo")
    (tmp_path / "a" / "y.txt").write_text("no")
    assert [r.text for r in sinks.read_markdown(spark, str(tmp_path)).collect()] == ["# one\ntwo"]


def test_daily_stream(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [(at(1, 1), "click", 1.0), (at(1, 5), "click", 3.0), (at(2, 0), "view", 5.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    s = streams.daily(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")))
    w = s.writeStream.format("memory").queryName("daily_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert sorted((r.event_type, r.n, r["mean"]) for r in spark.table("daily_counts").select("event_type", F.col("n"), "mean").collect()) == [("click", 2, 2.0), ("view", 1, 5.0)]


def test_masks_by_scene(spark, tmp_path):
    """A round trip with places; a scene that is written again replaces itself only, a filter reads its partition only, and a scene without a grid has no places."""
    path, rows = str(tmp_path / "masks"), "body_id string, date string, row long, col long, water boolean"
    grids = spark.createDataFrame([("b", "20200101", 10.0, -10.0, 500.0, 900.0)], "body_id string, date string, a double, e double, c double, f double")
    sinks.write_masks(spark.createDataFrame([("b", "20200101", 0, 0, True), ("b", "20200101", 2, 1, None), ("b", "20200102", 0, 0, False)], rows), grids, path)
    sinks.write_masks(spark.createDataFrame([("b", "20200102", 5, 6, True)], rows), grids, path)
    m = sinks.read_masks(spark, path)
    assert {tuple(r) for r in m.collect()} == {(0, 0, 505.0, 895.0, 1, "b", "20200101"), (2, 1, 515.0, 875.0, 0, "b", "20200101"), (5, 6, None, None, 1, "b", "20200102")}
    plan = m.filter("date = '20200102'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and m.filter("date = '20200102'").count() == 1
    sinks.write_masks(spark.createDataFrame([], rows), grids, path)
    assert m.count() == 3


def test_score_stream(spark, tmp_path):
    """Observations that come in two files get the comparisons that a batch over both gives; baselines are static, and a zone without one has no row."""
    known = spark.createDataFrame([("b", "z0", "extent", "DJF", 10.0, 2.0, 9), ("b", "z0", "extent", "ALL", 12.0, 3.0, 20), ("b", "z1", "turbidity", "ALL", 1.0, 0.0, 4)], "body_id string, zone_id string, indicator string, season string, mean double, std double, samples long")
    schema = "body_id string, zone_id string, date string, indicator string, value double"
    come = [[("b", "z0", "20200105", "extent", 30.0), ("b", "z1", "20200105", "turbidity", 1.5), ("b", "z9", "20200105", "extent", 1.0)], [("b", "z0", "20200705", "extent", None), ("b", "z0", "20200706", "extent", 12.0)]]
    source, where = str(tmp_path / "come"), str(tmp_path / "scored")
    for rows in come:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.score_stream(spark.readStream.schema(schema).parquet(source), known)
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(where).awaitTermination()
    got, one = spark.read.parquet(where), streams.score_stream(spark.read.schema(schema).parquet(source), known)
    key = lambda t: sorted(map(repr, t.select("zone_id", "date", "indicator", "value", "mean", "sigma", "crossed", "used_fallback", "reason").collect()))
    assert key(got) == key(one) and got.count() == 4
    assert {(r.zone_id, r.date): r.crossed for r in got.collect()} == {("z0", "20200105"): True, ("z1", "20200105"): True, ("z0", "20200705"): False, ("z0", "20200706"): False}

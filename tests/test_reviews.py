"""Cases from reviews: edges of polygons, and searches whose work has to grow with the table, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from hydrospark.functions import geo
from hydrospark.operators import places, reports
from hydrospark.sources import contracts


def test_places_on_edges(spark):
    """As strict comparisons have it: on the outer ring outside, on a hole's ring not in the hole."""
    ring = lambda *xy: F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in xy))
    rings = F.array(ring((60, 0), (0, 60), (-60, 0), (0, -60)), ring((-10, -10), (10, -10), (10, 10), (-10, 10)))
    pts = [(-5.5, 54.5), (-56.5, 3.5), (60.0, 0.0), (0.0, -60.0), (25.5, -34.5), (30.0, 29.99), (-10.0, 3.0), (10.0, 10.0), (4.0, 10.0), (9.99, 9.99), (0.0, 0.0), (-70.0, 0.0)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    got = {(r.lon, r.lat): r.x for r in df.withColumn("x", geo.within_polygon(F.col("lon"), F.col("lat"), rings)).collect()}
    assert got == {(x, y): abs(x) + abs(y) < 60 and not (-10 < x < 10 and -10 < y < 10) for x, y in pts}


def scattered(spark, seed, n, crowd):
    """Places all over, a third of them crowded, some at one place."""
    r = random.Random(seed)
    pts = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) if i % 3 else (i, 20 + r.uniform(-crowd, crowd), 5 + r.uniform(-crowd, crowd)) for i in range(n)] + [(n + i, 20.0, 5.0) for i in range(5)]
    return pts, spark.createDataFrame(pts, "key long, lon double, lat double")


def metres(a, b):
    return reports.metres_apart(a[1], a[2], b[1], b[2])


@pytest.mark.parametrize("task", [500, 4_000_000])
def test_crowded_cells_are_dealt_out(spark, monkeypatch, task):
    """Every pair once, whatever a task may hold, and no task of a crowded cell has more pairs than it should."""
    monkeypatch.setattr(places, "_TASK", task)
    (p, a), (q, b) = scattered(spark, 1, 200, 3), scattered(spark, 2, 150, 3)
    got = sorted((x.key, x.to) for x in places.within(a, b, 700_000).collect())
    assert got == sorted((x[0], y[0]) for x in p for y in q if metres(x, y) <= 700_000)
    met = places._meeting(*places._celled(a, places._goals(b), 700_000), 700_000, ["band", "cell"])
    assert task > 500 or max(r.n for r in met.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) < len(got) / 4


def met_pairs(monkeypatch):
    """Pairs that each join of cells is about to make."""
    seen, own = [], places._meeting

    def meeting(a, b, far, on):
        seen.append(places._loads(a, b, on)[1])
        return own(a, b, far, on)

    monkeypatch.setattr(places, "_meeting", meeting)
    return seen


def test_nearest_within(spark, monkeypatch):
    """As all pairs would have it, ties too, by far fewer pairs."""
    seen = met_pairs(monkeypatch)
    (p, a), (q, b) = scattered(spark, 3, 300, 30), scattered(spark, 4, 1500, 30)
    got = {(r.key, r["rank"]): r.to for r in places.nearest_within(a, b, 5_000_000, 3).collect()}
    want = {(x[0], n): y[0] for x in p for n, y in enumerate(sorted((y for y in q if metres(x, y) <= 5_000_000), key=lambda y: (metres(x, y), y[0]))[:3], 1)}
    assert got == want
    assert len(seen) > 1 and sum(seen) < 0.6 * places._loads(*places._celled(a, places._goals(b), 5_000_000), ["band", "cell"])[1]
    far = places.nearest_within(a, b.limit(2), 1000.0, 3)
    assert far.count() == sum(metres(x, y) <= 1000 for x in p for y in [(r.key, r.lon, r.lat) for r in b.limit(2).collect()])


def test_first_of_every_name(spark, monkeypatch):
    """As all pairs would have it, rare names too, though most spots never meet most lakes."""
    seen = met_pairs(monkeypatch)
    (p, a), (q, _) = scattered(spark, 5, 150, 60), scattered(spark, 6, 3000, 60)
    named = [(*y, "rare" if y[0] % 700 == 3 else None if y[0] % 11 == 0 else f"n{y[0] % 3}") for y in q]
    lakes = spark.createDataFrame(named, "key long, lon double, lat double, name string")
    got = {(r.key, r.name): r.to for r in places.first_named(a, lakes, 4_000_000).collect()}
    want = {}
    for x in p:
        for y in named:
            if y[3] and metres(x, y) <= 4_000_000:
                want.setdefault((x[0], y[3]), y[0])
    assert got == want
    assert len(seen) > 1 and sum(seen) < 0.4 * places._loads(*places._celled(a, places._goals(lakes), 4_000_000), ["band", "cell"])[1]


def test_contracts_are_checked_by_all_tasks(spark, tmp_path):
    """A table of one partition is dealt out."""
    rows = spark.range(0, 4000, 1, 1).select("id", F.concat(F.lit('{"analysis_id": "'), "id", F.lit('"}')).alias("record"))
    contracts.store_checked(rows, str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "c"))
    assert got.groupBy("reason", "accepted").count().collect() == [("timestamp:missing", False, 4000)]
    assert got.select(F.input_file_name()).distinct().count() > 1

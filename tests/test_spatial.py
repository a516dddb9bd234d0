"""Points in polygons by covers, and nearest points by growing cells, against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from hydrospark.operators import covers, places, zones
from hydrospark.plans import monitor

FEATURES = f"body_id string, feature int, zone_id string, polygons {zones.POLYGONS}"
POINTS = "id int, body_id string, lon double, lat double, note string"


def ring(points):
    return [(float(x), float(y)) for x, y in points]


def in_ring(x, y, r):
    odd = False
    for i, (ax, ay) in enumerate(r):
        bx, by = r[i - 1]
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return len(r) >= 3 and odd


def held(x, y, polygons):
    return any(p and in_ring(x, y, p[0]) and not any(in_ring(x, y, h) for h in p[1:]) for p in polygons)


def star(r, cx, cy, size, n):
    turns = sorted(r.random() for _ in range(n))
    return ring((cx + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * t), cy + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * t)) for t in turns)


def areas():
    r = random.Random(3)
    donut = [star(r, 0, 0, 10, 40), ring([(-1, -1), (1, -1), (1, 1), (-1, 1)]), star(r, 2, 3, 1, 7)]
    sliver = [ring([(-9, -9), (9, 9), (9, 9.0005)])]
    closed = ring([(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)])
    out = [("a", 1, "donut", [donut]), ("a", 2, "sliver", [sliver]), ("a", 3, "two", [[closed], [star(r, -5, 5, 2, 12)]]), ("a", 4, "point", []), ("a", 5, "bent", [[ring([(0, 0), (1, 1)])]])]
    out += [("a", 10 + i, None, [[star(r, r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(0.01, 3), r.randint(3, 30))]]) for i in range(20)]
    out += [("b", 1, "far", [[ring([(100, -40), (100.001, -40), (100.001, -39.9), (100, -39.9)])]])]
    return out


def spots():
    r = random.Random(8)
    out = [("a", r.uniform(-11, 11), r.uniform(-11, 11)) for _ in range(1500)] + [("a", x, x + d) for x in np.linspace(-9, 9, 60).tolist() for d in (0, 0.0002, -1e-9)]
    out += [("a", x, y) for x in (-1.0, 0.0, 1.0, 3.0, 6.0) for y in (-1.0, 0.0, 1.0, 3.0, 6.0)] + [("b", 100.0005, -39.95), ("b", 0.0, 0.0), ("none", 0.0, 0.0), (None, 1.0, 1.0), ("a", None, 1.0)]
    return [(i, *x, "kept") for i, x in enumerate(out)]


def test_hits_equal_brute_force(spark):
    features, points = areas(), spots()
    got = covers.with_hits(spark.createDataFrame(points, POINTS), spark.createDataFrame(features, FEATURES), "lon", "lat").collect()
    assert len(got) == len(points)
    for p in got:
        want = [f for body, f, _, polygons in features if body == p.body_id and p.lon is not None and held(p.lon, p.lat, polygons)]
        assert [h.feature for h in p.hits] == want, p
    assert sum(len(p.hits) > 1 for p in got) > 50


def test_burn_takes_the_later_and_locate_the_first(spark):
    features, points = spark.createDataFrame(areas(), FEATURES), spark.createDataFrame(spots(), POINTS)
    last = {r.id: (r.zone_index, r.zone_id) for r in zones.burn(points, features, "lon", "lat").collect()}
    edge = spark.createDataFrame([("a", 1, "edge", [[ring([(-10, -10), (10, -10), (10, 10), (-10, 10)])]])], FEATURES)
    for r in zones.locate(points, edge, features).collect():
        hits = [(f, z) for body, f, z, polygons in areas() if body == r.body_id and r.lon is not None and held(r.lon, r.lat, polygons)]
        inside = r.body_id == "a" and r.lon is not None and -10 <= r.lon < 10 and -10 <= r.lat < 10
        assert last[r.id] == (hits[-1] if hits else (0, None))
        assert r.where == ("outside_water_boundary" if not inside else "inside_zone" if hits else "inside_boundary")
        assert r.zone_id == (hits[0][1] if inside and hits else None)


def test_ten_thousand_features_in_a_linear_cover(spark):
    """Tiles of a field and slivers across it: cells stay a few per feature, and a crowded body is joined by cell."""
    side = 100
    tiles = [("a", i + 1, f"z{i}", [[ring([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])]]) for i, (x, y) in enumerate((i % side, i // side) for i in range(side * side))]
    slivers = [("a", side * side + 1 + k, f"s{k}", [[ring([(0, k + 0.5), (side, k + 0.5), (side, k + 0.501)])]]) for k in range(5)]
    features = spark.createDataFrame(tiles + slivers, FEATURES).repartition(4)
    cells = covers.covers(features)
    assert cells.agg(F.sum(F.size("near"))).first()[0] <= 40 * len(tiles)
    r = random.Random(1)
    points = [(i, "a", r.uniform(-2, side + 2), r.uniform(-2, side + 2), "") for i in range(4000)]
    for x in zones.burn(spark.createDataFrame(points, POINTS), spark.createDataFrame(tiles, FEATURES), "lon", "lat").collect():
        inside = 0 <= x.lon < side and 0 <= x.lat < side
        assert x.zone_index == (int(x.lat) * side + int(x.lon) + 1 if inside else 0)


def test_large_cells_go_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(covers, "small", lambda df: df)
    points = spark.createDataFrame(spots(), POINTS)
    x = covers.with_hits(points, spark.createDataFrame(areas(), FEATURES), "lon", "lat")
    assert x.filter(F.size("hits") > 0).count() > 100 and x.count() == points.count()


def test_no_points_or_features(spark):
    none, some = spark.createDataFrame([], FEATURES), spark.createDataFrame(spots(), POINTS)
    assert {tuple(r) for r in zones.burn(some, none, "lon", "lat").select("zone_index", "zone_id").distinct().collect()} == {(0, None)}
    assert zones.locate(some.limit(0), none, none).count() == 0


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


def test_nearest_equals_brute_force(spark):
    r = random.Random(6)
    owners = ["a", "b", "", None]
    near = [(r.choice(owners), r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(150)] + [("a", 179.99, 5.0), ("b", -179.95, -5.0), (None, 12.0, 89.9), ("a", -170.0, -89.99)]
    spots_ = [(r.choice("abc"), f"z{i}", r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(120)]
    spots_ += [("a", "east", -179.99, 5.0), ("b", "west", 179.9, -5.0), ("b", "pole", -168.0, 89.95), ("a", "south", 10.0, -89.99), ("a", "exact", 179.99, 5.0), ("a", "nowhere", None, None)]
    s = spark.createDataFrame(spots_, "body_id string, zone_id string, lon double, lat double")
    p = spark.createDataFrame(near, "owner string, lon double, lat double")
    kinds = p.withColumn("kind", F.lit("all")).unionByName(p.filter("owner = 'b'").withColumn("kind", F.lit("b only")))
    for steps in (None, [0.5, 8.0, 128.0]):
        got = {(x.zone_id, x.kind): x.metres for x in places.least_metres(s.withColumn("owner", F.col("body_id")), kinds, ["body_id", "zone_id"], steps).collect()}
        for body, zone, lon, lat in spots_:
            for kind, some in (("all", near), ("b only", [x for x in near if x[0] == "b"])):
                want = min((metres((lon, lat), (x, y)) for o, x, y in some if not o or o == body), default=None) if lon is not None else None
                have = got.get((zone, kind))
                assert (have is None and want is None) or abs(have - want) < 1e-3, (zone, kind, have, want)


def test_distances_have_no_nested_loop(spark):
    z = spark.createDataFrame([("a", "z", 0.0, 0.0)], "body_id string, zone_id string, lon double, lat double")
    p = spark.createDataFrame([(None, 0.1, 0.1)], "owner string, lon double, lat double")
    plan = monitor.distances(z, p, p.limit(0))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    row = monitor.distances(z, p, p.limit(0)).first()
    assert 15_000 < row.intake_m < 16_000 and row.settlement_m is None

"""Components against brute force, and the ordered check of reports where they crowd."""

import datetime
import random

from pyspark.sql import functions as F

from hydrospark.operators import reports
from hydrospark.operators.components import components

from test_cases import REPORTS, brute


def plain(edges):
    of = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            least = min(of[a], of[b])
            moved |= of[a] != least or of[b] != least
            of[a] = of[b] = least
    return of


def test_components_equal_brute_force(spark):
    r = random.Random(7)
    path = list(range(1000, 1400))
    r.shuffle(path)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + list(zip(path, path[1:])) + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (9000, 9000), (-5, 8000)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def crowd(n, seed, images, spread):
    """Reports in chains of near places and times, some with an image that most of them have, across the 180th meridian, too."""
    r, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    place = lambda: r.choice([(0.0, 0.0), (179.99999, 10.0), (-179.99999, 10.0), (20.0, 89.99999)])
    out = []
    for i in range(n):
        x, y = place()
        image = None if r.random() < 0.03 else "common" if r.random() < 0.2 else f"h{r.randint(0, images)}"
        out.append((i, r.choice("ab"), i % 3, start + datetime.timedelta(seconds=r.randint(0, spread)), image, x + r.uniform(-2, 2) * 1e-4, y + r.uniform(-2, 2) * 1e-4 * (y < 80)))
    return out


def test_crowded_reports_equal_brute_force(spark):
    for rows in (crowd(300, 1, 60, 40_000), crowd(60, 3, 2, 4_000)):
        located = spark.createDataFrame(rows, REPORTS).withColumns({"where": F.lit("inside_boundary"), "zone_id": F.lit(None).cast("string")})
        got = {r.report_id: r.status == "accepted" for r in reports.adjudicate(located).collect()}
        assert got == brute(rows) and 0 < sum(got.values()) < len(rows)


def test_one_bodys_reports_spread_over_components(spark):
    """Ten places of one body, an hour apart: ten folds, none of which knows of the others."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(100 * p + i, "a", 0, start + datetime.timedelta(minutes=40 * i), f"{p}-{i}", 5.0 * p, 0.0001 * (i % 2)) for p in range(10) for i in range(12)]
    located = spark.createDataFrame(rows, REPORTS).withColumns({"where": F.lit("inside_boundary"), "zone_id": F.lit("z")})
    placed = reports._placed(located, reports.DEFAULTS)
    _, left = reports._first_ones(placed, reports.DEFAULTS)
    links = reports._links(left, reports.DEFAULTS).select(F.col("cell").alias("a"), F.col("other").alias("b"))
    assert components(links).select("component").distinct().count() == 10
    assert {r.report_id: r.status == "accepted" for r in reports.adjudicate(located).collect()} == brute(rows)


def test_cells_meet_in_blocks(spark):
    """Every two near reports have linked cells, wherever on the globe, and what moves is a few rows a cell: it was one for each of some 36 cells around."""
    r, start = random.Random(5), datetime.datetime(2024, 1, 1)
    places = [(0.0, 0.0), (179.9999, 10.0), (-180.0, -45.0), (20.0, 89.9999), (-100.0, 89.998), (77.0, 61.0)]
    rows = []
    for i in range(400):
        x, y = r.choice(places)
        rows.append((i, "a", 0, start + datetime.timedelta(seconds=r.randint(-30_000, 30_000)), str(i), (x + r.uniform(-4, 4) * 1e-4 + 180) % 360 - 180, min(90.0, y + r.uniform(-4, 4) * 1e-4)))
    placed = reports._placed(spark.createDataFrame(rows, REPORTS), reports.DEFAULTS).localCheckpoint()
    cell = {x.report_id: x.cell for x in placed.collect()}
    near = {(cell[p[0]], cell[q[0]]) for p in rows for q in rows if abs(p[3] - q[3]).total_seconds() <= 3600 and reports.metres_apart(p[5], p[6], q[5], q[6]) <= 25}
    links = {(x.cell, x.other) for x in reports._links(placed, reports.DEFAULTS).collect()}
    assert {(a, b) for a, b in near if a != b} <= links == {(b, a) for a, b in links} and len(links) > 100
    far = [(i, "ab"[i % 2], 0, start + datetime.timedelta(minutes=i), str(i), r.uniform(-180, 180), r.uniform(-70, 70)) for i in range(5000)]
    cells = reports._placed(spark.createDataFrame(far, REPORTS), reports.DEFAULTS)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    shuffled = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(spark._jsc.sc().statusStore().executorList(False)))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        before = shuffled()
        assert reports._links(cells, reports.DEFAULTS).count() == 0
        assert 0 < shuffled() - before < 5000 * 250
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

"""Cases on which results depend in detail: single values, folds against brute force, streams, chunks."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from hydrospark.functions import confidence, geo, indices, narrative, prompts
from hydrospark.operators import evidence, history, loading, places, reports, retrieval, scenes, scoring, variants, zones
from hydrospark.plans import monitor
from hydrospark.streaming import streams

OBS = "body_id string, zone_id string, date string, indicator string, value double"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_single_values(spark):
    score = indices.history_score(F.lit(5.0), F.lit(0.0), F.lit(1e-12))
    r = one(spark, score["score"].alias("score"), indices.falloff(F.lit(1.0), 0.0).alias("fall"), indices.history_priority(F.lit(1e12), F.lit(1), F.lit(1.0)).alias("priority"), narrative.stripped(F.lit("\n\t x \n")).alias("x"))
    assert (r.score, r.fall, r.priority, r.x) == (100, 0.5, 100, "x")
    far = one(spark, geo.circle(F.lit(0.0), F.lit(89.9), F.lit(1.0)).alias("ring")).ring
    assert abs(far[0].lon - 1 / 111 / 0.1) < 1e-6
    m = one(spark, confidence.merged((F.lit(0.8), F.array(F.lit("a"), F.lit(""))), (F.lit(1.7), F.array(F.lit("b"), F.lit("a"))), (F.lit(-1.0), F.lit(None).cast("array<string>"))).alias("m")).m
    assert (m.confidence, m.reasons) == (0.0, ["a", "b"])
    assert evidence.formula_text().endswith("f(d) = 1 / (1 + d / 5000)")


def test_one_bad_pixel_leaves_the_mean(spark):
    rows = [("b", "20240101", 0, i, 0.1, 0.9, v, 0.2, 0.3, 0.1, 6, True, "z") for i, v in enumerate((0.2, 0.4, float("nan")))]
    p = spark.createDataFrame(rows, "body_id string, date string, row int, col int, b02 double, b03 double, b04 double, b05 double, b06 double, b08 double, scl int, inside boolean, zone_id string")
    got = {r.indicator: r.value for r in scenes.zone_observations(p).collect()}
    assert abs(got["turbidity"] - 0.3) < 1e-12 and got["extent"] == 300


def test_sigma_beyond_the_cap_and_infinite(spark):
    rows = [("b", z, "20240101", "turbidity", v, 10.0, s, 40) for z, v, s in (("far", 20.0, 1.0), ("flat", 11.0, 0.0), ("same", 10.0, 0.0))]
    o = spark.createDataFrame(rows, OBS + ", mean double, std double, samples int")
    got = {r.zone_id: r for r in scoring.zone_scores(scoring.compare(o)).collect()}
    assert (got["far"].max_sigma, round(got["far"].fused_score, 9), got["far"].severity) == (10.0, 6.0, "severe")
    assert got["flat"].flagged and got["flat"].max_sigma == 6.0 and got["flat"].reasons == ["zero_baseline_std"]
    assert not got["same"].flagged and got["same"].reasons == []


def test_zone_without_baseline_is_named(spark):
    o = spark.createDataFrame([("b", "z0", "20240101", "turbidity", 1.0), ("b", "z1", "20240101", "turbidity", 1.0)], OBS)
    assert [tuple(r) for r in scoring.unscored(o, scoring.fit_baselines(o.filter("zone_id = 'z0'"))).collect()] == [("b", "z1", "20240101", "missing_baseline")]


def test_distances_without_intakes_or_settlements(spark):
    z = spark.createDataFrame([("b", "z", 0.0, 0.0)], "body_id string, zone_id string, lon double, lat double")
    p = lambda *rows: spark.createDataFrame(list(rows), "lon double, lat double, owner string")
    r = monitor.distances(z, p(), p((0.0, 1.0, ""), (0.0, 0.5, "other"), (0.0, 2.0, "b"))).first()
    assert r.intake_m is None and 111_000 < r.settlement_m < 111_400


def test_rolling_deviation_far_from_zero(spark):
    day = lambda i: datetime.date(2024, 1, 1 + i)
    h = spark.createDataFrame([(i, "b", day(i), 1e9 + i % 2) for i in range(10)], "analysis_id int, body_id string, day date, ndti double")
    r = variants.rolling_baselines(h).filter("analysis_id = 9").first()
    assert abs(r["std"] - 0.52704627) < 1e-6


def brute(rows, s=reports.DEFAULTS):
    """Accepted ids by comparing each report with all accepted ones before it."""
    kept, out = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        near = lambda k: abs((k[3] - r[3]).total_seconds()) <= s.duplicate_s and reports.metres_apart(k[5], k[6], r[5], r[6]) <= s.duplicate_m
        out[r[0]] = not any(k[1] == r[1] and (k[4] == r[4] or near(k)) for k in kept)
        if out[r[0]]:
            kept.append(r)
    return out


def report_rows(n, seed):
    r, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    return [(i, r.choice("ab"), i % 3, start + datetime.timedelta(minutes=r.randint(0, 400)), f"h{r.randint(0, n)}", r.choice((0.0, 0.0001, 0.0004, 5.0)), r.choice((0.0, 0.0002, 3.0)) + r.choice((0, 0, i / 100))) for i in range(n)]


REPORTS = "report_id long, body_id string, user_id long, taken_at timestamp, image_hash string, lon double, lat double"


def test_adjudication_equals_brute_force(spark):
    rows = report_rows(150, 4)
    located = spark.createDataFrame(rows, REPORTS).withColumns({"where": F.lit("inside_zone"), "zone_id": F.lit("z")})
    got = {r.report_id: r for r in reports.adjudicate(located).collect()}
    want = brute(rows)
    assert {i: r.status == "accepted" for i, r in got.items()} == want and 0 < sum(want.values()) < 150
    assert all(r.credits == 10 * want[i] and r.reason == ("inside_zone" if want[i] else "duplicate") for i, r in got.items())
    out = reports.adjudicate(located.withColumn("where", F.lit("outside_water_boundary")))
    assert {(r.status, r.reason, r.credits) for r in out.collect()} == {("rejected", "outside_water_boundary", 0)}
    assert reports.leaderboard(out).collect()[0].asDict() == {"user_id": "demo", "credits": 0}
    sums = {str(u): 10 * sum(want[r[0]] for r in rows if r[2] == u) for u in range(3)}
    assert {r.user_id: r.credits for r in reports.leaderboard(reports.adjudicate(located)).collect()} == sums


def held_places(spark, path):
    """How many cells of time and place the stream's state holds."""
    return spark.read.format("statestore").option("stateVarName", "places").load(path).count()


def test_adjudication_stream(spark, tmp_path):
    """Three batches, each later: the state of the earlier ones decides, and what no later report can repeat by place is forgotten."""
    streams.keyed_state(spark)
    rows = sorted(report_rows(80, 9), key=lambda r: r[3])
    later = [(1000 + i, "a", 0, datetime.datetime(2024, 1, 3, i), f"new{i}", 50.0, 50.0) for i in range(3)]
    sizes = []
    for part in (rows[:40], rows[40:], later[:1], later[1:]):
        spark.createDataFrame(part, REPORTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = streams.adjudicate_stream(spark.readStream.schema(REPORTS).parquet(str(tmp_path / "in")))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        sizes.append(held_places(spark, str(tmp_path / "c")))
    assert {r.report_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == brute(rows + later)
    assert sizes[1] > 3 and sizes[-1] <= 3, sizes


def test_new_scenes_stream(spark, tmp_path):
    from hydrospark.sources import tables as t

    p = t.pixels(spark, "/root/testdata/sf0.001").filter("date < '19940101'")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    base = scoring.fit_baselines(scenes.zone_observations(p))
    streams.score_new_scenes(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), base, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    want = scoring.zone_scores(scoring.compare(scoring.with_baseline(scenes.zone_observations(p), base)))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.count() == want.count() and got.select("body_id", "zone_id", "date", "flagged").exceptAll(want.select("body_id", "zone_id", "date", "flagged")).count() == 0


def test_other_streams(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(1, "b", "h1", at(1), 10), (1, "b", "h1", at(2), 10), (2, "b", "h2", at(3), 10)]
    spark.createDataFrame(rows, "user_id long, body_id string, image_hash string, taken_at timestamp, credits int").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("user_id long, body_id string, image_hash string, taken_at timestamp, credits int").parquet(str(tmp_path / "in"))
    for name, s, mode in (("board", streams.running_leaderboard(src), "complete"), ("fresh", streams.fresh_images(src), "append")):
        s.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.user_id: r.credits for r in spark.table("board").collect()} == {1: 20, 2: 10} and spark.table("fresh").count() == 2


def test_late_rows_are_dropped(spark, tmp_path):
    schema, at = "ts timestamp, event_type string, value double", lambda d, h=0: datetime.datetime(2024, 1, d, h)
    for i, rows in enumerate(([(at(1), "click", 1.0)], [(at(9), "click", 1.0)], [(at(1, 5), "click", 7.0), (at(9, 2), "click", 3.0)], [(at(20), "view", 0.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = streams.daily(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.w.start.day, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, 1) in got and (9, 2) in got and (1, 2) not in got


def test_areas(spark):
    hole = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6]]]
    rows = [("b", 1, "a", "Polygon", json.dumps(hole)), ("b", 2, "m", "MultiPolygon", json.dumps([[hole[0]], [[[20, 0], [30, 0], [30, 10]]]])), ("b", 3, "p", "Point", "[5, 5]"), ("c", 1, "line", "Polygon", "[[[0, 0], [9, 9]]]")]
    f = spark.createDataFrame(rows, "body_id string, feature int, zone_id string, type string, coordinates string").withColumn("polygons", zones.polygons_of(F.col("type"), F.col("coordinates")))
    pts = spark.createDataFrame([("b", 5.0, 5.0), ("b", 1.0, 1.0), ("b", 28.0, 2.0), ("b", 50.0, 50.0), ("c", 1.0, 1.0), ("d", 1.0, 1.0)], "body_id string, lon double, lat double")
    got = [(r["where"], r.zone_id) for r in zones.locate(pts, f.filter("zone_id = 'm'"), f).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("inside_zone", "m"), ("inside_zone", "a"), ("inside_zone", "m"), ("outside_water_boundary", None), ("outside_water_boundary", None), ("outside_water_boundary", None)]))
    burnt = {(r.lon, r.lat, r.body_id): (r.zone_index, r.zone_id) for r in zones.burn(pts, f, "lon", "lat").collect()}
    assert burnt[1.0, 1.0, "b"] == (2, "m") and burnt[5.0, 5.0, "b"] == (2, "m") and burnt[50.0, 50.0, "b"] == (0, None) and burnt[1.0, 1.0, "c"] == (0, None)
    zones.checked_boundaries(f.filter("type <> 'Point'")).collect()
    with pytest.raises(Exception, match="boundary of b"):
        zones.checked_boundaries(f).collect()
    names = one(spark, zones.feature_id(F.lit(""), F.lit("n"), F.lit("z")).alias("a"), zones.feature_name(F.lit("i"), F.lit(""), F.lit("z")).alias("b"), zones.feature_id(F.lit(None).cast("string"), F.lit(""), F.lit("z")).alias("c"))
    assert tuple(names) == ("n", "i", "z")


def test_cells_across_the_date_line_and_near_poles(spark):
    r = random.Random(3)
    pts = [(i, r.uniform(-180, 180), r.choice((r.uniform(-90, 90), r.uniform(85, 90)))) for i in range(120)] + [(900, 179.99, 10.0), (901, -179.99, 10.0), (902, 0.0, 90.0)]
    df = spark.createDataFrame(pts, "key long, lon double, lat double")
    got = {(x.key, x.to) for x in places.within(df, df, 400_000).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if reports.metres_apart(a[1], a[2], b[1], b[2]) <= 400_000}


def test_loading_helpers(spark):
    r = one(spark, loading.valid_body_id(F.lit("a-1")).alias("a"), loading.valid_body_id(F.lit("-a")).alias("b"), loading.valid_date(F.lit("20240101\n")).alias("c"), loading.valid_date(F.lit("20240101")).alias("d"))
    assert tuple(r) == (True, False, False, True)
    p = spark.createDataFrame([("b", "d", None, None)], "body_id string, date string, b02 double, scl int")
    f = loading.filled(p, ("b02",)).first()
    assert f.b02 != f.b02 and f.scl == 0
    p = spark.createDataFrame([("b", "d1", True, 0.5), ("b", "d2", True, float("nan")), ("b", "d3", False, 0.5)], "body_id string, date string, inside boolean, b02 double")
    s = spark.createDataFrame([("b", d, "ok", None) for d in ("d1", "d2", "d3")], "body_id string, date string, status string, reason string")
    assert {x.date: (x.status, x.reason) for x in loading.empty_areas(s, p).collect()} == {"d1": ("ok", None), "d2": ("empty_aoi", "aoi_outside_scene"), "d3": ("empty_aoi", "aoi_outside_scene")}


def test_answers(spark):
    p = F.array(F.struct(F.lit("s#0").alias("id"), F.lit("T").alias("title"), F.lit("body").alias("text")))
    none = F.array().cast("array<struct<id: string, title: string, text: string>>")
    card = F.array(F.struct(F.lit("turbidity").alias("indicator"), F.lit(14.0).alias("value"), F.lit(10.0).alias("mean"), F.lit(0.25).alias("std"), F.lit(4.0).alias("sigma"), F.lit(True).alias("crossed")))
    no_card, no_list = F.lit(None).cast("array<struct<indicator: string, value: double, mean: double, std: double, sigma: double, crossed: boolean>>"), F.lit(None).cast("array<string>")
    r = one(spark, prompts.extractive(p, card, F.array(F.lit("turbidity"))).alias("a"), prompts.extractive(none, no_card, no_list).alias("b"), prompts.grounding(p, F.lit(None).cast("double"), F.lit("llm")).alias("c"),
            prompts.grounding(none, F.lit(None).cast("double"), F.lit("template")).alias("d"), prompts.retrieval_query(no_list).alias("e"))
    assert "[s#0] T**\nbody" in r.a and "value 14, baseline 10 ± 0.25, deviation 4.00σ — ⚠️ threshold crossed\n• **Flagged indicators**: turbidity\n" in r.a and "not configured" in r.a and r.b.startswith("I don't have")
    assert (r.c.confidence, r.c.reasons, r.c.grounded) == (0.75, ["corpus"], True) and (r.d.confidence, r.d.reasons, r.d.grounded) == (0.2, ["template", "not_in_corpus"], False)
    assert r.e.startswith("water quality")


def test_average_hash(spark):
    grey = [float(i) for i in range(64)]
    r = one(spark, reports.average_hash(F.array(*map(F.lit, grey)), F.lit(b"x")).alias("h"))
    assert r.h == "ahash:ffffffff"


@pytest.mark.parametrize("block", [2, 256])
def test_overlap_search(spark, block):
    """Nulls, texts without tokens, ties, repeats and a token that all have, over several blocks; empty tables on either side."""
    texts = [(7, "the Lake the"), (3, "the lake"), (None, "the lake"), (4, None), (5, "?!"), (6, "the river, 2 lakes"), (1, "lake"), (2, "the"), (8, "the"), (8, "the")]
    asked = [(1, "The lake is?"), (2, ""), (3, None), (4, "river RIVER 2"), (5, "none")]
    p, q = spark.createDataFrame(texts, "passage long, text string"), spark.createDataFrame(asked, "question int, text string")
    got = sorted(tuple(r) for r in retrieval.overlap_search(p, q, 4, block).select("question", "rank", "passage", "score").collect())
    want, split = [], lambda x: set(re.findall("[a-z0-9]+", (x or "").lower()))
    for i, x in asked:
        found = [(-len(split(x) & split(y)) / len(split(x)), j is not None, j) for j, y in texts if split(x) & split(y)]
        want += [(i, n, j, -s) for n, (s, _, j) in enumerate(sorted(found)[:4], 1)]
    assert got == want
    assert retrieval.overlap_search(p.limit(0), q).count() == retrieval.overlap_search(p, q.limit(0)).count() == 0


def test_analyses_are_scored_and_saved(spark):
    """Of two scenes one has no masked pixel; a body without history is normal; an analysis made again takes the old one's place; no pixels."""
    px = spark.createDataFrame([("a b", "2024-01-05", True, 0.9), ("a b", "2024-01-05", True, 0.7), ("a b", "2024-01-05", False, 9.0), ("a b", "2024-01-06", False, 0.5), ("c", "2024-01-05", True, 0.4), ("c", "2024-01-05", None, 0.4)], "body_id string, date string, wet boolean, x double")
    old = spark.createDataFrame([(f"A_2023010{i}_ab", "a b", datetime.date(2023, 1, i), 0.1 * i, "NORMAL") for i in range(1, 8)] + [("A_20240105_ab", "a b", datetime.date(2024, 1, 5), 5.0, "HIGH")], "analysis_id string, body_id string, day date, ndti double, status string")
    made = history.analyze(px, old, "wet", {"ndti": F.col("x")})
    got = {r.analysis_id: r for r in made.collect()}
    std = 0.02**0.5  # of 0.1, 0.2 ... 0.5
    r = got["A_20240105_ab"]
    assert (r.ndti, r.status, r.anomaly_score, r.sigma, r.priority) == (0.8, "HIGH", int(min(100, 0.5 / std / 4 * 100)), round(0.5 / std, 2), int(0.5 * int(0.5 / std / 4 * 100) + 30))
    assert got["A_20240106_ab"].ndti == 0.0 and got["A_20240106_ab"].sigma == round(-0.3 / std, 2) and got["A_20240106_ab"].status == "NORMAL"
    assert (got["A_20240105_c"].status, got["A_20240105_c"].anomaly_score, got["A_20240105_c"].priority, got["A_20240105_c"].sigma) == ("NORMAL", 0, 30, 0.0)
    kept = {r.analysis_id: r.ndti for r in history.saved(old, made.select(*old.columns)).collect()}
    assert len(kept) == 10 and kept["A_20240105_ab"] == 0.8 and history.analyze(px.limit(0), old, "wet", {"ndti": F.col("x")}).count() == 0


def test_lake_search(spark):
    """First place of each name, others of each list, nothing near, own name left out whatever its case, no lakes."""
    spots = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 40.0)], "key long, lon double, lat double")
    lakes = spark.createDataFrame([(i, 0.01 * i, 0.0, n) for i, n in enumerate(["A", "b", "A", None, "", "C", "d", "e", "F"], 1)], "key long, lon double, lat double, name string")
    near = places.lake_search(spots, lakes)
    got = [(r.key, r.name, r.rank, list(r.others)) for r in near.orderBy("rank").collect()]
    assert got == [(1, n, i + 1, [x for x in "AbCdeF" if x != n][:4]) for i, n in enumerate("AbCdeF")]
    own = spark.createDataFrame([(1, "B"), (2, None)], "key long, name string")
    assert [(r.name, r["rank"]) for r in places.around_detected(own, near).orderBy("rank").collect()] == [(n, i + 1) for i, n in enumerate("ACdeF")]
    assert [r.name for r in places.around_detected(own.withColumn("name", F.lit(None).cast("string")), near, 3).orderBy("rank").collect()] == ["A", "b", "C"]
    assert places.lake_search(spots, lakes.limit(0)).count() == 0

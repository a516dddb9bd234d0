"""Queries on areas, loading, places, history reads, prompts and what-ifs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import DIST, HIST, LOOSE, OBS, PIXELS, PTS, SCORES, _r, _scored, altered
from .catalog_files import FILES, _scenes
from .functions import geo, indices, narrative, prompts, splitter
from .operators import evidence, history, inventory, loading, places, reports, scenes, scoring, zones
from .plans import monitor
from .sources import sinks
from .sources import tables as t
from .sources.shared import shared_path, ship, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


BURN = "CASE WHEN y >= 0 AND y < 52 AND x >= 32 AND x < 48 THEN 3 WHEN y >= 0 AND y < 52 AND x >= 16 AND x < 36 AND NOT (x >= 20 AND x < 24 AND y >= 10 AND y < 30) THEN 2 WHEN y >= 0 AND y < 52 AND x >= 0 AND x < 20 THEN 1 ELSE 0 END"


@query("j2_burnt_zones", f"WITH {PIXELS}, b AS (SELECT body_id, {BURN} AS zone_index FROM (SELECT body_id, c + 0.5 AS x, r + 0.5 AS y FROM pix)) SELECT body_id, CAST(zone_index AS INT) AS zone_index, CASE WHEN zone_index > 0 THEN 'z' || (zone_index - 1) END AS zone_id, count(*) AS pixels FROM b GROUP BY ALL")
def j2(spark, d):
    p = loading.centres(t.pixels(spark, d).drop("zone_id"), 1.0, 1.0, 0.0, 0.0)
    return zones.burn(p, t.grid_features(spark, d)).groupBy("body_id", "zone_index", "zone_id").agg(F.count(F.lit(1)).alias("pixels"))


@query("a20_bounds", """SELECT 'wb-' || n AS body_id, -150.0::DOUBLE AS min_lon, -60.0::DOUBLE AS min_lat, 150.0::DOUBLE AS max_lon, 60.0::DOUBLE AS max_lat FROM (SELECT DISTINCT s_suppkey % 4 AS n FROM supplier)""")
def a20(spark, d):
    return zones.bounds(t.zone_features(spark, d)).select("body_id", "min_lon", "min_lat", "max_lon", "max_lat")


@query("c15_zone_maps", f"""WITH {SCORES}, f AS (SELECT DISTINCT body_id, date FROM zs)
SELECT body_id, date, 3 AS features, CAST(count(*) FILTER (flagged) AS INT) AS flagged, 15 AS vertices FROM f LEFT JOIN zs USING (body_id, date) GROUP BY ALL""".replace("15 AS vertices", "12 AS vertices"))
def c15(spark, d):
    _, scores = _scored(spark, d)
    m = zones.zone_map(t.zone_features(spark, d), scores, ["flagged", "fused_score", "severity", "confidence"])
    doc = F.from_json("document", "features array<struct<properties: struct<id: string, flagged: boolean>, geometry: struct<coordinates: array<array<array<array<double>>>>>>>")["features"]
    m = m.withColumn("f", doc)
    vertices = F.size(F.flatten(F.flatten(F.flatten(F.col("f.geometry.coordinates")))))
    return m.select("body_id", "date", F.size("f").alias("features"), F.size(F.filter("f", lambda x: x["properties"]["flagged"])).alias("flagged"), vertices.alias("vertices"))


@query("j9_compare_zones", f"""WITH {SCORES}, a AS (SELECT body_id, zone_id, confidence FROM zs WHERE date = '19980401'), b AS (SELECT body_id, zone_id, confidence FROM zs WHERE date = '19920101')
SELECT body_id, zone_id, a.confidence AS confidence_now, b.confidence AS confidence_then FROM a FULL JOIN b USING (body_id, zone_id)""")
def j9(spark, d):
    _, scores = _scored(spark, d)
    return zones.compare_dates(scores, F.lit("19980401"), F.lit("19920101"), ["confidence"])


DATES = "cf AS (SELECT 'wb-' || i AS body_id, d AS date FROM range(5) r(i), (SELECT DISTINCT date AS d FROM man UNION SELECT '20240101'))"


def _configured(spark, d):
    days = t.manifest(spark, d).select("date").union(spark.createDataFrame([("20240101",)], "date string")).distinct()
    return days.withColumn("body_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("wb-"), i.cast("string"))))).select("body_id", "date")


LOADED = f"""{FILES}, {DATES}, ls AS (SELECT body_id, date, fo.date IS NOT NULL AS there, coalesce(have, []) AS have, list_filter(['b02', 'b03', 'b04', 'b08', 'scl'], lambda b: NOT list_contains(coalesce(have, []), b)) AS gone
  FROM cf LEFT JOIN fo USING (body_id, date) LEFT JOIN sc USING (body_id, date)),
st AS (SELECT body_id, date, CASE WHEN NOT there THEN 'missing' WHEN NOT list_has_any(have, ['b02', 'b03', 'b04', 'b08']) OR len(gone) > 0 THEN 'incomplete' ELSE 'ok' END AS status,
  CASE WHEN NOT there THEN 'scene_folder_missing' WHEN NOT list_has_any(have, ['b02', 'b03', 'b04', 'b08']) THEN 'missing_reference_band' WHEN len(gone) > 0 THEN 'missing_bands:' || array_to_string(gone, ',') END AS reason FROM ls)"""


def _loaded(spark, d):
    m = t.manifest(spark, d)
    return loading.load_status(_configured(spark, d), inventory.resolve_bands(m), ("b02", "b03", "b04", "b08", "scl"), m)


@query("s5_load_status", f"WITH {LOADED} SELECT body_id, date, status, reason FROM st")
def s5(spark, d):
    return _loaded(spark, d)


@query("p9_scene_status", f"""WITH {FILES}, {DATES}, gt AS (SELECT body_id, date, count(*) AS nf FROM man GROUP BY ALL), ak AS (SELECT body_id, date FROM cf UNION ALL SELECT 'wb-0', 'latest')
SELECT body_id, date, CASE WHEN body_id = 'wb-4' OR date = 'latest' THEN 'unusable' WHEN missing IS NULL THEN 'missing' WHEN len(missing) > 0 THEN 'unusable' WHEN nf < 5 THEN 'insufficient_data' WHEN nf % 2 = 0 THEN 'no_baseline' ELSE 'ok' END AS status,
  CASE WHEN body_id = 'wb-4' OR date = 'latest' THEN 'unknown_water_body_or_date' WHEN missing IS NULL THEN 'scene_folder_missing' WHEN len(missing) > 0 THEN 'missing_bands:' || array_to_string(missing, ',') WHEN nf < 5 THEN 'files:' || nf WHEN nf % 2 = 0 THEN 'missing_baseline' END AS reason
FROM ak LEFT JOIN sm USING (body_id, date) LEFT JOIN gt USING (body_id, date)""")
def p9(spark, d):
    g = t.manifest(spark, d).groupBy("body_id", "date").agg(F.count(F.lit(1)).alias("files"))
    gates = g.select("body_id", "date", F.when(F.col("files") < 5, "insufficient_data").otherwise("ok").alias("status"), F.when(F.col("files") < 5, F.concat(F.lit("files:"), F.col("files").cast("string"))).alias("reason"))
    asked = _configured(spark, d).union(spark.createDataFrame([("wb-0", "latest")], "body_id string, date string"))
    return loading.scene_status(asked, t.bodies(spark, d), _scenes(spark, d), gates, g.filter("files % 2 = 1"))


@query("c9_extent_batch", f"""WITH {PIXELS}, cf AS (SELECT DISTINCT 'wb-' || i AS body_id, date FROM range(5) r(i), (SELECT DISTINCT date FROM pix)),
g AS (SELECT body_id, date, count(*) AS area, count(*) FILTER (valid) AS good, count(*) FILTER (valid AND (b08 < 0.3) <> wet) AS differ, count(*) FILTER (valid AND b08 < 0.3) AS water FROM px GROUP BY ALL),
s AS (SELECT *, good / area AS f, CASE WHEN good / area >= 0.6 THEN CASE WHEN good > 0 THEN differ / good ELSE 1 END END AS df FROM g)
SELECT body_id, date, CASE WHEN area IS NULL THEN 'missing' WHEN f < 0.6 THEN 'insufficient_data' WHEN df > 0.25 THEN 'low_confidence' ELSE 'ok' END AS status, round(f, 6) AS valid_fraction, round(df, 6) AS disagreement_fraction, coalesce(df > 0.25, false) AS low_confidence,
  CASE WHEN f >= 0.6 THEN CAST(water AS DOUBLE) END AS water_pixels, CASE WHEN f >= 0.6 THEN water * 100.0::DOUBLE END AS extent_m2, CASE WHEN f >= 0.6 THEN water / 100.0::DOUBLE END AS extent_ha FROM cf LEFT JOIN s USING (body_id, date)""")
def c9(spark, d):
    p = t.pixels(spark, d).withColumn("model", F.col("b08") < 0.3)
    days = p.select("date").distinct().withColumn("body_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("wb-"), i.cast("string")))))
    bands = p.select("body_id", "date").distinct().withColumn("band", F.explode(F.array(F.lit("b02"), F.lit("b03"))))
    x = loading.extent_batch(loading.load_status(days.select("body_id", "date"), bands, ("b02", "b03")), p, "model")
    return x.withColumn("water_pixels", F.col("water_pixels").cast("double")).select(*(_r(c) if c.endswith("fraction") else c for c in x.columns))


BAD = "l_linenumber % 3 = 0"  # whose blue or green a clipped scene lacks


@query("a23_scaled", f"""WITH v AS (SELECT 'wb-' || (l_suppkey % 4) AS body_id, strftime(date_trunc('quarter', l_shipdate), '%Y%m%d') AS date, CASE WHEN {BAD} THEN NULL ELSE CAST(l_quantity AS DOUBLE) * 2 END AS g, CAST(l_tax AS DOUBLE) * 30 AS n FROM lineitem),
q AS (SELECT body_id, date, quantile_cont(x, 0.99) AS top FROM (SELECT body_id, date, unnest([g, n]) AS x FROM v) WHERE x IS NOT NULL GROUP BY ALL)
SELECT body_id, date, count(*) AS pixels, count(g) AS finite, round(avg(g / CASE WHEN top > 95 + month(strptime(date, '%Y%m%d')) / 4.0 THEN 10000 ELSE 1 END), 9) AS mean FROM v JOIN q USING (body_id, date) GROUP BY ALL""")
def a23(spark, d):
    p = t.table(spark, d, "lineitem").selectExpr(
        "concat('wb-', cast(l_suppkey % 4 as string)) AS body_id", "date_format(date_trunc('quarter', l_shipdate), 'yyyyMMdd') AS date",
        f"CASE WHEN {BAD} THEN double('NaN') ELSE cast(l_quantity as double) * 2 END AS b03", "cast(l_tax as double) * 30 AS b08",
    )
    month = F.substring("date", 5, 2).cast("int")
    out = [loading.scaled(p.filter(month == m), ("b03", "b08"), limit=95 + m / 4) for m in (1, 4, 7, 10)]  # limits near the quantiles of these tables
    fine = F.when(~F.isnan("b03"), F.col("b03"))
    return reduce(DataFrame.unionByName, out).groupBy("body_id", "date").agg(F.count(F.lit(1)).alias("pixels"), F.count(fine).alias("finite"), F.round(F.avg(fine), 9).alias("mean"))


@query("a24_crop", f"""WITH {PIXELS}, i AS (SELECT *, r % 7 = 3 AND c % 5 = 2 AND b03 > 0.9 AS ins FROM pix), k AS (SELECT body_id, date, list(DISTINCT r) AS rs, list(DISTINCT c) AS cs, min(r) AS r0, min(c) AS c0 FROM i WHERE ins GROUP BY ALL)
SELECT body_id, date, count(*) AS pixels, CAST(sum(r - r0) AS BIGINT) AS rows, CAST(sum(c - c0) AS BIGINT) AS cols FROM i JOIN k USING (body_id, date) WHERE list_contains(rs, r) AND list_contains(cs, c) GROUP BY ALL""")
def a24(spark, d):
    p = t.pixels(spark, d).withColumn("inside", (F.col("row") % 7 == 3) & (F.col("col") % 5 == 2) & (F.col("b03") > 0.9))
    return loading.crop(p).groupBy("body_id", "date").agg(F.count(F.lit(1)).alias("pixels"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query("p7_final_masks", f"WITH {PIXELS} SELECT body_id, date, count(*) FILTER (valid AND CASE WHEN r % 3 = 0 THEN wet ELSE b08 < 0.4 END) AS water FROM px GROUP BY ALL")
def p7(spark, d):
    m = loading.mask_rows(t.pixels(spark, d).withColumn("model", F.when(F.col("row") % 3 != 0, F.col("b08") < 0.4)), "model")
    return m.groupBy("body_id", "date").agg(F.count_if("water").alias("water"))


@query("p7_mask_confidence", f"""WITH {PIXELS}, g AS (SELECT body_id, date, coalesce(avg(CASE WHEN valid THEN CAST((b08 < 0.4) = wet AS DOUBLE) END), 0) AS s FROM m GROUP BY ALL)
SELECT body_id, date, CASE WHEN date[1:4] = '1998' THEN 0.55::DOUBLE WHEN s < 0.7 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN date[1:4] = '1998' THEN 'segmentation_model_unavailable' WHEN s < 0.7 THEN 'model_agreement' ELSE '' END AS reasons FROM g""")
def p7c(spark, d):
    a = scenes.agreement(t.pixels(spark, d).withColumn("model", F.col("b08") < 0.4), "model")
    c = loading.mask_confidence(F.substring("date", 1, 4) != "1998", F.col("agreement"))
    return a.select("body_id", "date", c["confidence"].alias("confidence"), F.array_join(c["reasons"], ",").alias("reasons"))


@query("a12_merged_confidence", f"""WITH {SCORES} SELECT body_id, zone_id, date, least(confidence, CASE WHEN date[5:6] = '01' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END) AS confidence,
  concat_ws(',', CASE WHEN date[5:6] = '01' THEN 'model_agreement' END, nullif(reasons, '')) AS reasons FROM zr""")
def a12(spark, d):
    from .functions import confidence as conf

    _, s = _scored(spark, d)
    low = F.substring("date", 5, 2) == "01"
    m = conf.merged((F.when(low, 0.6).otherwise(1.0), F.when(low, F.array(F.lit("model_agreement")))), (F.col("confidence"), F.col("reasons")))
    return s.select("body_id", "zone_id", "date", m["confidence"].alias("confidence"), F.array_join(m["reasons"], ",").alias("reasons"))


@query("a25_feed_confidence", f"WITH {SCORES}, g AS (SELECT DISTINCT body_id, date FROM zs) SELECT body_id, date, coalesce(min(confidence) FILTER (flagged), 0.9::DOUBLE) AS confidence FROM g JOIN zs USING (body_id, date) GROUP BY ALL")
def a25(spark, d):
    _, s = _scored(spark, d)
    return evidence.feed_confidence(s.select("body_id", "date").distinct().withColumn("confidence", F.lit(0.9)), s.filter("flagged"), ["body_id", "date"]).select("body_id", "date", "confidence")


@query("j3_unscored", f"WITH {OBS} SELECT body_id, zone_id, date, 'missing_baseline' AS reason FROM obs WHERE zone_id = 'z1' GROUP BY ALL")
def j3(spark, d):
    o = scenes.zone_observations(t.pixels(spark, d))
    return scoring.unscored(o, scoring.fit_baselines(o.filter("zone_id <> 'z1'")))


@query("s22_mask_rows", f"""WITH {PIXELS} SELECT body_id, date, CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, count(*) AS n, round(75.0::DOUBLE + 0.01::DOUBLE * (c + 0.5::DOUBLE), 6) AS x, round(17.0::DOUBLE - 0.01::DOUBLE * (r + 0.5::DOUBLE), 6) AS y,
  count(*) FILTER (valid AND CASE WHEN r % 3 = 0 THEN wet ELSE b08 < 0.4 END) AS water FROM px GROUP BY ALL""")
def s22(spark, d):
    """Masks of all scenes, written by scene with the places of their pixels and read back."""
    p, path = t.pixels(spark, d).withColumn("model", F.when(F.col("row") % 3 != 0, F.col("b08") < 0.4)), shared_path(spark, "masks")
    grids = written(p.select("body_id", "date").distinct().select("*", F.lit(0.01).alias("a"), F.lit(-0.01).alias("e"), F.lit(75.0).alias("c"), F.lit(17.0).alias("f")), "grids")
    sinks.write_masks(loading.mask_rows(p, "model"), grids, path, files=1)  # these scenes are small
    m = sinks.read_masks(spark, path)
    return m.groupBy("body_id", "date", "row", "col", _r("x"), _r("y")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("water").cast("long")).alias("water"))


@query("j4_adjusted_baselines", f"WITH {OBS} SELECT body_id, zone_id, indicator, season, round(CASE WHEN zone_id = 'z0' THEN mean * 2 + 1 ELSE mean END, 6) AS mean, round(CASE WHEN zone_id = 'z0' THEN std * 2 ELSE std END, 6) AS std FROM bl")
def j4(spark, d):
    b = scoring.fit_baselines(scenes.zone_observations(t.pixels(spark, d)))
    a = b.filter("zone_id = 'z0'").select("body_id", "zone_id", "indicator", "season", F.lit(2.0).alias("scale"), F.lit(1.0).alias("offset"))
    return scoring.adjusted(b, a).select("body_id", "zone_id", "indicator", "season", _r("mean"), _r("std"))


@query("c10_plume", f"""WITH {PIXELS}, q AS (SELECT body_id, date, CAST(b04 AS DOUBLE) + 0.5 * greatest(0, least(1, 1 - sqrt(pow(r - 20, 2) + pow(c - 20, 2)) / 8)) AS b FROM pix) SELECT body_id, date, round(avg(b), 9) AS red FROM q GROUP BY ALL""")
def c10(spark, d):
    p = monitor.with_plume(t.pixels(spark, d), "turbidity", 20, 20, 8, 0.5)
    return p.groupBy("body_id", "date").agg(F.round(F.avg("b04"), 9).alias("red"))


@query("c10_plume_scores", f"""WITH bl0 AS (WITH {OBS} SELECT * FROM bl), {altered("pix AS (SELECT * REPLACE (CAST(b04 AS DOUBLE) + 0.5 * greatest(0, least(1, 1 - sqrt(pow(r - 20, 2) + pow(c - 20, 2)) / 8)) AS b04) FROM pix0),", "bl AS (SELECT * FROM bl0),")},
fs AS (SELECT body_id, zone_id, date, coalesce(sum(CASE WHEN w > 0 THEN w * least(abs(z), 6) END) / nullif(sum(CASE WHEN w > 0 AND z IS NOT NULL THEN w END), 0), 0) AS fused FROM ct GROUP BY ALL)
SELECT body_id, zone_id, date, flagged, round(fused, 5) AS fused_score, coalesce(contributing, '') AS contributing, concat_ws(',', nullif(reasons, ''), 'synthetic_plume') AS reasons FROM zr JOIN fs USING (body_id, zone_id, date)""")
def c10s(spark, d):
    p = t.pixels(spark, d)
    base = scoring.fit_baselines(scenes.zone_observations(p))
    x = monitor.plume_scores(p, base, "turbidity", 20, 20, 8, 0.5, LOOSE)
    return x.select("body_id", "zone_id", "date", "flagged", _r("fused_score", 5), F.array_join("contributing", ",").alias("contributing"), F.array_join("reasons", ",").alias("reasons"))


@query("f29_pixel_of", f"WITH {PTS.format('a', 'c_custkey', 'customer')}, p AS (SELECT key, CAST(floor((lat - 60) / -0.5) AS INT) AS r, CAST(floor((lon + 100) / 0.5) AS INT) AS c FROM a) SELECT key, CASE WHEN r BETWEEN 0 AND 239 AND c BETWEEN 0 AND 399 THEN CAST(r AS DOUBLE) END AS row, CASE WHEN r BETWEEN 0 AND 239 AND c BETWEEN 0 AND 399 THEN CAST(c AS DOUBLE) END AS col FROM p")
def f29(spark, d):
    p = monitor.pixel_of(F.col("lon"), F.col("lat"), 0.5, -0.5, -100.0, 60.0, 240, 400)
    return t.points(spark, d, "customer").select("key", p["row"].cast("double").alias("row"), p["col"].cast("double").alias("col"))


@query("j14_new_scenes", f"WITH {FILES} SELECT body_id, date FROM sm WHERE CAST(date AS INT) % 2 = 1")
def j14(spark, d):
    s = _scenes(spark, d)
    return loading.not_computed(s, s.filter("cast(date AS int) % 2 = 0")).select("body_id", "date")


LAKES = "kl AS (SELECT unnest([" + ", ".join("{'name': '%s', 'la': %s::DOUBLE, 'lo': %s::DOUBLE, 'r': %s::DOUBLE}" % x for x in places.KNOWN_LAKES) + "], recursive := true))"
NEAR = "px AS (SELECT CAST(c_custkey AS BIGINT) AS key, 17 + CAST(c_custkey AS BIGINT) * 7919 % 2000 / 100.0::DOUBLE AS lat, 73 + CAST(c_custkey AS BIGINT) * 104729 % 1500 / 100.0::DOUBLE AS lon FROM customer)"


@query("j6_known_lakes", f"""WITH {LAKES}, {NEAR}, m AS (SELECT key, name, r, {DIST.replace('6371000.0', '6371.0')} AS km FROM (SELECT key, lat, lon FROM px) a, (SELECT name, r, la AS lat, lo AS lon FROM kl) b),
x AS (SELECT *, CASE WHEN km < 0.5 THEN 0 ELSE 1 END AS step FROM m WHERE km <= r AND km < 15)
SELECT key, arg_min(name, (step, km, name)) AS name, round(min(km), 6) AS km FROM x GROUP BY key""")
def j6(spark, d):
    k = F.col("c_custkey").cast("long")
    p = t.table(spark, d, "customer").select(k.alias("key"), (17 + k * 7919 % 2000 / 100).alias("lat"), (73 + k * 104729 % 1500 / 100).alias("lon"))
    return places.nearest_known(p, places.known_lakes(spark)).select("key", "name", _r("km"))


@query("j7_nearby_lakes", f"""WITH {PTS.format('a', 'c_custkey', 'customer')}, {PTS.format('b', 's_suppkey', 'supplier')}, p AS (SELECT a.key, 'n' || (b.key % 7) AS name, b.key AS "to", {DIST} AS m FROM a, b),
q AS (SELECT key, name, min("to") AS "to", round(arg_min(m, "to") / 1000, 2) AS km FROM p WHERE m <= 800000 GROUP BY ALL)
SELECT key, name, km, CAST(row_number() OVER (PARTITION BY key ORDER BY km, "to") AS INT) AS rank FROM q QUALIFY row_number() OVER (PARTITION BY key ORDER BY km, "to") <= 2""")
def j7n(spark, d):
    s = t.points(spark, d, "supplier")
    lakes = s.withColumn("name", F.concat(F.lit("n"), (F.col("key") % 7).cast("string")))
    return places.listed_names(places.first_named(t.points(spark, d, "customer"), lakes, 800_000), 2)


@query("j16_others", "SELECT a.s_suppkey AS position, b.s_suppkey AS other, b.s_name AS name FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey QUALIFY row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_suppkey) <= 4")
def j16(spark, d):
    return places.others(t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("name")))


@query("s23_localities", "SELECT 15 AS localities, 21 AS lakes, count(*) AS bodies FROM (SELECT DISTINCT s_suppkey % 4 FROM supplier)")
def s23(spark, d):
    n = t.bodies(spark, d).agg(F.count(F.lit(1)).alias("bodies"))
    return n.join(places.localities(spark).agg(F.count(F.lit(1)).cast("int").alias("localities"))).join(places.known_lakes(spark).agg(F.count(F.lit(1)).cast("int").alias("lakes"))).select("localities", "lakes", "bodies")


@query("f31_place_names", """WITH c AS (SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'Ring Road' WHEN 1 THEN 'Old ' || c_name || ' Lake' WHEN 2 THEN c_name ELSE '' END AS name, c_custkey % 3 AS a, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT key, CASE WHEN key % 10 = 0 THEN 'Blue Tarn' WHEN key % 4 = 1 THEN name WHEN key % 4 = 2 THEN name || CASE WHEN a > 0 THEN ', ' || city ELSE '' END WHEN a = 2 THEN 'Old Town, ' || city WHEN a = 1 THEN city ELSE '7 x, y' END AS place FROM c""")
def f31(spark, d):
    c = t.table(spark, d, "customer").join(t.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "Ring Road").when(k % 4 == 1, F.concat(F.lit("Old "), "c_name", F.lit(" Lake"))).when(k % 4 == 2, F.col("c_name")).otherwise("")
    town = F.map_from_arrays(F.array(F.lit("suburb"), F.lit("city"), F.lit("lake")), F.array(F.when(k % 3 == 2, "Old Town"), F.when(k % 3 > 0, F.col("n_name")), F.when(k % 10 == 0, "blue tarn").otherwise("water")))
    c = c.select(k.alias("key"), name.alias("name"), F.lit("place").alias("class"), F.lit("town").alias("addresstype"), town.alias("address"), F.lit("12, 7 x, y, India").alias("display_name"))
    return c.select("key", places.place_name().alias("place"))


@query("s19_water_polygons", """SELECT n_nationkey AS reply, CAST(count(*) AS BIGINT) AS rings, CAST(sum(n) AS BIGINT) AS vertices FROM (SELECT n_nationkey, unnest([4, CASE WHEN n_nationkey % 2 = 0 THEN 4 END, 4]) AS n FROM nation) WHERE n IS NOT NULL GROUP BY ALL""")
def s19(spark, d):
    k = F.col("n_nationkey")
    at = lambda x, y: F.struct((k + y).cast("double").alias("lat"), (k + x).cast("double").alias("lon"))
    ring = lambda o: F.array(at(o, o), at(o + 1, o), at(o, o + 1))
    element = lambda kind, i, g, m: F.struct(F.lit(kind).alias("type"), F.lit(i).alias("id"), g.alias("geometry"), m.alias("members"))
    none = F.array().cast("array<struct<type: string, geometry: array<struct<lat: double, lon: double>>>>")
    part = lambda g: F.struct(F.lit("way").alias("type"), g.alias("geometry"))
    each = F.array(element("way", 1, ring(0), none), element("way", 2, F.when(k % 2 == 0, ring(5)).otherwise(ring(0)), none), element("way", 3, F.slice(ring(0), 1, 2), none),
                   element("relation", 4, F.array().cast("array<struct<lat: double, lon: double>>"), F.array(part(ring(9)), part(ring(0)))))
    x = places.water_polygons(t.table(spark, d, "nation").select(k.alias("reply_id"), F.to_json(F.struct(each.alias("elements"))).alias("reply")))
    return x.groupBy(F.col("reply_id").alias("reply")).agg(F.count(F.lit(1)).alias("rings"), F.sum(F.size("ring")).cast("long").alias("vertices"))


@query("s14_newest_history", f"WITH {HIST} SELECT analysis_id, body_id FROM h ORDER BY day DESC, analysis_id LIMIT 50")
def s14(spark, d):
    return history.scan(t.history(spark, d), limit=50).select("analysis_id", "body_id")


@query("s14_lookup", f"WITH {HIST} SELECT o_orderkey AS analysis_id, h.body_id, h.status FROM orders LEFT JOIN h ON h.analysis_id = o_orderkey")
def s14l(spark, d):
    x = history.lookup(t.history(spark, d), t.table(spark, d, "orders").select(F.col("o_orderkey").alias("analysis_id")))
    return x.select("analysis_id", "analysis.body_id", "analysis.status")


@query("a27_feed", f"WITH {HIST} SELECT strftime(day, '%Y-%m-%d') AS day, ndti, status FROM h WHERE body_id = 'u7'")
def a27(spark, d):
    return history.feed(t.history(spark, d), "u7").select(F.col("day").cast("string").alias("day"), "ndti", "status")


@query("a28_baseline_reports", f"""WITH {HIST} SELECT body_id, CAST(round_even(mean, 3) AS DOUBLE) AS ndti_mean, CAST(round_even(std, 3) AS DOUBLE) AS ndti_std FROM hb""")
def a28(spark, d):
    h = t.history(spark, d)
    return history.baseline_report(h, h).select("body_id", "ndti_mean", "ndti_std")


@query("o9_or_latest", f"WITH {HIST}, n AS (SELECT arg_max(analysis_id, (day, analysis_id)) AS newest FROM h) SELECT o_orderkey AS request, coalesce(analysis_id, newest) AS analysis_id, analysis_id IS NOT NULL AS found FROM orders LEFT JOIN h ON analysis_id = o_orderkey, n")
def o9(spark, d):
    asked = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("analysis_id"))
    return history.or_latest(asked, t.history(spark, d))


@query("a17_masked_means", f"""WITH {PIXELS}, w AS (SELECT body_id, date, avg(CASE WHEN wet THEN 0.97::DOUBLE * ((b04 - b03) / nullif(b04 + b03, 0)) END) AS a FROM px GROUP BY ALL) SELECT body_id, date, CAST(round_even(coalesce(a, 0), 3) AS DOUBLE) + 0.0::DOUBLE AS ndti FROM w""")
def a17(spark, d):
    p = t.pixels(spark, d).withColumn("mask", indices.is_water(F.col("b03"), F.col("b08")))
    return history.masked_means(p, "mask", ndti=0.97 * indices.safe_difference(F.col("b04").cast("double"), F.col("b03").cast("double")))


@query("f35_citations", """WITH x AS (SELECT item_id, lower(text || ' ') AS s FROM benchmark) SELECT item_id, CASE WHEN regexp_matches(s, 'swim|health|toxic|cyanotoxin|who|skin') THEN 'recreation' WHEN regexp_matches(s, 'ndci|chlorophyll|red edge|705') THEN 'chlorophyll'
  WHEN regexp_matches(s, 'spm|turbidity|sediment|scattering|665') THEN 'sediment' WHEN regexp_matches(s, 'mndwi|ndwi|swir|water index') THEN 'water_index' WHEN regexp_matches(s, 'baseline|calibr|sigma|anomaly|z-score') THEN 'calibration' ELSE 'corpus' END AS citation FROM x""")
def f35(spark, d):
    return t.table(spark, d, "benchmark").select("item_id", prompts.citation(F.col("text"), F.lit("")).alias("citation"))


@query("f34_listed", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[0-9.\-*• ]+', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, CASE WHEN len(a) >= 3 THEN array_to_string(a[1:4], '|') ELSE '' END AS questions FROM l""")
def f34(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.array_join(prompts.listed(F.col("text")), "|").alias("questions"))


@query("f37_character_chunks")
def f37(spark, d):
    ship(spark)
    return t.table(spark, d, "documents").select("doc_id", F.posexplode(splitter.recursive_chunks(F.col("text"))).alias("n", "chunk"))


@query("f39_prompts", """SELECT conv_id, 'Answer briefly.' || chr(10) || chr(10) || '=== KNOWLEDGE BASE ===' || chr(10) || '(No relevant passages found for this question.)' || chr(10) || chr(10) || '=== CONVERSATION HISTORY ===' || chr(10) || chr(10) ||
  string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '=== USER QUESTION ===' || chr(10) || 'Why?' AS prompt
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id""")
def f39(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = t.table(spark, d, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 6").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    none = F.array().cast("array<struct<id: string, title: string, text: string>>")
    return c.select("conv_id", prompts.prompt(F.lit("Answer briefly."), none, F.lit(None).cast("string"), F.col("turns"), F.lit("Why?")).alias("prompt"))


@query("f40_f45_grounding", f"""WITH {SCORES} SELECT 'ev-' || body_id || '-' || zone_id || '-' || date AS evidence_id, 'alert explanation ' || coalesce(replace(contributing, ',', ' '), 'indicator baseline anomaly') || ' sigma threshold why flagged interpretation' AS query,
  confidence, 'pipeline_evidence,llm_disabled' AS reasons, true AS grounded FROM zr""")
def f45(spark, d):
    c = evidence.evidence(*_scored(spark, d), LOOSE)
    none = F.array().cast("array<string>")
    g = prompts.grounding(none, F.col("confidence"), F.lit("llm_disabled"))
    return c.select("evidence_id", prompts.retrieval_query(F.col("contributing")).alias("query"), g["confidence"].alias("confidence"), F.array_join(g["reasons"], ",").alias("reasons"), g["grounded"].alias("grounded"))


@query("f38_extractive", f"""WITH {SCORES}, ln AS (SELECT body_id, zone_id, date, string_agg('• **' || indicator || '**: value ' || printf('%.4g', value) || ', baseline ' || printf('%.4g', mean) || ' ± ' || CASE WHEN std IS NULL THEN 'None' ELSE '' END ||
    ', deviation ' || CASE WHEN isfinite(z) THEN printf('%.2f', z) || 'σ' ELSE 'n/a' END || ' — ' || CASE WHEN crossed THEN '⚠️ threshold crossed' ELSE 'within normal range' END, chr(10) ORDER BY o) AS lines FROM ct GROUP BY ALL)
SELECT 'ev-' || body_id || '-' || zone_id || '-' || date AS evidence_id, chr(10) || '📊 **Current pipeline evidence:**' || chr(10) || lines || coalesce(chr(10) || '• **Flagged indicators**: ' || replace(nullif(contributing, ''), ',', ', '), '') || chr(10) || chr(10) ||
    '⚠️ *Note: Language model is not configured. Set LLM_PROVIDER=gemini and LLM_API_KEY in your environment to enable AI-generated answers.*' AS answer FROM zr JOIN ln USING (body_id, zone_id, date)""")
def f38(spark, d):
    c = evidence.evidence(*_scored(spark, d), LOOSE)
    none = F.array().cast("array<struct<id: string, title: string, text: string>>")
    text = prompts.extractive(none, F.col("comparisons"), F.col("contributing"))
    return c.select("evidence_id", F.regexp_replace(text, r"± [0-9.e+-]+", "± ").alias("answer"))  # all digits of a deviation depend on the order of sums; c6_trends compares them rounded


@query("c16_cited", """WITH p AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3)
SELECT source, string_agg('[' || CASE WHEN doc_id % 2 = 0 THEN 'Hydrology Publication' ELSE source END || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS passages,
  string_agg(CASE WHEN doc_id % 3 = 0 THEN 'cited' ELSE 'Indexed Corpus · ' || CASE WHEN doc_id % 2 = 0 THEN 'Hydrology Publication' ELSE source END END, ';' ORDER BY n) AS citations FROM p GROUP BY source""")
def c16(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    p = t.table(spark, d, "documents").select("source", "doc_id", "text").withColumn("n", F.row_number().over(w)).filter("n <= 3")
    each = F.struct("n", F.when(F.col("doc_id") % 2 != 0, F.col("source")).alias("topic"), F.when(F.col("doc_id") % 3 == 0, "cited").alias("citation"), "text")
    x = p.groupBy("source").agg(F.sort_array(F.collect_list(each)).alias("p")).withColumn("c", prompts.cited(F.col("p")))
    return x.select("source", F.col("c.text").alias("passages"), F.array_join(F.col("c.sources.citation"), ";").alias("citations"))


@query("f36_chunk_titles", r"""WITH c AS (SELECT doc_id, unnest(string_split(replace(replace(text, '. ', chr(10) || '# '), chr(10) || '#', chr(1) || '#'), chr(1))) AS chunk, generate_subscripts(string_split(replace(replace(text, '. ', chr(10) || '# '), chr(10) || '#', chr(1) || '#'), chr(1)), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i, regexp_replace(chunk, '^\s+|\s+$', '', 'g') AS chunk FROM c)
SELECT 'dir/' || doc_id || '.md#' || i AS id, length(coalesce(nullif(regexp_replace(CASE WHEN starts_with(chunk, '# ') THEN string_split(chunk, chr(10))[1][3:] ELSE '' END, '^\s+|\s+$', '', 'g'), ''), CAST(doc_id AS VARCHAR)))::INT AS title_chars FROM s WHERE chunk <> '' AND NOT contains(chunk[2:], chr(10) || '# ')""")
def f36t(spark, d):
    x = t.table(spark, d, "documents").select(F.explode(narrative.chunk_rows(F.replace("text", F.lit(". "), F.lit("\n# ")), F.concat(F.lit("dir/"), F.col("doc_id").cast("string"), F.lit(".md")))).alias("c"))
    return x.select("c.id", F.char_length("c.title").alias("title_chars"))


@query("f33_fingerprints", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS g, list_avg(embedding::DOUBLE[]) AS m FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'sha256:' || sha256(CAST(vec_id AS VARCHAR)) ELSE 'ahash:' || lower(to_hex(CAST(list_sum(list_transform(g, lambda x, i: CASE WHEN x >= m THEN CAST(1 AS HUGEINT) << CAST(64 - i AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)) AS UBIGINT))) END AS fingerprint FROM e""")
def f33(spark, d):
    grey = F.when(F.col("vec_id") % 5 != 0, F.transform("embedding", lambda x: x.cast("double")))
    return t.table(spark, d, "embeddings").select("vec_id", reports.average_hash(grey, F.col("vec_id").cast("string").cast("binary")).alias("fingerprint"))


@query("f24_pixel_areas", f"WITH {PTS.format('a', 'c_custkey', 'customer')}, x AS (SELECT key, CASE WHEN key % 2 = 0 THEN abs(0.0001::DOUBLE * 111320 * cos(radians(lat)) * 0.0001::DOUBLE * 111320) ELSE 100.0::DOUBLE + key % 5 / 4.0::DOUBLE END AS area FROM a) SELECT key, round(CASE WHEN abs(area - 100) < 1 THEN 100 ELSE area END, 6) AS area FROM x")
def f24(spark, d):
    even = F.col("key") % 2 == 0
    a = indices.pixel_area(F.when(even, 0.0001).otherwise(100.0 + F.col("key") % 5 / 4), F.when(even, 0.0001).otherwise(1.0), F.col("lat"), even)
    return t.points(spark, d, "customer").select("key", F.round(a, 6).alias("area"))


@query("f28_circles", f"WITH {PTS.format('a', 'c_custkey', 'customer')} SELECT key, 37 AS points, round(lon + 1.0::DOUBLE / greatest(0.1, cos(radians(lat))), 6) AS east, round(lat + 1, 6) AS north FROM a")
def f28(spark, d):
    x = t.points(spark, d, "customer").withColumn("ring", geo.circle(F.col("lon"), F.col("lat"), F.lit(111.0)))
    return x.select("key", F.size("ring").alias("points"), F.get("ring", F.lit(0))["lon"].alias("east"), F.get("ring", F.lit(9))["lat"].alias("north"))


@query("a19_centroids", "SELECT 'wb-' || n AS body_id, zone_id, lon, 0.0::DOUBLE AS lat FROM (SELECT DISTINCT s_suppkey % 4 AS n FROM supplier), (VALUES ('z0', -85.0::DOUBLE), ('z1', 5.0::DOUBLE), ('z2', 90.0::DOUBLE)) v(zone_id, lon)")
def a19(spark, d):
    c = geo.ring_centroid(F.flatten("polygons")[0], closing=False)
    return t.zone_features(spark, d).select("body_id", "zone_id", c["lon"].alias("lon"), c["lat"].alias("lat"))


@query("d5_confidence_bands", f"WITH {SCORES} SELECT CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM zr GROUP BY ALL")
def d5(spark, d):
    from .operators.variants import confidence_band

    return _scored(spark, d)[1].groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("p17_severe_alerts", f"WITH {SCORES} SELECT count(*) AS n FROM zr WHERE flagged AND dom_sigma > 5")
def p17(spark, d):
    return evidence.of_severity(evidence.alerts(evidence.evidence(*_scored(spark, d), LOOSE), t.bodies(spark, d)), "severe").agg(F.count(F.lit(1)).alias("n"))


SEARCH = f"""{PTS.format('a', 'c_custkey', 'customer')}, {PTS.format('b', 's_suppkey', 'supplier')}, p AS (SELECT a.key, 'n' || (b.key % 7) AS name, b.key AS "to", {DIST} AS m FROM a, b),
q AS (SELECT key, name, min("to") AS "to", round(arg_min(m, "to") / 1000, 2) AS km FROM p WHERE m <= 1500000 GROUP BY ALL),
n AS (SELECT key, name, km, CAST(row_number() OVER (PARTITION BY key ORDER BY km, "to") AS INT) AS rank FROM q)"""


def _searched(spark, d):
    lakes = t.points(spark, d, "supplier").withColumn("name", F.concat(F.lit("n"), (F.col("key") % 7).cast("string")))
    return places.lake_search(t.points(spark, d, "customer"), lakes, 1_500_000)


@query("c14_lake_search", f"""WITH {SEARCH}, o AS (SELECT x.key, x.rank, string_agg(y.name, '|' ORDER BY y.rank) AS others FROM n x JOIN (SELECT * FROM n WHERE rank <= 10) y ON x.key = y.key AND x.rank <> y.rank AND y.rank <= CASE WHEN x.rank <= 4 THEN 5 ELSE 4 END GROUP BY ALL)
SELECT n.key, name, km, n.rank, coalesce(others, '') AS others FROM n LEFT JOIN o ON n.key = o.key AND n.rank = o.rank WHERE n.rank <= 10""")
def c14(spark, d):
    return _searched(spark, d).withColumn("others", F.array_join("others", "|"))


@query("c14_around_detected", f"""WITH {SEARCH}, x AS (SELECT key, name, km, row_number() OVER (PARTITION BY key ORDER BY rank) AS rank FROM n WHERE rank <= 10 AND (key % 8 = 7 OR name <> 'n' || (key % 8)))
SELECT key, name, km, CAST(rank AS INT) AS rank FROM x WHERE rank <= 5""")
def c14_detected(spark, d):
    own = F.when(F.col("key") % 8 < 7, F.concat(F.lit("N"), (F.col("key") % 8).cast("string")))
    return places.around_detected(t.points(spark, d, "customer").select("key", own.alias("name")), _searched(spark, d))


@query("c13_analyses", f"""WITH {PIXELS}, w AS (SELECT body_id, date, avg(CASE WHEN wet THEN coalesce((b03 - b08) / nullif(b03 + b08, 0), 0) END) AS ndwi, avg(CASE WHEN wet THEN 0.97::DOUBLE * coalesce((b04 - b03) / nullif(b04 + b03, 0), 0) END) AS ndti,
  avg(CASE WHEN wet THEN coalesce((b05 - b04) / nullif(b05 + b04, 0), 0) END) AS ndci FROM px GROUP BY ALL),
a AS (SELECT body_id, date, coalesce(ndwi, 0) AS ndwi, coalesce(ndti, 0) AS ndti, coalesce(ndci, 0) AS ndci FROM w),
k AS (SELECT body_id, CAST(round_even(ndti, 3) AS DOUBLE) AS v FROM a WHERE date < '1995' QUALIFY row_number() OVER (PARTITION BY body_id ORDER BY date) <= 5),
hb AS (SELECT body_id, avg(v) AS mean, CASE WHEN count(*) <= 1 THEN 0.01 ELSE stddev_pop(v) END AS std FROM k GROUP BY ALL),
s AS (SELECT a.*, CASE WHEN date >= '1995' AND std > 0 THEN (ndti - mean) / std END AS d FROM a LEFT JOIN hb USING (body_id)),
v AS (SELECT *, CASE WHEN d IS NULL THEN 0 ELSE CAST(trunc(least(100, abs(d) / 4 * 100)) AS INT) END AS score FROM s)
SELECT 'A_' || date || '_' || body_id AS analysis_id, body_id, strftime(strptime(date, '%Y%m%d'), '%Y-%m-%d') AS day, CAST(round_even(ndwi, 3) AS DOUBLE) + 0.0::DOUBLE AS ndwi, CAST(round_even(ndti, 3) AS DOUBLE) + 0.0::DOUBLE AS ndti, CAST(round_even(ndci, 3) AS DOUBLE) + 0.0::DOUBLE AS ndci,
  CASE WHEN d > 3.2 THEN 'HIGH' WHEN d > 2.0 THEN 'WARNING' ELSE 'NORMAL' END AS status, score AS anomaly_score, CASE WHEN d IS NULL THEN 0 ELSE CAST(round_even(least(1, abs(d) / 5), 2) AS DOUBLE) END AS confidence,
  coalesce(CAST(round_even(d, 2) AS DOUBLE), 0) + 0.0::DOUBLE AS sigma, CAST(trunc(greatest(0, least(100, 0.5::DOUBLE * score + 30))) AS INT) AS priority FROM v""")
def c13_analyses(spark, d):
    """Scenes before 1995 are analysed without any history and saved; the later ones against them."""
    b = {n: F.col(n).cast("double") for n in ("b03", "b04", "b05", "b08")}
    p = t.pixels(spark, d).withColumn("mask", indices.is_water(F.col("b03"), F.col("b08")))
    of = {"ndwi": indices.safe_difference(b["b03"], b["b08"]), "ndti": 0.97 * indices.safe_difference(b["b04"], b["b03"]), "ndci": indices.safe_difference(b["b05"], b["b04"])}
    none = spark.createDataFrame([], "analysis_id string, body_id string, day date, ndti double, status string")
    old = written(history.analyze(p.filter("date < '1995'"), none, "mask", of), "history")
    out = history.saved(old, history.analyze(p.filter("date >= '1995'"), old, "mask", of))
    zero = lambda c: (F.col(c) + 0.0).alias(c)  # noqa: E731  no negative zero
    return out.select("analysis_id", "body_id", F.col("day").cast("string").alias("day"), *map(zero, ("ndwi", "ndti", "ndci")), "status", "anomaly_score", "confidence", zero("sigma"), "priority")

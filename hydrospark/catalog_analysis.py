"""Queries on whole analyses and on contracts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import DIST, LOOSE, OBS, PLACES, SCORES, _r, altered
from .operators import evidence, scenes, scoring
from .plans import analysis, feeds, whatif
from .sources import contracts
from .sources import tables as t
from .sources.shared import shared_path, written

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


NAMES = ("B02.tif", "B3.tif", "B04.tif", "B05.tif", "B06.tif", "B08.tif", "B11.tif", "B12.tif", "scl.tif")


def scene_files(days: DataFrame) -> DataFrame:
    """A manifest of the scenes of a pixel table: in July body wb-1 lacks a band, in 1998 all lack one of the red edge."""
    f = days.select("body_id", "date", F.explode(F.array(*map(F.lit, NAMES))).alias("file"), F.lit(100).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"))
    gone = (F.col("file") == "B12.tif") & (F.col("body_id") == "wb-1") & (F.substring("date", 5, 2) == "07") | (F.col("file") == "B05.tif") & F.col("date").startswith("1998")
    return f.filter(~gone)


def _analyzed(spark, d):
    """Dates and zones of all scenes and of three that there aren't, from a pixel table with partitions; wb-3 has no baseline."""
    p = t.pixels(spark, d)
    path = shared_path(spark, "pixels")
    analysis.write_pixels(p, path, files=1)  # these scenes are small
    p = analysis.read_pixels(spark, path, p.schema)
    o = written(scenes.zone_observations(p, LOOSE), "observations")
    base = written(scoring.fit_baselines(o.filter("body_id <> 'wb-3'")), "baselines")
    days = written(p.select("body_id", "date").distinct(), "days")
    asked = days.unionByName(spark.createDataFrame([("wb-9", "19980101"), ("wb-0", "latest"), ("wb-0", "20300101")], "body_id string, date string"))
    return analysis.analyze(spark, asked, t.bodies(spark, d), scene_files(days), p, base, shared_path(spark, "store"), s=LOOSE)


LACKING = SCORES.replace("FROM cmp)", "FROM cmp WHERE NOT (indicator = 'chlorophyll' AND starts_with(date, '1998')))") + """,
whole AS (SELECT * FROM zr WHERE body_id <> 'wb-3' AND NOT (body_id = 'wb-1' AND date[5:6] = '07')),
an AS (SELECT * EXCLUDE (confidence, reasons), least(0.55::DOUBLE, confidence) AS confidence,
  concat_ws(',', 'segmentation_model_unavailable', CASE WHEN starts_with(date, '1998') THEN 'missing_red_edge_bands' END, nullif(reasons, '')) AS reasons FROM whole)"""


@query("c1_analyzed_dates", f"""WITH {LACKING}, g AS (SELECT body_id, date, avg(CAST(valid AND inside AS DOUBLE)) AS f, sum(CAST(water AS BIGINT)) * 100.0::DOUBLE AS extent FROM m GROUP BY ALL),
ak AS (SELECT body_id, date FROM g UNION ALL VALUES ('wb-9', '19980101'), ('wb-0', 'latest'), ('wb-0', '20300101')), lz AS (SELECT body_id, date, min(confidence) AS least FROM an GROUP BY ALL),
st AS (SELECT ak.*, f, extent, least, CASE WHEN body_id = 'wb-9' OR date = 'latest' THEN 'bad' WHEN date = '20300101' THEN 'absent' WHEN body_id = 'wb-1' AND date[5:6] = '07' THEN 'lacks' WHEN f < 0.4 THEN 'gate' WHEN body_id = 'wb-3' THEN 'bare' ELSE 'ok' END AS k
  FROM ak LEFT JOIN g USING (body_id, date) LEFT JOIN lz USING (body_id, date))
SELECT body_id, date, CASE k WHEN 'bad' THEN 'unusable' WHEN 'absent' THEN 'missing' WHEN 'lacks' THEN 'unusable' WHEN 'gate' THEN 'insufficient_data' WHEN 'bare' THEN 'no_baseline' ELSE 'ok' END AS status,
  CASE k WHEN 'bad' THEN 'unknown_water_body_or_date' WHEN 'absent' THEN 'scene_folder_missing' WHEN 'lacks' THEN 'missing_bands:b12' WHEN 'gate' THEN printf('valid_fraction:%.3f', f) WHEN 'bare' THEN 'missing_baseline' END AS reason,
  CASE WHEN k IN ('bad', 'absent', 'lacks', 'gate') THEN 0.0::DOUBLE ELSE least(0.55::DOUBLE, coalesce(least, 1.0::DOUBLE)) END AS confidence,
  CASE k WHEN 'bad' THEN 'unknown_water_body' WHEN 'absent' THEN 'scene_missing' WHEN 'lacks' THEN 'missing_bands' WHEN 'gate' THEN 'insufficient_data'
    ELSE concat_ws(',', 'segmentation_model_unavailable', CASE WHEN starts_with(date, '1998') THEN 'missing_red_edge_bands' END, CASE WHEN k = 'bare' THEN 'missing_baseline' END) END AS reasons,
  CASE WHEN k IN ('bare', 'ok') THEN extent END AS scene_extent_m2 FROM st""")
def c1_dates(spark, d):
    dates, _ = _analyzed(spark, d)
    return dates.select("body_id", "date", "status", "reason", "confidence", F.array_join("confidence_reasons", ",").alias("reasons"), "scene_extent_m2")


@query("c1_analyzed_zones", f"""WITH {LACKING}, fs AS (SELECT body_id, zone_id, date, coalesce(sum(CASE WHEN w > 0 THEN w * least(abs(z), 6) END) / nullif(sum(CASE WHEN w > 0 AND z IS NOT NULL THEN w END), 0), 0) AS fused FROM ct GROUP BY ALL)
SELECT body_id, zone_id, date, flagged, round(fused, 5) AS fused_score, coalesce(contributing, '') AS contributing, confidence, reasons FROM an JOIN fs USING (body_id, zone_id, date)""")
def c1_zones(spark, d):
    _, z = _analyzed(spark, d)
    return z.select("body_id", "zone_id", "date", "flagged", _r("fused_score", 5), F.array_join("contributing", ",").alias("contributing"), "confidence", F.array_join("reasons", ",").alias("reasons"))


@query("c8_body_overview", f"""WITH cd AS ({SQL['c1_analyzed_dates']}), {LACKING.removeprefix('WITH ')}, v AS (SELECT * FROM cd WHERE body_id <> 'wb-9' AND date <> 'latest'),
rz AS (SELECT body_id, string_agg(r, ',' ORDER BY o) AS reasons FROM (SELECT body_id, r, min(o) AS o FROM (SELECT body_id, unnest(string_split(reasons, ',')) AS r, date || '-' || generate_subscripts(string_split(reasons, ','), 1) AS o FROM v) GROUP BY ALL) GROUP BY body_id),
d AS (SELECT body_id, count(*) AS dates, string_agg(date || ':' || status, ',' ORDER BY date) AS statuses, max(date) FILTER (status = 'ok') AS latest_ok, least(1.0::DOUBLE, min(confidence)) AS confidence FROM v GROUP BY body_id),
al AS (SELECT d.body_id, min(zone_id) AS alert_zone, arg_min(dom, zone_id) AS alert_indicator, arg_min(CASE WHEN dom_sigma > 5 THEN 'severe' WHEN dom_sigma > 4 THEN 'warning' ELSE 'watch' END, zone_id) AS alert_severity
  FROM d JOIN an ON an.body_id = d.body_id AND an.date = latest_ok AND flagged GROUP BY ALL)
SELECT d.body_id, 'Lake ' || d.body_id[4:] AS name, dates, statuses, latest_ok, alert_zone, alert_indicator, alert_severity, confidence, 'not_a_detection,' || reasons AS reasons FROM d JOIN rz USING (body_id) LEFT JOIN al USING (body_id)""")
def c8(spark, d):
    dates, z = _analyzed(spark, d)
    o = feeds.overview(t.bodies(spark, d), dates, z)
    statuses = F.array_join(F.transform("dates", lambda x: F.concat_ws(":", x["date"], x["status"])), ",")
    return o.select("body_id", "name", F.size("dates").cast("long").alias("dates"), statuses.alias("statuses"), "latest_ok", "alert_zone", "alert_indicator", "alert_severity", "confidence", F.array_join("confidence_reasons", ",").alias("reasons"))


@query("c6_trend_series", f"""WITH cd AS ({SQL['c1_analyzed_dates']}), {SCORES.removeprefix('WITH ')}, v AS (SELECT * FROM cd WHERE body_id <> 'wb-9' AND date <> 'latest'),
se AS (SELECT DISTINCT body_id, zone_id, unnest(['extent', 'turbidity', 'transparency', 'chlorophyll']) AS indicator FROM obs),
x AS (SELECT v.body_id, zone_id, indicator, v.date, v.status, v.status IN ('ok', 'no_baseline') AS there, CASE WHEN v.date[5:6] IN ('12', '01', '02') THEN 'DJF' WHEN v.date[5:6] IN ('03', '04', '05') THEN 'MAM' WHEN v.date[5:6] IN ('06', '07', '08') THEN 'JJA' ELSE 'SON' END AS season FROM v JOIN se USING (body_id))
SELECT x.body_id, x.zone_id, x.indicator, x.date, x.status, round(CASE WHEN there THEN o.value END, 4) AS value, round(CASE WHEN there THEN coalesce(s.mean, a.mean) END, 6) AS baseline_mean,
  round(CASE WHEN there THEN CASE WHEN s.samples IS NULL THEN a.std ELSE s.std END END, 6) AS baseline_std, (SELECT min(confidence) FROM v w WHERE w.body_id = x.body_id) AS confidence
FROM x LEFT JOIN obs o ON o.body_id = x.body_id AND o.zone_id = x.zone_id AND o.indicator = x.indicator AND o.date = x.date
LEFT JOIN bl s ON s.body_id = x.body_id AND s.zone_id = x.zone_id AND s.indicator = x.indicator AND s.season = x.season LEFT JOIN bl a ON a.body_id = x.body_id AND a.zone_id = x.zone_id AND a.indicator = x.indicator AND a.season = 'ALL'""")
def c6(spark, d):
    dates, _ = _analyzed(spark, d)
    o = written(scenes.zone_observations(t.pixels(spark, d), LOOSE), "observations")
    x = feeds.trends(dates, o, scoring.fit_baselines(o))
    return x.select("body_id", "zone_id", "indicator", "date", "status", _r("value", 4), _r("baseline_mean"), _r("baseline_std"), "confidence")


def _whatif(spark, d):
    """A plume for every nation: wb-4 isn't known, 2030 has no scene, some lie outside, 1998 lacks a band of the red edge, wb-1 in July another one, and wb-3 has no baseline."""
    p = t.pixels(spark, d)
    sums = written(scenes.zone_sums(p, LOOSE), "zone-sums")
    base = written(scoring.fit_baselines(scenes.observations_of(sums, LOOSE).filter("body_id <> 'wb-3'")), "baselines")
    days = written(sums.select("body_id", "date").distinct(), "days")
    at = {"a": 0.01, "e": -0.01, "c": 75.0, "f": 17.0, "height": 64, "width": 64}
    k, month = F.col("n_nationkey").cast("long"), F.col("n_nationkey") % 4 * 3 + 1
    asked = t.table(spark, d, "nation").select(
        k.cast("string").alias("request_id"), F.concat(F.lit("wb-"), (k % 5).cast("string")).alias("body_id"), F.format_string("%d%02d01", F.when(k % 9 == 7, 2030).otherwise(1995 + k % 7), month.cast("int")).alias("date"),
        F.get(F.array(*map(F.lit, ("turbidity", "transparency", "chlorophyll"))), (k % 3).cast("int")).alias("indicator"), (75.005 + k * 17 % 70 / 100).alias("lon"), (16.995 - (k * 11 + 5) % 70 / 100).alias("lat"),
        (8000.0 + 2000 * (k % 9)).alias("radius_m"), (2.0 * (1 + k % 4)).alias("magnitude"),
    )
    grids = days.select("body_id", "date", *(F.lit(v).alias(n) for n, v in at.items()))
    return whatif.plumes(spark, asked, t.bodies(spark, d), scene_files(days), grids, p, base, t.zones(spark, d), t.points(spark, d, "supplier"), t.points(spark, d, "nation"), s=LOOSE)


_ADD = "magnitude * greatest(0, least(1, 1 - sqrt(pow(r - row, 2) + pow(c - col, 2)) / radius))"
PLUMES = f"""WITH bl0 AS (WITH {OBS} SELECT * FROM bl WHERE body_id <> 'wb-3'),
nq AS (SELECT CAST(n_nationkey AS VARCHAR) AS request_id, 'wb-' || (n_nationkey % 5) AS body_id, printf('%d%02d01', CASE WHEN n_nationkey % 9 = 7 THEN 2030 ELSE 1995 + n_nationkey % 7 END, n_nationkey % 4 * 3 + 1) AS date,
  ['turbidity', 'transparency', 'chlorophyll'][n_nationkey % 3 + 1] AS indicator, n_nationkey * 17 % 70 AS col, (n_nationkey * 11 + 5) % 70 AS row,
  (8000.0::DOUBLE + 2000 * (n_nationkey % 9)) / (0.01::DOUBLE * 111320 * cos(radians(16.995::DOUBLE - (n_nationkey * 11 + 5) % 70 / 100.0::DOUBLE))) AS radius, 2.0::DOUBLE * (1 + n_nationkey % 4) AS magnitude FROM nation),
""" + altered(
    f"""rq AS (SELECT *, CASE WHEN body_id = 'wb-4' THEN 'unknown_water_body' WHEN (body_id, date) NOT IN (SELECT DISTINCT (body_id, date) FROM pix0) THEN 'scene_folder_missing' WHEN row >= 64 OR col >= 64 THEN 'plume_outside_scene'
  WHEN indicator = 'chlorophyll' AND starts_with(date, '1998') THEN 'chlorophyll_requires_red_edge' END AS refused FROM nq),
pix AS (SELECT request_id AS body_id, date, r, c, CAST(b02 AS DOUBLE) + CASE WHEN indicator = 'transparency' THEN {_ADD} ELSE 0 END AS b02, b03, CAST(b04 AS DOUBLE) + CASE WHEN indicator = 'turbidity' THEN {_ADD} ELSE 0 END AS b04,
  CAST(b05 AS DOUBLE) + CASE WHEN indicator = 'chlorophyll' THEN {_ADD} ELSE 0 END AS b05, b06, b08, scl FROM pix0 JOIN rq USING (body_id, date) WHERE refused IS NULL AND NOT (body_id = 'wb-1' AND date[5:6] = '07')),""",
    "bl AS (SELECT bl0.* REPLACE (request_id AS body_id) FROM bl0 JOIN rq ON rq.body_id = bl0.body_id AND refused IS NULL),",
).replace("FROM cmp)", "FROM cmp WHERE NOT (indicator = 'chlorophyll' AND starts_with(date, '1998')))") + """,
an AS (SELECT zr.* EXCLUDE (body_id, confidence, reasons), zr.body_id AS request_id, rq.body_id, least(0.55::DOUBLE, confidence) AS confidence,
  concat_ws(',', 'segmentation_model_unavailable', CASE WHEN starts_with(zr.date, '1998') THEN 'missing_red_edge_bands' END, nullif(reasons, '')) AS reasons FROM zr JOIN rq ON zr.body_id = rq.request_id)"""


@query("c10_plume_responses", f"""{PLUMES}, g AS (SELECT body_id AS request_id, avg(CAST(valid AND inside AS DOUBLE)) AS f, sum(CAST(water AS BIGINT)) * 100.0::DOUBLE AS extent FROM m GROUP BY ALL),
lz AS (SELECT request_id, min(confidence) AS least, min(CASE WHEN flagged THEN confidence END) AS fed FROM an GROUP BY ALL),
x AS (SELECT rq.*, f, extent, least, fed, CASE WHEN refused IS NOT NULL THEN 'no' WHEN body_id = 'wb-1' AND date[5:6] = '07' THEN 'lacks' WHEN f < 0.4 THEN 'gate' WHEN least IS NULL THEN 'bare' ELSE 'ok' END AS k FROM rq LEFT JOIN g USING (request_id) LEFT JOIN lz USING (request_id)),
y AS (SELECT *, CASE WHEN k IN ('no', 'lacks', 'gate') THEN 0.0::DOUBLE ELSE least(0.55::DOUBLE, coalesce(least, 1.0::DOUBLE)) END AS confidence FROM x)
SELECT request_id, body_id, date, CASE k WHEN 'no' THEN CASE WHEN refused = 'scene_folder_missing' THEN 'missing' ELSE 'unusable' END WHEN 'lacks' THEN 'unusable' WHEN 'gate' THEN 'insufficient_data' WHEN 'bare' THEN 'no_baseline' ELSE 'ok' END AS status,
  CASE k WHEN 'no' THEN refused WHEN 'lacks' THEN 'missing_bands:b12' WHEN 'gate' THEN printf('valid_fraction:%.3f', f) WHEN 'bare' THEN 'missing_baseline' END AS reason, confidence,
  CASE k WHEN 'no' THEN CASE refused WHEN 'scene_folder_missing' THEN 'scene_missing' WHEN 'chlorophyll_requires_red_edge' THEN 'driving_band_missing' ELSE refused END WHEN 'lacks' THEN 'missing_bands,synthetic_plume' WHEN 'gate' THEN 'insufficient_data,synthetic_plume'
    ELSE concat_ws(',', 'segmentation_model_unavailable', CASE WHEN starts_with(date, '1998') THEN 'missing_red_edge_bands' END, CASE WHEN k = 'bare' THEN 'missing_baseline' END, 'synthetic_plume') END AS reasons,
  CASE WHEN k IN ('bare', 'ok') THEN extent END AS scene_extent_m2, coalesce(fed, confidence) AS feed_confidence FROM y""")
def c10_responses(spark, d):
    r = _whatif(spark, d).responses
    return r.select("request_id", "body_id", "date", "status", "reason", "confidence", F.array_join("confidence_reasons", ",").alias("reasons"), "scene_extent_m2", "feed_confidence")


@query("c10_plume_evidence", f"""{PLUMES}, cd AS (SELECT body_id AS request_id, zone_id, count(*) AS n, max(CASE WHEN indicator = 'extent' THEN value - mean END) AS change, round(sum(value), 4) AS total FROM ct GROUP BY ALL)
SELECT request_id, 'ev-' || body_id || '-' || zone_id || '-' || date AS evidence_id, flagged, CAST(n AS INT) AS comparisons, round(total, 4) AS total, round(change, 6) AS extent_change_m2,
  coalesce(regexp_replace(contributing, '([a-z]+)', '\\1>1.5sigma', 'g'), '') AS crossed, confidence, reasons FROM an JOIN cd USING (request_id, zone_id)""")
def c10_evidence(spark, d):
    c = _whatif(spark, d).evidence
    total = F.round(F.aggregate("comparisons", F.lit(0.0), lambda a, x: a + x["value"]), 4)
    return c.select("request_id", "evidence_id", "flagged", F.size("comparisons").alias("comparisons"), total.alias("total"), _r("extent_change_m2"), F.array_join("thresholds_crossed", ",").alias("crossed"), "confidence", F.array_join("confidence_reasons", ",").alias("reasons"))


@query("c10_plume_alerts", f"""{PLUMES}, x AS (SELECT *, CASE WHEN dom_sigma > 5 THEN 'severe' WHEN dom_sigma > 4 THEN 'warning' ELSE 'watch' END AS sev FROM an WHERE flagged)
SELECT request_id, 'al-' || body_id || '-' || zone_id || '-' || date || '-' || dom AS alert_id, 'ev-' || body_id || '-' || zone_id || '-' || date AS evidence_id, sev AS severity,
  upper(sev[1]) || sev[2:] || ' relative ' || dom || ' signal at ' || zone_id || ', Lake ' || body_id[4:] || ', on ' || date[1:4] || '-' || date[5:6] || '-' || date[7:8] || 'T00:00:00Z. Confidence ' || printf('%.2f', confidence) ||
  '. Evidence ev-' || body_id || '-' || zone_id || '-' || date || '. Laboratory verification is required before any operational decision.' AS template FROM x""")
def c10_alerts(spark, d):
    return _whatif(spark, d).alerts.select("request_id", "alert_id", "evidence_id", "severity", "template")


@query("c10_plume_sites", f"""{PLUMES}, {PLACES.format(DIST)}, x AS (SELECT an.*, least(1.0::DOUBLE, max_sigma / 6) AS severity_factor, 0.7::DOUBLE * coalesce(1 / (1 + intake_m / 5000), 0) + 0.3::DOUBLE * coalesce(1 / (1 + settlement_m / 5000), 0) AS proximity
  FROM an LEFT JOIN ds USING (body_id, zone_id) WHERE flagged)
SELECT request_id, body_id, zone_id, date, CAST(row_number() OVER (PARTITION BY request_id ORDER BY severity_factor * proximity DESC, zone_id) AS INT) AS rank, round(severity_factor * proximity, 9) AS priority, round(severity_factor, 6) AS severity_factor,
  1.0::DOUBLE AS persistence, round(proximity, 9) AS proximity, contributing, confidence FROM x""")
def c10_sites(spark, d):
    s = _whatif(spark, d).sites
    return s.select("request_id", "body_id", "zone_id", "date", "rank", _r("priority", 9), _r("severity_factor"), "persistence", _r("proximity", 9), F.array_join("contributing", ",").alias("contributing"), "confidence")


RECORD = (
    '{"analysis_id": "a%d", "timestamp": "2024-01-01T00:00:00Z", "location": {%s"coordinates": [%s, 17.5]}, "satellite_data": {"source": "S2", "scene_date": "2024-01-01"}, '
    '"water_detection": {"model_used": "m", "water_surface_area_sq_km": %s}, "contamination_detection": {"model_used": "n", "indicators": {"ndti": 0.1}, "anomaly_status": "%s", "confidence_score": %s}, '
    '"investigation_priority": {"score": %s}}'
)


@query("s20_contracts", """SELECT c_custkey AS key, CASE WHEN c_custkey % 17 = 0 THEN 'json' WHEN c_custkey % 13 = 0 THEN 'location.name:missing' WHEN c_custkey % 11 = 0 THEN 'location.coordinates:items'
  WHEN c_custkey % 7 = 0 THEN 'water_detection.water_surface_area_sq_km:type' WHEN c_custkey % 6 = 5 THEN 'contamination_detection.anomaly_status:enum' WHEN c_custkey % 23 > 20 THEN 'contamination_detection.confidence_score:range'
  WHEN c_custkey % 5 = 4 THEN 'investigation_priority.score:range' END AS reason, NOT (c_custkey % 17 = 0 OR c_custkey % 13 = 0 OR c_custkey % 11 = 0 OR c_custkey % 7 = 0 OR c_custkey % 6 = 5 OR c_custkey % 23 > 20 OR c_custkey % 5 = 4) AS accepted FROM customer""")
def s20(spark, d):
    k = F.col("c_custkey").cast("long")
    word = F.get(F.array(*map(F.lit, ("NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL", "normal"))), (k % 6).cast("int"))
    text = F.format_string(
        RECORD, k, F.when(k % 13 == 0, "").otherwise('"name": "Lake", '), F.when(k % 11 == 0, '"78"').otherwise("78"), F.when(k % 7 == 0, "true").otherwise("4.5"), word, ((k % 23) / 20).cast("string"), (k % 5 * 30).cast("string")
    )
    rows = t.table(spark, d, "customer").select(k.alias("key"), F.when(k % 17 == 0, F.substring(text, 2, 1 << 20)).otherwise(text).alias("record"))
    path = shared_path(spark, "contracts")
    contracts.store_checked(rows, path)
    return spark.read.parquet(path).select("key", "reason", F.col("accepted").cast("boolean").alias("accepted"))

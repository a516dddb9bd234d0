"""All registered queries of the monitoring engine and their SQL in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Settings
from .functions import geo, narrative
from .operators import evidence, history, places, reports, retrieval, scenes, scoring, zones
from .plans import monitor
from .sources import tables as t
from .sources.shared import shared_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIST = "2 * 6371000.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
PIXELS = """pix AS (
  SELECT 'wb-' || (l_suppkey % 4) AS body_id, strftime(date_trunc('quarter', l_shipdate), '%Y%m%d') AS date, l_partkey % 64 AS r, l_orderkey % 64 AS c,
    l_discount AS b02, l_quantity / 50 AS b03, l_extendedprice / 105000 AS b04, (l_partkey % 97) / 97 AS b05, (l_orderkey % 89) / 89 AS b06, l_tax * 10 AS b08,
    CASE WHEN l_partkey % 5 < 1 + year(l_shipdate) % 4 THEN 6 ELSE l_partkey % 12 END AS scl FROM lineitem),
px AS (SELECT *, r < 52 AND c < 48 AS inside, CASE WHEN r < 52 AND c < 48 THEN 'z' || CAST(c // 16 AS INT) END AS zone_id, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS valid,
  coalesce((b03 - b08) / nullif(b03 + b08, 0) > 0, false) AS wet FROM pix),
m AS (SELECT *, valid AND inside AND wet AS water, b02 / nullif(b03, 0) AS tr, (1.0::DOUBLE / nullif(b04, 0) - 1.0::DOUBLE / nullif(b05, 0)) * b06 AS ch FROM px)"""
OBS = PIXELS + """,
gate AS (SELECT body_id, date FROM m GROUP BY ALL HAVING avg(CAST(valid AND inside AS DOUBLE)) >= 0.4),
wide AS (SELECT body_id, zone_id, date, sum(CAST(water AS BIGINT)) * 100.0 AS extent, avg(CASE WHEN water THEN b04 END) AS turbidity,
  avg(CASE WHEN water THEN tr END) AS transparency, avg(CASE WHEN water THEN ch END) AS chlorophyll
  FROM m JOIN gate USING (body_id, date) WHERE zone_id IS NOT NULL GROUP BY ALL),
obs AS (SELECT body_id, zone_id, date, indicator, CAST(value AS DOUBLE) AS value FROM (
  SELECT body_id, zone_id, date, unnest(['extent', 'turbidity', 'transparency', 'chlorophyll']) AS indicator, unnest([extent, turbidity, transparency, chlorophyll]) AS value FROM wide) WHERE value IS NOT NULL),
so AS (SELECT *, CASE WHEN substr(date, 5, 2) IN ('12', '01', '02') THEN 'DJF' WHEN substr(date, 5, 2) IN ('03', '04', '05') THEN 'MAM'
  WHEN substr(date, 5, 2) IN ('06', '07', '08') THEN 'JJA' ELSE 'SON' END AS season FROM obs),
bl AS (SELECT body_id, zone_id, indicator, coalesce(season, 'ALL') AS season, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS samples
  FROM so GROUP BY GROUPING SETS ((body_id, zone_id, indicator, season), (body_id, zone_id, indicator))),
wb AS (SELECT so.*, coalesce(s.mean, a.mean) AS mean, CASE WHEN s.samples IS NULL THEN a.std ELSE s.std END AS std, coalesce(s.samples, a.samples) AS samples, s.samples IS NULL AS used_fallback
  FROM so JOIN bl a ON a.season = 'ALL' AND a.body_id = so.body_id AND a.zone_id = so.zone_id AND a.indicator = so.indicator
  LEFT JOIN bl s ON s.season = so.season AND s.body_id = so.body_id AND s.zone_id = so.zone_id AND s.indicator = so.indicator),
cmp AS (SELECT *, CASE WHEN std IS NULL THEN NULL WHEN std <= 0 THEN CASE WHEN value = mean THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END ELSE (value - mean) / std END AS z,
  CASE indicator WHEN 'extent' THEN 0.25 WHEN 'turbidity' THEN 0.4 WHEN 'chlorophyll' THEN 0.35 ELSE 0.0 END AS w FROM wb)"""


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Registers a query, and its SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql() if callable(sql) else sql
        return f

    return add


def _r(c: str, places: int = 6):
    return F.round(F.col(c), places).alias(c)


@query("a22_scl_histogram", f"WITH {PIXELS} SELECT body_id, CAST(scl AS INT) AS scl, count(*) AS n FROM m GROUP BY body_id, scl")
def a22(spark, d):
    return t.pixels(spark, d).groupBy("body_id", "scl").agg(F.count(F.lit(1)).alias("n"))


@query("p4_scene_gates", f"""WITH {PIXELS}, g AS (
  SELECT body_id, date, count(*) AS pixels, avg(CAST(valid AND inside AS DOUBLE)) AS f, coalesce(avg(CASE WHEN inside THEN CAST(valid AS DOUBLE) END), 0) AS a, sum(CAST(water AS BIGINT)) AS wp FROM m GROUP BY ALL)
SELECT body_id, date, pixels, round(f, 6) AS valid_fraction, round(a, 6) AS aoi_fraction, CAST(wp AS BIGINT) AS water_pixels, CASE WHEN f < 0.4 THEN 'insufficient_data' ELSE 'ok' END AS status,
  CASE WHEN f < 0.4 THEN printf('valid_fraction:%.3f', f) END AS reason, a >= 0.6 AS aoi_usable, CAST(wp * 100.0 AS DOUBLE) AS extent_m2, CAST(wp * 100.0 / 10000 AS DOUBLE) AS extent_ha FROM g""")
def p4(spark, d):
    g = scenes.scene_gates(t.pixels(spark, d))
    return g.select(*(_r(c) if c in ("valid_fraction", "aoi_fraction") else c for c in g.columns))


@query("a5_mask_agreement", f"""WITH {PIXELS}, g AS (SELECT body_id, date, avg(CASE WHEN valid THEN CAST((b08 < 0.4) = wet AS DOUBLE) END) AS s FROM m GROUP BY ALL)
SELECT body_id, date, round(coalesce(s, 0), 6) AS agreement, round(coalesce(1 - s, 1), 6) AS disagreement, coalesce(s, 0) < 0.7 AS low_agreement, coalesce(1 - s, 1) > 0.25 AS low_confidence FROM g""")
def a5(spark, d):
    a = scenes.agreement(t.pixels(spark, d).withColumn("model", F.col("b08") < 0.4), "model")
    return a.select("body_id", "date", _r("agreement"), _r("disagreement"), "low_agreement", "low_confidence")


@query("c7_observations", f"WITH {OBS} SELECT body_id, zone_id, date, indicator, round(value, 4) AS value FROM obs")
def c7(spark, d):
    return scenes.zone_observations(t.pixels(spark, d)).select("body_id", "zone_id", "date", "indicator", _r("value", 4))


@query("a7_baselines", f"WITH {OBS} SELECT body_id, zone_id, indicator, season, round(mean, 6) AS mean, round(std, 6) AS std, samples FROM bl")
def a7(spark, d):
    b = scoring.fit_baselines(scenes.zone_observations(t.pixels(spark, d)))
    return b.select("body_id", "zone_id", "indicator", "season", _r("mean"), _r("std"), "samples")


def _compared(spark, d):
    o = scenes.zone_observations(t.pixels(spark, d))
    return scoring.compare(scoring.with_baseline(o, scoring.fit_baselines(o)))


@query("c6_trends", f"WITH {OBS} SELECT body_id, zone_id, date, indicator, round(value, 4) AS value, round(mean, 6) AS mean, round(std, 6) AS std, samples, used_fallback FROM wb")
def c6(spark, d):
    return _compared(spark, d).select("body_id", "zone_id", "date", "indicator", _r("value", 4), _r("mean"), _r("std"), "samples", "used_fallback")


@query("f9_comparisons", f"""WITH {OBS} SELECT body_id, zone_id, date, indicator, CASE WHEN isfinite(z) THEN round(z, 5) END AS sigma, coalesce(abs(z) > 3, false) AS crossed, w > 0 AS fused,
  CASE WHEN z IS NULL THEN 'baseline_std_missing' WHEN isinf(z) THEN 'zero_baseline_std' END AS reason FROM cmp""")
def f9(spark, d):
    return _compared(spark, d).select("body_id", "zone_id", "date", "indicator", _r("sigma", 5), "crossed", "fused", "reason")


@query("a9_zone_scores", f"""WITH {OBS} SELECT body_id, zone_id, date, round(coalesce(sum(CASE WHEN w > 0 THEN w * least(abs(z), 6) END) / nullif(sum(CASE WHEN w > 0 AND z IS NOT NULL THEN w END), 0), 0), 5) AS fused_score,
  coalesce(bool_or(abs(z) > 3 AND w > 0), false) AS flagged, CASE WHEN min(samples) < 8 THEN min(samples) / 8.0::DOUBLE ELSE 1.0 END AS confidence FROM cmp GROUP BY ALL""")
def a9(spark, d):
    return scoring.zone_scores(_compared(spark, d)).select("body_id", "zone_id", "date", _r("fused_score", 5), "flagged", "confidence")


@query("a8_persistence", f"""WITH {OBS}, s AS (SELECT body_id, zone_id, date, coalesce(bool_or(abs(z) > 1.5 AND w > 0), false) AS flagged FROM cmp GROUP BY ALL)
SELECT body_id, zone_id, round(avg(CAST(flagged AS DOUBLE)), 6) AS persistence FROM s GROUP BY ALL""")
def a8(spark, d):
    s = Settings(sigma=1.5)
    o = scenes.zone_observations(t.pixels(spark, d))
    return scoring.persistence(scoring.zone_scores(scoring.compare(scoring.with_baseline(o, scoring.fit_baselines(o)), s), s)).select("body_id", "zone_id", _r("persistence"))


LOOSE = Settings(sigma=1.5)  # at 3 these tables flag hardly anything
SCORES = OBS + """,
ct AS (SELECT *, coalesce(abs(z) > 1.5, false) AS crossed, coalesce(abs(z) > 1.5, false) AND w > 0 AS hit, list_position(['extent', 'turbidity', 'transparency', 'chlorophyll'], indicator) AS o,
  CASE WHEN z IS NULL THEN 'baseline_std_missing' WHEN isinf(z) THEN 'zero_baseline_std' END AS reason FROM cmp),
rs AS (SELECT body_id, zone_id, date, string_agg(reason, ',' ORDER BY o) AS why FROM (SELECT body_id, zone_id, date, reason, min(o) AS o FROM ct WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY ALL),
zs AS (SELECT body_id, zone_id, date, bool_or(hit) AS flagged, CASE WHEN bool_or(hit AND isinf(z)) THEN 6.0::DOUBLE ELSE max(CASE WHEN hit THEN abs(z) END) END AS max_sigma, string_agg(CASE WHEN hit THEN indicator END, ',' ORDER BY o) AS contributing,
  CASE WHEN min(samples) < 8 THEN min(samples) / 8.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, min(samples) < 8 AS few, bool_or(used_fallback) AS pooled,
  coalesce(arg_max(indicator, (abs(z), -o)) FILTER (hit AND isfinite(z)), 'turbidity') AS dom, coalesce(max(abs(z)) FILTER (hit AND isfinite(z)), 0) AS dom_sigma FROM ct GROUP BY ALL),
zr AS (SELECT zs.*, concat_ws(',', why, CASE WHEN few THEN 'baseline_sample_size' END, CASE WHEN pooled THEN 'season_pool_fallback' END) AS reasons FROM zs LEFT JOIN rs USING (body_id, zone_id, date))"""


def altered(paint: str, base: str) -> str:
    """SCORES with `paint` (pix, from pix0: the pixels as given) in place of the pixels and `base` (bl) in place of the baselines."""
    head, rest = SCORES.split("FROM lineitem),", 1)
    i, j = rest.index("bl AS ("), rest.index("wb AS (SELECT so.*")
    return f"pix0{head.removeprefix('pix')}FROM lineitem),\n{paint}{rest[:i]}{base}{rest[j:]}"


PLACES = """zn AS (SELECT 'wb-' || n AS body_id, 'z' || z AS zone_id, CAST(n * 37 + z * 3 AS DOUBLE) AS lon, CAST(n * 11 - 20 AS DOUBLE) AS lat FROM (SELECT DISTINCT s_suppkey % 4 AS n FROM supplier), range(3) r(z)),
pt AS (SELECT kind, k * 7919 % 36000 / 100.0::DOUBLE - 180 AS lon, k * 104729 % 17000 / 100.0::DOUBLE - 85 AS lat, CASE WHEN k % 5 < 4 THEN 'wb-' || (k % 5) END AS owner
  FROM (SELECT 'intake' AS kind, CAST(s_suppkey AS BIGINT) AS k FROM supplier UNION ALL SELECT 'settlement', CAST(n_nationkey AS BIGINT) FROM nation)),
ds AS (SELECT a.body_id, a.zone_id, min(CASE WHEN kind = 'intake' THEN m END) AS intake_m, min(CASE WHEN kind = 'settlement' THEN m END) AS settlement_m
  FROM (SELECT a.body_id, a.zone_id, kind, {0} AS m FROM zn a LEFT JOIN pt b ON b.owner IS NULL OR b.owner = a.body_id) a GROUP BY ALL)"""


def _scored(spark, d):
    """(comparisons, scores), each written once, so that what is joined several times is computed once."""
    c = written(monitor.compared(monitor.observed(t.pixels(spark, d), LOOSE), LOOSE), "comparisons")
    return c, written(scoring.zone_scores(c, LOOSE), "scores")


@query("c5_priority", lambda: f"""WITH {SCORES}, {PLACES.format(DIST)}, ps AS (SELECT body_id, zone_id, avg(CAST(flagged AS DOUBLE)) AS persistence FROM zs GROUP BY ALL),
x AS (SELECT z.*, least(1.0::DOUBLE, max_sigma / 6) AS severity_factor, persistence, 0.7::DOUBLE * coalesce(1 / (1 + intake_m / 5000), 0) + 0.3::DOUBLE * coalesce(1 / (1 + settlement_m / 5000), 0) AS proximity
  FROM zr z JOIN ps USING (body_id, zone_id) LEFT JOIN ds USING (body_id, zone_id) WHERE flagged)
SELECT body_id, zone_id, date, CAST(row_number() OVER (PARTITION BY body_id, date ORDER BY severity_factor * persistence * proximity DESC, zone_id) AS INT) AS rank, round(severity_factor * persistence * proximity, 9) AS priority,
  round(severity_factor, 6) AS severity_factor, round(persistence, 6) AS persistence, round(proximity, 9) AS proximity, CASE WHEN max_sigma > 5 THEN 'severe' WHEN max_sigma > 4 THEN 'warning' ELSE 'watch' END AS severity,
  contributing, confidence, reasons FROM x""")
def c5(spark, d):
    _, scores = _scored(spark, d)
    r = monitor.priority(scores, t.zones(spark, d), t.points(spark, d, "supplier"), t.points(spark, d, "nation"), s=LOOSE)
    return r.select("body_id", "zone_id", "date", "rank", _r("priority", 9), _r("severity_factor"), _r("persistence"), _r("proximity", 9), "severity", F.array_join("contributing", ",").alias("contributing"), "confidence", F.array_join("reasons", ",").alias("reasons"))


CARDS = """cd AS (SELECT body_id, zone_id, date, count(*) AS n, max(CASE WHEN indicator = 'extent' THEN value END) AS extent_m2, max(CASE WHEN indicator = 'extent' THEN value - mean END) AS extent_change_m2,
  CAST(1 + count(CASE WHEN indicator = 'extent' THEN 1 END) * 2 + 3 + count(*) * 4 + count(std) + 2 * count(CASE WHEN isfinite(z) THEN 1 END) AS INT) AS allowed FROM ct GROUP BY ALL)"""


@query("c3_evidence", f"""WITH {SCORES}, {CARDS} SELECT 'ev-' || body_id || '-' || zone_id || '-' || date AS evidence_id, CAST(n AS INT) AS comparisons, extent_m2, round(extent_change_m2, 6) AS extent_change_m2, allowed,
  coalesce(regexp_replace(contributing, '([a-z]+)', '\\1>1.5sigma', 'g'), '') AS crossed, confidence, reasons FROM zr JOIN cd USING (body_id, zone_id, date)""")
def c3(spark, d):
    c = evidence.evidence(*_scored(spark, d), LOOSE)
    return c.select("evidence_id", F.size("comparisons").alias("comparisons"), "extent_m2", _r("extent_change_m2"), F.size(evidence.allowed_numbers()).alias("allowed"), F.array_join("thresholds_crossed", ",").alias("crossed"), "confidence", F.array_join("confidence_reasons", ",").alias("reasons"))


@query("c4_alerts", f"""WITH {SCORES}, x AS (SELECT *, CASE WHEN dom_sigma > 5 THEN 'severe' WHEN dom_sigma > 4 THEN 'warning' ELSE 'watch' END AS sev FROM zr WHERE flagged)
SELECT 'al-' || body_id || '-' || zone_id || '-' || date || '-' || dom AS alert_id, 'ev-' || body_id || '-' || zone_id || '-' || date AS evidence_id, sev AS severity,
  upper(sev[1]) || sev[2:] || ' relative ' || dom || ' signal at ' || zone_id || ', Lake ' || body_id[4:] || ', on ' || date[1:4] || '-' || date[5:6] || '-' || date[7:8] || 'T00:00:00Z. Confidence ' || printf('%.2f', confidence) ||
  '. Evidence ev-' || body_id || '-' || zone_id || '-' || date || '. Laboratory verification is required before any operational decision.' AS template, 'llm_disabled' AS narrative_source FROM x""")
def c4(spark, d):
    a = evidence.alerts(evidence.evidence(*_scored(spark, d), LOOSE), t.bodies(spark, d))
    return a.select("alert_id", "evidence_id", "severity", "template", "narrative_source")


@query("c4_drafts", f"""WITH {SCORES}, x AS (SELECT body_id, zone_id, date, max(CASE WHEN indicator = 'extent' THEN mean END) AS m FROM ct JOIN zr USING (body_id, zone_id, date) WHERE flagged GROUP BY ALL)
SELECT 'ev-' || body_id || '-' || zone_id || '-' || date AS evidence_id, CASE WHEN date[5:6] = '01' THEN 'llm_unreachable' WHEN m IS NULL OR date[5:6] = '04' THEN 'llm_rejected' ELSE 'llm' END AS source FROM x""")
def c4_drafts(spark, d):
    cards = evidence.evidence(*_scored(spark, d), LOOSE)
    mean = F.get(F.filter("comparisons", lambda r: r["indicator"] == "extent"), F.lit(0))["mean"]
    month = F.substring("date", 5, 2)
    draft = F.when(month == "01", None).when((month == "04") | mean.isNull(), "reached 987654.25").otherwise(F.format_string("a mean of %.6f", mean))
    return evidence.alerts(cards, t.bodies(spark, d), cards.select("evidence_id", draft.alias("draft")), enabled=True).select("evidence_id", F.col("narrative_source").alias("source"))


@query("c2_anomalies", f"WITH {SCORES} SELECT severity, count(*) AS n FROM (SELECT CASE WHEN NOT flagged THEN 'none' WHEN dom_sigma > 5 THEN 'severe' WHEN dom_sigma > 4 THEN 'warning' ELSE 'watch' END AS severity FROM zr) GROUP BY ALL")
def c2(spark, d):
    _, scores = _scored(spark, d)
    return scores.groupBy(F.when(F.col("flagged"), F.col("dominant.severity")).otherwise("none").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("c8_overview", f"""WITH {PIXELS}, g AS (SELECT body_id, date, avg(CAST(valid AND inside AS DOUBLE)) AS f FROM m GROUP BY ALL)
SELECT body_id, count(*) AS dates, count(*) FILTER (f >= 0.4) AS ok_dates, max(date) FILTER (f >= 0.4) AS latest_ok, string_agg(date || ':' || CASE WHEN f < 0.4 THEN 'insufficient_data' ELSE 'ok' END, ',' ORDER BY date) AS statuses FROM g GROUP BY body_id""")
def c8(spark, d):
    g = scenes.scene_gates(t.pixels(spark, d))
    ok = F.col("status") == "ok"
    each = F.sort_array(F.collect_list(F.concat_ws(":", "date", "status")))
    return g.groupBy("body_id").agg(F.count(F.lit(1)).alias("dates"), F.count_if(ok).alias("ok_dates"), F.max(F.when(ok, F.col("date"))).alias("latest_ok"), F.array_join(each, ",").alias("statuses"))


@query("j9_compare_dates", f"""WITH {OBS}, e AS (SELECT body_id, min(date) AS a, max(date) AS b FROM obs GROUP BY ALL)
SELECT body_id, zone_id, indicator, round(max(CASE WHEN date = b THEN value END) - max(CASE WHEN date = a THEN value END), 6) AS change FROM obs JOIN e USING (body_id) WHERE date IN (a, b) GROUP BY ALL""")
def j9(spark, d):
    o = scenes.zone_observations(t.pixels(spark, d))
    e = o.groupBy("body_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    at = lambda k: F.max(F.when(F.col("date") == F.col(k), F.col("value")))
    return o.join(e, "body_id").filter("date IN (a, b)").groupBy("body_id", "zone_id", "indicator").agg(F.round(at("b") - at("a"), 6).alias("change"))


HIST = """h AS (SELECT event_id AS analysis_id, 'u' || user_id AS body_id, CAST(ts AS DATE) AS day, value / 500 AS ndti, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'click' THEN 'WARNING' ELSE 'NORMAL' END AS status FROM events),
hn AS (SELECT *, max(CAST(status = 'NORMAL' AS INT)) OVER (PARTITION BY body_id) = 1 AS has_normal FROM h),
hk AS (SELECT *, row_number() OVER (PARTITION BY body_id ORDER BY day, analysis_id) AS n FROM hn WHERE status = 'NORMAL' OR NOT has_normal),
hb AS (SELECT body_id, avg(ndti) AS mean, CASE WHEN count(*) <= 1 THEN 0.01 ELSE stddev_pop(ndti) END AS std, count(*) AS samples FROM hk WHERE n <= 5 GROUP BY body_id)"""


@query("a16_history_baselines", f"WITH {HIST} SELECT body_id, round(mean, 6) AS mean, round(std, 6) AS std, samples FROM hb")
def a16(spark, d):
    return history.history_baselines(t.history(spark, d)).select("body_id", _r("mean"), _r("std"), "samples")


@query("c13_score_history", f"""WITH {HIST}, s AS (SELECT h.*, CASE WHEN std > 0 THEN (ndti - mean) / std END AS d FROM h JOIN hb USING (body_id)),
v AS (SELECT *, CASE WHEN d IS NULL THEN 0 ELSE CAST(greatest(0, least(100, trunc(abs(d) / 4 * 100))) AS INT) END AS score FROM s)
SELECT analysis_id, body_id, CASE WHEN d > 3.2 THEN 'HIGH' WHEN d > 2.0 THEN 'WARNING' ELSE 'NORMAL' END AS anomaly_status, score AS anomaly_score,
  CAST(greatest(0, least(100, trunc(0.5::DOUBLE * score + 30 + 30))) AS INT) AS priority FROM v""")
def c13(spark, d):
    return history.score_history(t.history(spark, d)).select("analysis_id", "body_id", "anomaly_status", "anomaly_score", "priority")


@query("s13_upsert_history", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def s13(spark, d):
    return history.last_wins(t.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


REPORTS = """rep AS (SELECT event_id AS report_id, 'wb-' || (event_id % 4) AS body_id, user_id, ts, event_id * 7919 % 36000 / 100.0::DOUBLE - 180 AS lon, event_id * 104729 % 17000 / 100.0::DOUBLE - 85 AS lat,
  user_id || '-' || CAST(floor(value) AS BIGINT) AS image FROM events),
loc AS (SELECT *, lon >= abs(lat) - 150 AND lon < 150 - abs(lat) AND NOT (lon >= -10 AND lon < 10 AND lat >= -10 AND lat < 10) AS inside, lat >= -60 AND lat < 60 AS belt FROM rep),
lz AS (SELECT *, CASE WHEN NOT inside THEN 'outside_water_boundary' WHEN belt AND lon >= -150 AND lon < 150 THEN 'inside_zone' ELSE 'inside_boundary' END AS place,
  CASE WHEN NOT inside OR NOT belt THEN NULL WHEN lon >= -150 AND lon < -20 THEN 'z0' WHEN lon >= -30 AND lon < 40 THEN 'z1' WHEN lon >= 30 AND lon < 150 THEN 'z2' END AS zone_id FROM loc),
ad AS (SELECT *, inside AND row_number() OVER (PARTITION BY body_id, image, inside ORDER BY ts, report_id) = 1 AS good FROM lz)"""  # no two places of these tables are near one another, so only images repeat
FLAGS = SCORES + f""", {REPORTS}, fl AS (SELECT body_id, zone_id FROM zs JOIN (SELECT body_id, max(date) AS date FROM zs GROUP BY ALL) USING (body_id, date) WHERE flagged),
fr AS (SELECT ad.* FROM ad JOIN fl USING (body_id, zone_id) WHERE good)"""


def _located(spark, d):
    """Located once and written: both the accepted and the rejected ones are read from there."""
    return written(zones.locate(t.reports(spark, d), t.boundaries(spark, d), t.zone_features(spark, d)), "located")


def _accepted_while_flagged(spark, d):
    _, scores = _scored(spark, d)
    good = reports.accepted(reports.adjudicate(_located(spark, d)))
    return zones.in_flagged_zone(good, scores, scores.select("body_id", "date").distinct()).filter("zone_flagged")


@query("j13_locate_reports", f"WITH {REPORTS} SELECT report_id, body_id, place AS location, zone_id FROM lz")
def j13(spark, d):
    return _located(spark, d).select("report_id", "body_id", F.col("where").alias("location"), "zone_id")


@query("c11_adjudicate_reports", f"""WITH {REPORTS} SELECT report_id, body_id, user_id, zone_id, CASE WHEN good THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN good OR NOT inside THEN place ELSE 'duplicate' END AS reason,
  CASE WHEN good THEN 10 ELSE 0 END AS credits FROM ad""")
def c11(spark, d):
    return reports.adjudicate(_located(spark, d)).drop("taken_at")


@query("a14_leaderboard", f"WITH {REPORTS} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(10 * count(*) AS BIGINT) AS credits FROM ad WHERE good GROUP BY user_id")
def a14(spark, d):
    return reports.leaderboard(reports.adjudicate(_located(spark, d)))


@query("a15_user_totals", f"WITH {REPORTS} SELECT user_id, CAST(10 * count(*) FILTER (good) AS BIGINT) AS credits FROM ad GROUP BY user_id")
def a15(spark, d):
    return reports.user_totals(t.table(spark, d, "events"), reports.adjudicate(_located(spark, d)))


@query("w8_running_bumps", f"WITH {FLAGS} SELECT report_id, round(least(0.45, 0.15 * count(*) OVER (PARTITION BY body_id, zone_id ORDER BY ts, report_id ROWS UNBOUNDED PRECEDING)), 6)::DOUBLE AS bump FROM fr")
def w8(spark, d):
    return reports.running_bumps(_accepted_while_flagged(spark, d)).select("report_id", _r("bump"))


@query("a13_zone_bumps", f"WITH {FLAGS} SELECT body_id, zone_id, CAST(least(0.45, round(0.15 * count(*), 6)) AS DOUBLE) AS bump FROM fr GROUP BY ALL")
def a13(spark, d):
    return reports.zone_bumps(_accepted_while_flagged(spark, d)).select("body_id", "zone_id", _r("bump"))


@query("c5_sampling_sites", lambda: f"""WITH {FLAGS}, {PLACES.format(DIST)}, ps AS (SELECT body_id, zone_id, avg(CAST(flagged AS DOUBLE)) AS persistence FROM zs GROUP BY ALL),
bu AS (SELECT body_id, zone_id, CAST(least(0.45, round(0.15 * count(*), 6)) AS DOUBLE) AS bump FROM fr GROUP BY ALL),
x AS (SELECT z.*, zn.lon, zn.lat, coalesce(bump, 0) AS bump, least(1.0::DOUBLE, least(1.0::DOUBLE, max_sigma / 6) + coalesce(bump, 0)) AS severity_factor, persistence, intake_m, settlement_m,
    0.7::DOUBLE * coalesce(1 / (1 + intake_m / 5000), 0) + 0.3::DOUBLE * coalesce(1 / (1 + settlement_m / 5000), 0) AS proximity
  FROM zr z JOIN ps USING (body_id, zone_id) LEFT JOIN ds USING (body_id, zone_id) LEFT JOIN bu USING (body_id, zone_id) LEFT JOIN zn USING (body_id, zone_id) WHERE flagged)
SELECT body_id, zone_id, date, CAST(row_number() OVER (PARTITION BY body_id, date ORDER BY severity_factor * persistence * proximity DESC, zone_id) AS INT) AS rank, round(severity_factor * persistence * proximity, 9) AS priority,
  round(severity_factor, 6) AS severity_factor, round(bump, 6) AS bump, round(intake_m, 2) AS intake_m, round(settlement_m, 2) AS settlement_m, lon, lat, confidence, min(confidence) OVER (PARTITION BY body_id, date) AS feed_confidence,
  'priority = severity × persistence × proximity; proximity = 0.7 × f(distance to nearest intake) + 0.3 × f(distance to nearest settlement); f(d) = 1 / (1 + d / 5000)' AS formula FROM x""")
def c5_sites(spark, d):
    """The ranked sites with what accepted reports add to a zone's severity, their places, distances and the feed's confidence."""
    _, scores = _scored(spark, d)
    good = reports.accepted(reports.adjudicate(_located(spark, d)))
    bumps = reports.zone_bumps(zones.in_flagged_zone(good, scores, scores.select("body_id", "date").distinct()).filter("zone_flagged"))
    places_ = t.zones(spark, d)
    r = monitor.priority(scores, places_, t.points(spark, d, "supplier"), t.points(spark, d, "nation"), bumps, LOOSE).join(places_.select("body_id", "zone_id", "lon", "lat"), ["body_id", "zone_id"], "left")
    r = evidence.feed_confidence(r.withColumn("own", F.col("confidence")), r, ["body_id", "date"])
    return r.select(
        "body_id", "zone_id", "date", "rank", _r("priority", 9), _r("severity_factor"), F.round(F.coalesce("bump", F.lit(0.0)), 6).alias("bump"), _r("intake_m", 2), _r("settlement_m", 2), "lon", "lat",
        F.col("own").alias("confidence"), F.col("confidence").alias("feed_confidence"), F.lit(evidence.formula_text()).alias("formula"),
    )


PTS = "{0} AS (SELECT CAST({1} AS BIGINT) AS key, CAST({1} AS BIGINT) * 7919 % 36000 / 100.0::DOUBLE - 180 AS lon, CAST({1} AS BIGINT) * 104729 % 17000 / 100.0::DOUBLE - 85 AS lat FROM {2})"


@query("j7_within_300km", f"WITH {PTS.format('a', 'c_custkey', 'customer')}, {PTS.format('b', 's_suppkey', 'supplier')} SELECT * FROM (SELECT a.key, b.key AS \"to\", round({DIST}, 3) AS metres FROM a, b) WHERE metres <= 300000")
def j7(spark, d):
    return places.within(t.points(spark, d, "customer"), t.points(spark, d, "supplier"), 300_000).select("key", "to", _r("metres", 3))


@query("j6_nearest_three", f"""WITH {PTS.format('a', 'c_custkey', 'customer')}, {PTS.format('b', 's_suppkey', 'supplier')}, p AS (SELECT a.key, b.key AS "to", {DIST} AS metres FROM a, b)
SELECT key, "to", round(metres, 3) AS metres, CAST(row_number() OVER (PARTITION BY key ORDER BY metres, "to") AS INT) AS rank FROM p WHERE metres <= 1000000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY metres, "to") <= 3""")
def j6(spark, d):
    n = places.nearest_within(t.points(spark, d, "customer"), t.points(spark, d, "supplier"), 1_000_000, 3)
    return n.select("key", "to", _r("metres", 3), "rank")


@query("j1_point_in_polygon", f"""WITH {PTS.format('a', 'c_custkey', 'customer')}
SELECT key, CASE WHEN abs(lon) + abs(lat) < 60 AND NOT (lon > -10 AND lon < 10 AND lat > -10 AND lat < 10) THEN 'diamond' ELSE 'none' END AS zone FROM a""")
def j1(spark, d):
    ring = lambda *xy: F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in xy))
    rings = F.array(ring((60, 0), (0, 60), (-60, 0), (0, -60)), ring((-10, -10), (10, -10), (10, 10), (-10, 10)))
    return t.points(spark, d, "customer").select("key", F.when(geo.within_polygon(F.col("lon"), F.col("lat"), rings), "diamond").otherwise("none").alias("zone"))


@query("f21_tiles", f"WITH {PTS.format('a', 'c_custkey', 'customer')} SELECT key, CAST(trunc((lon + 180) / 360 * 1024) AS INT) AS x, CAST(trunc((1 - asinh(tan(radians(lat))) / 3.141592653589793::DOUBLE) / 2 * 1024) AS INT) AS y FROM a")
def f21(spark, d):
    tile = geo.tile_of(F.col("lon"), F.col("lat"), 10)
    return t.points(spark, d, "customer").select("key", tile["x"].alias("x"), tile["y"].alias("y"))


@query("f25_tokens", "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS INT) AS n FROM documents")
def f25(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.size(narrative.tokens(F.col("text"))).alias("n"))


@query("f36_heading_chunks", r"""WITH c AS (SELECT doc_id, unnest(string_split(replace(replace(text, '. ', chr(10) || '# '), chr(10) || '#', chr(1) || '#'), chr(1))) AS chunk FROM documents)
SELECT doc_id, count(*) AS chunks, CAST(sum(length(regexp_replace(chunk, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS chars FROM c WHERE regexp_replace(chunk, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id""")
def f36(spark, d):
    c = t.table(spark, d, "documents").select("doc_id", F.explode(narrative.heading_chunks(F.replace("text", F.lit(". "), F.lit("\n# ")))).alias("chunk")).filter("chunk <> ''")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("chunk")).cast("long").alias("chars"))


@query("f18_numbers", r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '-?\d+(?:\.\d+)?') AS x FROM documents)
SELECT doc_id, CAST(len(x) AS INT) AS numbers, list_max(list_transform(x, lambda y: CAST(y AS DOUBLE))) AS largest FROM n""")
def f18(spark, d):
    n = narrative.numbers_in_text(F.col("text"))
    return t.table(spark, d, "documents").select("doc_id", F.size(n).alias("numbers"), F.array_max(n).alias("largest"))


@query("o1_overlap_search", """WITH q AS (SELECT item_id AS question, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
p AS (SELECT doc_id AS passage, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents),
s AS (SELECT question, passage, count(*) / any_value(n)::DOUBLE AS score FROM p JOIN (SELECT question, len(t) AS n, unnest(t) AS token FROM q) USING (token) GROUP BY ALL)
SELECT question, passage, round(score, 6) AS score, CAST(row_number() OVER w AS INT) AS rank FROM s WINDOW w AS (PARTITION BY question ORDER BY score DESC, passage) QUALIFY row_number() OVER w <= 3""")
def o1(spark, d):
    q = t.table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")
    return retrieval.overlap_search(t.table(spark, d, "documents").select(F.col("doc_id").alias("passage"), "text"), q).select("question", "passage", _r("score"), "rank")


@query("o1_title_search", """WITH q AS (SELECT item_id AS question, list_distinct(regexp_extract_all(lower(text || ' src' || (item_id % 20)), '[a-z0-9]+')) AS t FROM benchmark),
p AS (SELECT doc_id AS passage, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', source, text)), '[a-z0-9]+'))) AS token FROM documents),
s AS (SELECT question, passage, count(*) / any_value(n)::DOUBLE AS score FROM p JOIN (SELECT question, len(t) AS n, unnest(t) AS token FROM q) USING (token) GROUP BY ALL)
SELECT question, passage, round(score, 6) AS score, CAST(row_number() OVER w AS INT) AS rank FROM s WINDOW w AS (PARTITION BY question ORDER BY score DESC, passage) QUALIFY row_number() OVER w <= 5""")
def o1_titles(spark, d):
    q = t.table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.concat("text", F.lit(" src"), (F.col("item_id") % 20).cast("string")).alias("text"))
    p = t.table(spark, d, "documents").select(F.col("doc_id").alias("passage"), F.col("source").alias("title"), "text")
    return retrieval.overlap_search(p, q, k=5).select("question", "passage", _r("score"), "rank")


HASHED = """tk AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', source, text)), '[a-z0-9]+'))) AS token FROM documents),
sl AS (SELECT doc_id, CAST('0x' || md5(token)[1:8] AS BIGINT) % 256 AS slot, count(*) AS n FROM tk GROUP BY ALL)"""


@query("a26_hashed_vectors", f"WITH {HASHED} SELECT doc_id, count(*) AS slots, round(max(n) / sqrt(sum(n * n)), 5) AS largest, CAST(sum(slot) AS BIGINT) AS slot_sum FROM sl GROUP BY doc_id")
def a26(spark, d):
    v = t.table(spark, d, "documents").select("doc_id", F.explode(F.array(retrieval.hashed_embedding(F.concat_ws(" ", "source", "text")))).alias("v"))
    x = v.select("doc_id", F.posexplode("v").alias("slot", "x")).filter("x > 0").withColumn("x", F.col("x").cast("double"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("slots"), F.round(F.max("x"), 5).alias("largest"), F.sum("slot").cast("long").alias("slot_sum"))


@query("s17_stored_passages", f"""WITH {HASHED}, nr AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM sl GROUP BY doc_id), u AS (SELECT doc_id, slot, n / norm AS x FROM sl JOIN nr USING (doc_id)),
s AS (SELECT a.doc_id AS question, b.doc_id AS passage, sum(a.x * b.x) AS score FROM u a JOIN u b ON a.slot = b.slot WHERE a.doc_id % 20 = 0 AND b.doc_id <> a.doc_id GROUP BY ALL)
SELECT question, round(max(score), 4) AS best FROM s GROUP BY question""")
def s17(spark, d):
    path = shared_path(spark, "passages")
    retrieval.store_passages(t.table(spark, d, "documents").select(F.col("doc_id").alias("passage"), F.col("source").alias("title"), "text"), path)
    q = spark.read.parquet(f"{path}/rows").filter("passage % 20 = 0").select(F.col("passage").alias("question"), F.col("vector").alias("query"))  # the stated query set, as stored
    found, _ = retrieval.search_store(spark, path, q, k=2)
    return found.filter("passage <> question").groupBy("question").agg(F.round(F.max("score"), 4).alias("best"))


@query("o2_vector_search", """WITH q AS (SELECT vec_id AS question, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT question, vec_id AS passage, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings)
SELECT question, passage, round(score, 5) AS score, CAST(row_number() OVER w AS INT) AS rank FROM s WHERE score > 0 WINDOW w AS (PARTITION BY question ORDER BY score DESC, passage) QUALIFY row_number() OVER w <= 3""")
def o2(spark, d):
    e = t.table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("query"))  # the stated query set
    return retrieval.vector_search(e.select(F.col("vec_id").alias("passage"), F.col("embedding").alias("vector")), q).select("question", "passage", _r("score", 5), "rank")


@query("w4_last_turns", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt, count(*) AS turns FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id")
def w4(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.table(spark, d, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 6")  # cut before the exchange, too
    each = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    c = last.groupBy("conv_id").agg(each.alias("a"))
    return c.select("conv_id", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("prompt"), F.size("a").cast("long").alias("turns"))

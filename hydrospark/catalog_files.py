"""Queries on files, grids, sinks and documented variants, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.indices import normalised_difference
from .operators import answers, grid, inventory, variants
from .sources import sinks
from .sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FILES = """man AS (SELECT 'wb-' || (user_id % 4) AS body_id, strftime(CAST(ts AS DATE), '%Y%m%d') AS date,
  ['B02.tif', 'B2.tif', 'B03.tif', 'B04.tif', 'B08.tif', 'B11.tif', 'B12.tif', 'SCL.tif', 'scl.tif', 'notes.txt'][event_id * 31 % 10 + 1] AS file, event_id * 100 AS size, event_id AS mtime
  FROM events WHERE event_id % 11 < user_id % 9),
al AS (SELECT unnest(['B02.tif', 'B2.tif', 'B03.tif', 'B04.tif', 'B08.tif', 'B11.tif', 'B12.tif', 'SCL.tif', 'scl.tif']) AS file, unnest(['b02', 'b02', 'b03', 'b04', 'b08', 'b11', 'b12', 'scl', 'scl']) AS band, unnest([0, 1, 0, 0, 0, 0, 0, 0, 1]) AS pref),
bd AS (SELECT body_id, date, band, arg_min({'file': file, 'size': size, 'mtime': mtime}, (pref, size)) AS x FROM man JOIN al USING (file) GROUP BY ALL),
sc AS (SELECT body_id, date, string_agg(band || '=' || x.file, ',' ORDER BY band) AS files, list(band) AS have, string_agg(band || ':' || x.size || ':' || x.mtime, ';' ORDER BY band) AS stamp FROM bd GROUP BY ALL),
fo AS (SELECT DISTINCT body_id, date FROM man),
sm AS (SELECT body_id, date, coalesce(files, '') AS files, coalesce(stamp, '') AS stamp, list_filter(['b02', 'b03', 'b04', 'b08', 'b11', 'b12', 'scl'], lambda b: NOT list_contains(coalesce(have, []), b)) AS missing FROM fo LEFT JOIN sc USING (body_id, date)),
dt AS (SELECT DISTINCT body_id, date FROM (SELECT body_id, date FROM man UNION ALL SELECT 'wb-' || i, d FROM range(5) r(i), (VALUES ('20240101'), ('20240315'), ('latest')) v(d)) WHERE regexp_full_match(date, '[0-9]{8}'))"""
PIX = """pix AS (SELECT 'wb-' || (l_suppkey % 4) AS body_id, strftime(date_trunc('quarter', l_shipdate), '%Y%m%d') AS date, l_partkey % 64 AS r, l_orderkey % 64 AS c, l_discount AS b02, l_quantity / 50 AS b03,
  l_extendedprice / 105000 AS b04, (l_partkey % 97) / 97 AS b05, l_tax * 10 AS b08 FROM lineitem)"""
DAYS = "h AS (SELECT event_id AS analysis_id, 'u' || user_id AS body_id, CAST(ts AS DATE) AS day, value / 500 AS ndti FROM events)"


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(c: str, places: int = 6):
    return F.round(F.col(c), places).alias(c)


def _known(spark, d):
    dates = spark.range(5).select(F.concat(F.lit("wb-"), F.col("id").cast("string")).alias("body_id"), F.explode(F.array(*map(F.lit, ("20240101", "20240315", "latest")))).alias("date"))
    return inventory.scene_dates(t.manifest(spark, d), dates)


def _scenes(spark, d):
    m = t.manifest(spark, d)
    return inventory.scene_bands(inventory.resolve_bands(m), folders=m)


@query("s1_scene_dates", f"WITH {FILES} SELECT body_id, date FROM dt")
def s1(spark, d):
    return _known(spark, d)


@query("s2_band_files", f"WITH {FILES} SELECT body_id, date, files, array_to_string(missing, ',') AS missing FROM sm")
def s2(spark, d):
    return _scenes(spark, d).select("body_id", "date", "files", F.array_join("missing", ",").alias("missing"))


@query("s3_scene_hash", f"WITH {FILES} SELECT body_id, date, substr(sha256(stamp), 1, 16) AS scene_hash FROM sm")
def s3(spark, d):
    return _scenes(spark, d).select("body_id", "date", "scene_hash")


@query("s21_inventory_report", f"WITH {FILES} SELECT body_id, count(*) AS dates, count(missing) AS on_disk, count(*) FILTER (len(missing) > 0) AS failures FROM dt LEFT JOIN sm USING (body_id, date) GROUP BY body_id")
def s21(spark, d):
    return inventory.inventory_report(_known(spark, d), _scenes(spark, d))


@query("s9_unlabelled_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s9(spark, d):
    return sinks.only_new(t.table(spark, d, "documents").select("doc_id", "source"), t.table(spark, d, "labels"), "doc_id")


@query("s10_upsert_orders", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS run, round(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END, 2) AS value FROM orders""")
def s10(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit("first").alias("run"), F.round("o_totalprice", 2).alias("value"))
    new = t.table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.lit("second").alias("run"), F.round(F.col("o_totalprice") * 2, 2).alias("value"))
    return sinks.upsert(o, new.withColumn("value", F.col("value") - 1).unionByName(new), ["key"], ["value"])


@query("s18_feature_collections", f"""WITH {PIX}, z AS (SELECT body_id, 'z' || CAST(c // 16 AS INT) AS zone_id, max(date) AS date, count(*) AS pixels FROM pix WHERE r < 52 AND c < 48 GROUP BY ALL)
SELECT body_id, '{{"type":"FeatureCollection","stamp":"' || max(date) || '","features":[' ||
  string_agg('{{"type":"Feature","properties":{{"zone_id":"' || zone_id || '","pixels":' || pixels || '}}}}', ',' ORDER BY zone_id) || ']}}' AS document FROM z GROUP BY body_id""")
def s18(spark, d):
    z = t.pixels(spark, d).filter("zone_id IS NOT NULL").groupBy("body_id", "zone_id").agg(F.max("date").alias("date"), F.count(F.lit(1)).alias("pixels"))
    return sinks.feature_collections(z, F.max("date"), ["zone_id", "pixels"])


@query("p14_part_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RING'))")
def p14(spark, d):
    return t.table(spark, d, "part").select("p_partkey", "p_name").filter(F.contains(F.lower("p_name"), F.lower(F.lit("RING"))))


@query("p16_colour_water", f"""WITH {PIX}, w AS (SELECT body_id, date, b04 * 255 AS r8, b03 * 255 AS g8, b02 * 1500 AS b8 FROM pix),
g AS (SELECT body_id, date, count(*) AS pixels, count(*) FILTER ((b8 - r8) / (b8 + r8 + 1) > -0.04 AND (r8 + g8 + b8) / 3 < 165 AND r8 < 118) AS water FROM w GROUP BY ALL)
SELECT *, 100 * water >= 6 * pixels AS enough FROM g""")
def p16(spark, d):
    water = variants.water_by_colour(F.col("b04") * 255, F.col("b03") * 255, F.col("b02") * 1500)
    g = t.pixels(spark, d).groupBy("body_id", "date").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(water).alias("water"))
    return g.withColumn("enough", F.col("water") * 100 >= F.col("pixels") * round(100 * variants.COLOUR_SHARE))


@query("a18_stitched_votes", f"""WITH {PIX}, o AS (SELECT unnest([0, 16, 32]) AS o),
v AS (SELECT body_id, date, r, c, b08 < avg(b08) OVER (PARTITION BY body_id, date, a.o, b.o) - 1e-9 AS vote FROM pix JOIN o a ON r >= a.o AND r < a.o + 32 JOIN o b ON c >= b.o AND c < b.o + 32),
m AS (SELECT body_id, date, r, c, avg(CAST(vote AS DOUBLE)) >= 0.5 AS mask FROM v GROUP BY ALL)
SELECT body_id, date, count(*) AS cells, count(*) FILTER (mask) AS water FROM m GROUP BY ALL""")
def a18(spark, d):
    tiles = grid.to_tiles(t.pixels(spark, d).select("body_id", "date", "row", "col", "b08"), 64, 64, 32, 16)
    key = ["body_id", "date", "tile_row", "tile_col"]
    means = tiles.groupBy(*key).agg(F.avg("b08").alias("mean"))
    m = grid.stitch(tiles.join(means, key).withColumn("vote", F.col("b08") < F.col("mean") - 1e-9))
    return m.groupBy("body_id", "date").agg(F.count(F.lit(1)).alias("cells"), F.count_if("mask").alias("water"))


@query("f27_upsampled_gap", f"""WITH {PIX}, k AS (SELECT body_id, date, r // 2 AS r, c // 2 AS c, avg(b05) AS coarse FROM pix GROUP BY ALL)
SELECT p.body_id, p.date, count(*) AS pixels, round(avg(abs(b05 - coarse)), 6) AS gap FROM pix p JOIN k ON p.body_id = k.body_id AND p.date = k.date AND p.r // 2 = k.r AND p.c // 2 = k.c GROUP BY ALL""")
def f27(spark, d):
    p = t.pixels(spark, d).select("body_id", "date", "row", "col", "b05")
    half = p.groupBy("body_id", "date", F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.avg("b05").alias("coarse"))
    up = grid.upsample(p, half, 2, "coarse")
    return up.groupBy("body_id", "date").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg(F.abs(F.col("b05") - F.col("coarse"))), 6).alias("gap"))


@query("d1_rolling_baselines", f"""WITH {DAYS} SELECT analysis_id, round(avg(ndti) OVER w, 12) AS mean, round(stddev_samp(ndti) OVER w, 6) AS std, count(*) OVER w AS samples FROM h
WINDOW w AS (PARTITION BY body_id ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def d1(spark, d):
    return variants.rolling_baselines(t.history(spark, d)).select("analysis_id", _r("mean", 12), _r("std"), "samples")  # means of short decimals end in 5 often, so 6 places would be ties


@query("d4_month_baselines", f"""WITH {DAYS}, e AS (SELECT body_id, ndti, unnest([(month(day) + 10) % 12 + 1, month(day), month(day) % 12 + 1]) AS month FROM h)
SELECT body_id, CAST(month AS INT) AS month, round(avg(ndti), 6) AS mean, round(stddev_samp(ndti), 6) AS std, count(*) AS samples FROM e GROUP BY ALL""")
def d4(spark, d):
    return variants.month_baselines(t.history(spark, d)).select("body_id", F.col("month").cast("int").alias("month"), _r("mean"), _r("std"), "samples")


@query("d6_index_classes", f"""WITH {PIX}, i AS (SELECT body_id, date, (b04 - b03) / nullif(b04 + b03, 0) AS ti, (b05 - b04) / nullif(b05 + b04, 0) AS ci, (b03 - b08) / nullif(b03 + b08, 0) AS wi FROM pix)
SELECT body_id, date, count(*) FILTER (ti > 0.25) AS very_turbid, count(*) FILTER (ti > 0.10 AND ti <= 0.25) AS turbid, count(*) FILTER (ci > 0.15 AND wi > 0.30) AS bloom, count(*) FILTER (ci > 0.10) AS eutrophic FROM i GROUP BY ALL""")
def d6(spark, d):
    return t.pixels(spark, d).groupBy("body_id", "date").agg(*(F.count_if(c).alias(n) for n, c in variants.index_classes().items()))


@query("d3_anomalous_share", f"""WITH {PIX} SELECT body_id, date, round(avg(CAST((b04 - b03) / nullif(b04 + b03, 0) > 0.25 AS DOUBLE)), 6) AS share FROM pix WHERE (b03 - b08) / nullif(b03 + b08, 0) > 0 GROUP BY ALL""")
def d3(spark, d):
    lake = t.pixels(spark, d).filter(normalised_difference(F.col("b03"), F.col("b08")) > 0)
    return lake.groupBy("body_id", "date").agg(F.round(F.avg(variants.index_classes()["very_turbid"].cast("double")), 6).alias("share"))


@query("f38_answers", """WITH q AS (SELECT item_id AS question, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
p AS (SELECT doc_id AS passage, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', source, text)), '[a-z0-9]+'))) AS token FROM documents),
s AS (SELECT question, passage, count(*) / any_value(n)::DOUBLE AS score FROM p JOIN (SELECT question, len(t) AS n, unnest(t) AS token FROM q) USING (token) GROUP BY ALL),
b AS (SELECT question, passage, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY question ORDER BY score DESC, passage) QUALIFY row_number() OVER w <= 3),
x AS (SELECT question, string_agg(chr(10) || '**[' || passage || '] ' || source || '**' || chr(10) || text, chr(10) ORDER BY rank) AS found, string_agg(passage, ',' ORDER BY rank) AS ids FROM b JOIN documents ON doc_id = passage GROUP BY question)
SELECT item_id AS question, coalesce('📚 **From the knowledge base:**' || chr(10) || found || chr(10) || chr(10) ||
    '⚠️ *Note: Language model is not configured. Set LLM_PROVIDER=gemini and LLM_API_KEY in your environment to enable AI-generated answers.*', 'I don''t have that in my knowledge base.') AS answer,
  coalesce(ids, '') AS source_ids, CASE WHEN found IS NULL THEN 0.2::DOUBLE ELSE 0.75::DOUBLE END AS confidence, CASE WHEN found IS NULL THEN 'template,not_in_corpus' ELSE 'corpus,llm_disabled' END AS reasons, found IS NOT NULL AS grounded
FROM benchmark LEFT JOIN x ON item_id = question""")
def f38(spark, d):
    q = t.table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")
    p = t.table(spark, d, "documents").select(F.col("doc_id").alias("passage"), F.col("source").alias("title"), "text")
    a = answers.answered(q, p)
    return a.select("question", "answer", F.array_join("source_ids", ",").alias("source_ids"), "confidence", F.array_join("reasons", ",").alias("reasons"), "grounded")

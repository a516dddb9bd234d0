"""Golden values of the monitoring functions, and queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from hydrospark import catalog, catalog_zones
from hydrospark.functions import indices, narrative
from hydrospark.operators import scoring

SF = "/root/testdata/sf0.001"
W, CAP = {"extent": 0.25, "turbidity": 0.4, "chlorophyll": 0.35}, 6.0


def zone(spark, turbidity, chlorophyll, extent, n):
    rows = [("b", "z", "20240101", i, float(v), float(m), float(s), n) for i, (v, m, s) in {"turbidity": turbidity, "chlorophyll": chlorophyll, "extent": extent}.items()]
    o = spark.createDataFrame(rows, "body_id string, zone_id string, date string, indicator string, value double, mean double, std double, samples int")
    return scoring.zone_scores(scoring.compare(o)).first()


@pytest.mark.parametrize(("t", "c", "e", "n", "flagged", "hits", "score", "confidence"), [
    ((11, 10, 1), (5.2, 5, 0.5), (100500, 100000, 1000), 40, False, [], 0.665, 1.0),
    ((14, 10, 1), (5.1, 5, 0.5), (100200, 100000, 1000), 40, True, ["turbidity"], 1.72, 1.0),
    ((14, 10, 1), (7.0, 5, 0.5), (100200, 100000, 1000), 40, True, ["turbidity", "chlorophyll"], 3.05, 1.0),
    ((14, 10, 1), (5.1, 5, 0.5), (100200, 100000, 1000), 2, True, ["turbidity"], 1.72, 0.25),
])
def test_zone_scores(spark, t, c, e, n, flagged, hits, score, confidence):
    r = zone(spark, t, c, e, n)
    assert (r.flagged, r.contributing, round(r.fused_score, 6), r.confidence) == (flagged, hits, score, confidence)


def test_scalars(spark):
    z = lambda v, m, s: indices.z_score(F.lit(v), F.lit(m), F.lit(s).cast("double"))
    r = spark.range(1).select(
        F.transform(F.array(*map(F.lit, (0, 6, 8, 4, 3))), indices.valid_pixel).alias("valid"), z(2.0, 2.0, 0.0).alias("flat"), z(3.0, 2.0, 0.0).alias("inf"), z(3.0, 2.0, None).alias("none"),
        indices.normalised_difference(F.lit(0.0), F.lit(0.0)).alias("nd"), narrative.respects(F.lit("Turbidity is 14 against 10 (sigma 4)."), F.array(*map(F.lit, (14.0, 10.0, 4.0)))).alias("good"),
        narrative.respects(F.lit("reached 999."), F.array(F.lit(14.0))).alias("bad"), indices.season_of(F.lit("20241399")).alias("season"), narrative.numbers_in_text(F.lit("2024-12 is 1.5")).alias("numbers"),
    ).first()
    assert r.valid == [False, True, False, True, False]
    assert (r.flat, r.inf, r.none, r.nd, r.good, r.bad, r.season, r.numbers) == (0.0, float("inf"), None, None, True, False, "SON", [2024.0, -12.0, 1.5])


@pytest.mark.parametrize("name", sorted(catalog.SQL | catalog_zones.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "events", "orders", "customer", "supplier", "nation", "documents", "benchmark", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = (catalog.QUERIES | catalog_zones.QUERIES)[name](spark, SF).toPandas(), db.sql((catalog.SQL | catalog_zones.SQL)[name]).df()
    k = sorted(want.columns)
    text = lambda d: d[k].astype(str).replace({"None": "nan", "<NA>": "nan", "NaN": "nan"}).sort_values(k).reset_index(drop=True)
    assert sorted(got.columns) == k and text(got).equals(text(want))


def test_flagship_ranks_zones(spark):
    rows = catalog.QUERIES["c5_priority"](spark, SF).collect()
    assert rows and all(0 <= r.confidence <= 1 for r in rows)
    for scene in {(r.body_id, r.date) for r in rows}:
        of = [r for r in rows if (r.body_id, r.date) == scene]
        assert sorted(r["rank"] for r in of) == list(range(1, 1 + len(of)))

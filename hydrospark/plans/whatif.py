"""Plumes laid over copies of scenes, and what the monitoring plan says of each: statuses, scored zones, evidence, alerts and ranked sites of all requests at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.confidence import reasons
from ..operators import evidence, inventory, scoring
from ..sources.shared import shared_path, small, written
from . import analysis, monitor

SCENE = ["body_id", "date"]
#: The reason that marks what comes of an altered scene; fixed value.
SYNTHETIC = "synthetic_plume"


class WhatIf(NamedTuple):
    """Every table bears request_id; ids of cards and alerts are those that the real scene would give."""

    responses: DataFrame
    zones: DataFrame
    evidence: DataFrame
    alerts: DataFrame
    sites: DataFrame


def located(requests: DataFrame, bodies: DataFrame, manifest: DataFrame, grids: DataFrame) -> DataFrame:
    """Requests (request_id, body_id, date, indicator, lon, lat, radius_m, magnitude) with the pixel and the radius in pixels, or the reason why there is none.

    `grids` is (body_id, date, a, e, c, f, height, width). The first of these holds: unknown_water_body; scene_folder_missing; plume_outside_scene (also without the file that is looked up for the
    grid, b02); chlorophyll_requires_red_edge or driving_band_missing. Of requests that share an id the least row counts; a null id is ''.
    """
    columns = ["body_id", "date", "indicator", "lon", "lat", "radius_m", "magnitude"]
    one = requests.select(F.coalesce("request_id", F.lit("")).alias("request_id"), *columns).groupBy("request_id").agg(F.min(F.struct(*columns)).alias("x")).select("request_id", "x.*")
    known = bodies.select("body_id").distinct().withColumn("known", F.lit(True))
    bands = inventory.resolve_bands(manifest).groupBy(*SCENE).agg(F.collect_set("band").alias("bands"))
    folders = manifest.select(*SCENE).distinct().join(bands, SCENE, "left").select(*SCENE, F.coalesce("bands", F.array().cast("array<string>")).alias("bands"))
    x = one.join(known, "body_id", "left").join(folders, SCENE, "left").join(grids.select(*SCENE, *"aecf", "height", "width"), SCENE, "left")
    pixel = monitor.pixel_of(F.col("lon"), F.col("lat"), *(F.col(c) for c in ("a", "e", "c", "f", "height", "width")))
    side = F.abs("a") * F.when(F.abs("a") < 1, 111_320.0 * F.cos(F.radians("lat"))).otherwise(1.0)
    x = x.withColumns({"pixel": pixel, "radius": F.when(side == 0, 1.0).otherwise(F.try_divide("radius_m", side))})
    band = F.element_at(F.create_map(*(F.lit(v) for kv in monitor.DRIVING.items() for v in kv)), F.col("indicator"))
    has = lambda b: F.coalesce(F.array_contains("bands", b), F.lit(False))
    rules = F.when(F.col("known").isNull(), "unknown_water_body").when(F.col("bands").isNull(), "scene_folder_missing").when(~has("b02") | F.col("pixel").isNull(), "plume_outside_scene")
    rules = rules.when(~has(band), F.when(F.col("indicator") == "chlorophyll", "chlorophyll_requires_red_edge").otherwise("driving_band_missing"))
    return x.select("request_id", *SCENE, "indicator", band.alias("band"), "pixel.row", "pixel.col", "radius", F.coalesce("magnitude", F.lit(0.0)).alias("magnitude"), rules.alias("refused"))


def painted(pixels: DataFrame, plumes: DataFrame) -> DataFrame:
    """A copy of its scene's pixels for every located request, the driving band raised by magnitude * clip(1 - distance / radius); body_id becomes the request's `copy`. Scenes without a request aren't read."""
    p = plumes.select(*SCENE, "copy", F.col("band").alias("__band"), F.struct("row", "col", "radius", "magnitude").alias("__plume"))
    x = pixels.join(small(p), SCENE)
    d = F.sqrt((F.col("row") - F.col("__plume.row")) ** 2 + (F.col("col") - F.col("__plume.col")) ** 2)
    more = F.when(F.col("__plume.radius") > 0, F.col("__plume.magnitude") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(d, F.col("__plume.radius"))))).otherwise(0.0)
    raised = {b: F.when(F.col("__band") == b, F.col(b) + more).otherwise(F.col(b)) for b in dict.fromkeys(monitor.DRIVING.values())}
    return x.withColumns(raised | {"body_id": F.col("copy")}).drop("copy", "__band", "__plume")


def plumes(
    spark: SparkSession, requests: DataFrame, bodies: DataFrame, manifest: DataFrame, grids: DataFrame, pixels: DataFrame, baselines: DataFrame, zones: DataFrame, intakes: DataFrame, settlements: DataFrame,
    bumps: DataFrame | None = None, s: Settings = DEFAULTS,
) -> WhatIf:
    """What the plan says of every request's altered scene.

    A located request's copy is a body of its own with the real one's baselines, zones, points and name, so one run of `analysis.analyze` on a store of its own serves all requests and the real
    store stays as it is. A copy holds one date, so a zone's persistence is 1 or 0. responses: status, reason, confidence, confidence_reasons, scene_extent_m2, and feed_confidence: what the feeds
    of alerts and of sites are as sure of, their least sure row, or the scene if they have none. Refused requests have no other row.
    """
    x = written(located(requests, bodies, manifest, grids).withColumn("copy", F.concat(F.lit("q"), "request_id")), "plumes")
    runs = written(x.filter("refused IS NULL"), "plume-runs")
    by_body = small(written(runs.select("body_id", "copy"), "plume-bodies"))
    as_copies = lambda t: t.join(by_body, "body_id").withColumn("body_id", F.col("copy")).drop("copy")
    files = manifest.join(small(runs.select(*SCENE, "copy")), SCENE).withColumn("body_id", F.col("copy")).drop("copy")
    asked, names = runs.select(F.col("copy").alias("body_id"), "date"), as_copies(bodies.select("body_id", F.coalesce("name", "body_id").alias("name")))
    base, store = written(as_copies(baselines), "plume-baselines"), shared_path(spark, "plume-store")
    dates, scores = analysis.analyze(spark, asked, names, files, painted(pixels, runs), base, store, s=s)
    comparisons = scoring.compare(scoring.with_baseline(analysis.products(spark, store), base), s)
    cards = written(evidence.evidence(comparisons, scores, s), "plume-cards")
    texts = small(written(runs.select("copy", "request_id", F.col("body_id").alias("real")), "plume-names"))
    real = lambda t: t.join(texts, t["body_id"] == texts["copy"]).withColumn("body_id", F.col("real")).drop("copy", "real")
    card_id = F.concat_ws("-", F.lit("ev"), *scoring.ZONE)
    feed = evidence.alerts(cards.join(texts, cards["body_id"] == texts["copy"]).withColumn("evidence_id", F.concat_ws("-", F.lit("ev"), "real", "zone_id", "date")).drop("copy", "real", "request_id"), names)
    alerts = real(feed).withColumn("alert_id", F.concat_ws("-", F.lit("al"), *scoring.ZONE, "indicator"))
    far = as_copies(monitor.distances(zones.join(by_body, "body_id", "left_semi"), intakes, settlements))
    sites = scoring.rank_zones(scores, scoring.persistence(scores), far, None if bumps is None else as_copies(bumps), s)
    sure = evidence.feed_confidence(dates.withColumn("own", F.col("confidence")), feed, SCENE).withColumn("feed_confidence", F.col("confidence"))  # alerts and sites are the same zones
    done = sure.select(F.col("body_id").alias("copy"), "status", "reason", F.col("own").alias("confidence"), "confidence_reasons", "scene_extent_m2", "feed_confidence")
    no = F.col("refused")
    short = F.when(no == "scene_folder_missing", "scene_missing").when(no == "chlorophyll_requires_red_edge", "driving_band_missing").otherwise(no)
    r = x.join(done, "copy", "left")
    sure_of = lambda c: F.when(no.isNotNull(), 0.0).otherwise(F.col(c)).alias(c)
    responses = r.select(
        "request_id", *SCENE, F.when(no == "scene_folder_missing", "missing").when(no.isNotNull(), "unusable").otherwise(F.col("status")).alias("status"), F.coalesce(no, "reason").alias("reason"), sure_of("confidence"),
        F.when(no.isNotNull(), F.array(short)).otherwise(reasons(F.col("confidence_reasons"), F.array(F.lit(SYNTHETIC)))).alias("confidence_reasons"), "scene_extent_m2", sure_of("feed_confidence"),
    )
    return WhatIf(responses, real(scores), real(cards).withColumn("evidence_id", card_id), alerts, real(sites))

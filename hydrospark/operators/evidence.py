"""Evidence cards, grounded texts and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import confidence as conf
from ..functions.narrative import iso_date, narrative_source
from .scoring import ZONE, ordinal


def evidence(comparisons: DataFrame, scores: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One card per scored (body, zone, date): its comparisons in indicator order, extent and its change, thresholds crossed, stamp."""
    row = F.struct(ordinal().alias("o"), "indicator", "value", "mean", "std", "sigma", F.lit(s.sigma).alias("threshold"), "crossed", "samples", "fused")
    extent = F.col("indicator") == "extent"
    cards = comparisons.groupBy(*ZONE).agg(
        F.sort_array(F.collect_list(row)).alias("comparisons"), F.max(F.when(extent, F.col("value"))).alias("extent_m2"), F.max(F.when(extent, F.col("value") - F.col("mean"))).alias("extent_change_m2"),
    )
    cut = f"{s.sigma:g}sigma"
    x = cards.join(scores, ZONE).withColumn("stamp", conf.stamp(F.col("confidence"), F.col("reasons")))
    crossed = F.transform("contributing", lambda n: F.concat(n, F.lit(f">{cut}")))
    return x.select(F.concat_ws("-", F.lit("ev"), *ZONE).alias("evidence_id"), *ZONE, "comparisons", "extent_m2", "extent_change_m2", "contributing", crossed.alias("thresholds_crossed"), "flagged", "dominant", "stamp.*")


def allowed_numbers() -> Column:
    """The numbers that a text on a card may state: its confidence, extents, every comparison's figures and the parts of its date."""
    each = F.flatten(F.transform("comparisons", lambda r: F.array(r["value"], r["mean"], F.lit(1.0) * r["threshold"], r["samples"].cast("double"), r["std"], r["sigma"], F.abs(r["sigma"]))))
    parts = F.when(F.col("date").rlike(r"\A\d{8}\z"), F.array(*(F.substring("date", a, n).try_cast("double") for a, n in ((1, 4), (5, 2), (7, 2))))).otherwise(F.array().cast("array<double>"))
    return F.array_compact(F.concat(F.array("confidence", "extent_m2", "extent_change_m2"), each, parts))


def alert_text(severity: Column, indicator: Column, region: Column, location: Column, when: Column, confidence: Column, evidence_id: Column) -> Column:
    """The fixed alert text; fixed value: its wording."""
    return F.concat(
        F.initcap(severity), F.lit(" relative "), indicator, F.lit(" signal at "), region, F.lit(", "), location, F.lit(", on "), when, F.lit(". Confidence "), F.format_string("%.2f", F.bround(confidence, 2)),
        F.lit(". Evidence "), evidence_id, F.lit(". Laboratory verification is required before any operational decision."),
    )


def alerts(cards: DataFrame, places: DataFrame, drafts: DataFrame | None = None, enabled: bool = False) -> DataFrame:
    """One alert per flagged card: the fixed text, and a draft text (evidence_id, draft) if every number in it is one of the card's."""
    x = cards.filter("flagged").join(places.select("body_id", F.col("name").alias("location")), "body_id", "left").withColumn("location", F.coalesce("location", "body_id"))
    x = x.join(drafts, "evidence_id", "left") if drafts is not None else x.withColumn("draft", F.lit(None).cast("string"))
    x = x.withColumn("narrative_source", narrative_source(F.col("draft"), allowed_numbers(), F.lit(enabled)))
    text = alert_text(F.col("dominant.severity"), F.col("dominant.indicator"), F.col("zone_id"), F.col("location"), iso_date(F.col("date")), F.col("confidence"), F.col("evidence_id"))
    return x.select(
        F.concat_ws("-", F.lit("al"), *ZONE, "dominant.indicator").alias("alert_id"), "evidence_id", *ZONE, "location", F.col("dominant.indicator").alias("indicator"), F.col("dominant.severity").alias("severity"),
        text.alias("template"), F.when(F.col("narrative_source") == "llm", F.col("draft")).alias("polished"), "narrative_source", "confidence", "confidence_reasons",
    )


def of_severity(feed: DataFrame, kind: str = "all") -> DataFrame:
    """Alerts of one kind: all, severe, warn or watch."""
    return feed if kind == "all" else feed.filter(F.col("severity") == {"warn": "warning"}.get(kind, kind))


def feed_confidence(scenes: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each scene the least confidence of its rows, or its own if it has none."""
    least = rows.groupBy(*key).agg(F.min("confidence").alias("least"))
    return scenes.join(least, key, "left").withColumn("confidence", F.coalesce("least", "confidence")).drop("least")


def formula_text(s: Settings = DEFAULTS) -> str:
    """How a rank comes about, with the settings' numbers; fixed value: its wording."""
    return (
        "priority = severity × persistence × proximity; "
        f"proximity = {s.intake_weight:g} × f(distance to nearest intake) + {s.settlement_weight:g} × f(distance to nearest settlement); f(d) = 1 / (1 + d / {s.scale_m:g})"
    )

"""What is published of analyses: an overview of bodies and series of indicators, both with a row for every date, processed or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import INDICATORS
from ..functions.confidence import reasons
from ..functions.indices import season_of
from ..operators.loading import valid_date

SCENE = ["body_id", "date"]
#: The reason that says that nothing was detected; fixed value.
NO_DETECTION = "not_a_detection"


def _stamped(dates: DataFrame, first: tuple[str, ...]) -> DataFrame:
    """Per body its dates in order, the least confidence of any, at most 1, and all reasons in the order of dates, after `first`."""
    each = F.sort_array(F.collect_list(F.struct("date", "status", "reason", "confidence", "confidence_reasons"))).alias("dates")  # a body's dates
    by = dates.filter(valid_date(F.col("date"))).groupBy("body_id").agg(each, F.least(F.lit(1.0), F.min("confidence")).alias("confidence"))
    why = reasons(F.array(*map(F.lit, first)).cast("array<string>"), F.flatten(F.transform("dates", lambda d: d["confidence_reasons"])))
    return by.withColumn("confidence_reasons", why)


def overview(bodies: DataFrame, dates: DataFrame, zones: DataFrame) -> DataFrame:
    """(body_id, name, dates, latest_ok, alert_zone, alert_indicator, alert_severity, confidence, confidence_reasons) of every body.

    `dates` and `zones` are those of analysis.analyze. The alert is that of the first flagged zone, in order of its id, on the latest date that is ok; confidence is the least of any date's. A body without dates has none
    of these, and is as sure as can be that nothing was detected.
    """
    by = _stamped(dates, (NO_DETECTION,))
    last = dates.filter(valid_date(F.col("date")) & (F.col("status") == "ok")).groupBy("body_id").agg(F.max("date").alias("latest_ok"))
    flagged = zones.filter("flagged").select("body_id", F.col("date").alias("latest_ok"), "zone_id", "dominant")
    alert = last.join(flagged, ["body_id", "latest_ok"], "left").groupBy("body_id", "latest_ok").agg(F.min(F.struct("zone_id", "dominant")).alias("a"))
    x = bodies.select("body_id", "name").join(by, "body_id", "left").join(alert, "body_id", "left")
    return x.select(
        "body_id", "name", F.coalesce("dates", F.array().cast(by.schema["dates"].dataType)).alias("dates"), "latest_ok", F.col("a.zone_id").alias("alert_zone"), F.col("a.dominant.indicator").alias("alert_indicator"),
        F.col("a.dominant.severity").alias("alert_severity"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("confidence_reasons", F.array(F.lit(NO_DETECTION))).alias("confidence_reasons"),
    )


def trends(dates: DataFrame, observations: DataFrame, baselines: DataFrame) -> DataFrame:
    """(body_id, zone_id, indicator, date, value, baseline_mean, baseline_std, status, confidence, confidence_reasons): a series for every zone of `observations` and indicator, with a row for every date of its body.

    A date that wasn't processed has its status and nothing else; one that was has the season's baseline, or that over all seasons, even where the value lacks. A series is as sure as the least sure
    of its body's dates, with the reasons of all.
    """
    stamps = _stamped(dates, ()).select("body_id", "confidence", F.when(F.size("confidence_reasons") > 0, F.col("confidence_reasons")).otherwise(F.array(F.lit(NO_DETECTION))).alias("confidence_reasons"))
    days = dates.filter(valid_date(F.col("date"))).select(*SCENE, "status").withColumn("season", season_of(F.col("date")))
    series = observations.select("body_id", "zone_id").distinct().withColumn("indicator", F.explode(F.array(*map(F.lit, INDICATORS))))
    key = ["body_id", "zone_id", "indicator"]
    of = lambda season: baselines.filter(season).select(*key, F.struct("mean", "std").alias("b"))
    x = days.join(series, "body_id").join(observations.select(*key, "date", "value"), [*key, "date"], "left")
    own = baselines.filter("season <> 'ALL'").select(*key, "season", F.struct("mean", "std").alias("own"))
    x = x.join(own, [*key, "season"], "left").join(of(F.col("season") == "ALL"), key, "left")
    there = F.col("status").isin("ok", "no_baseline")
    view = F.when(there, F.coalesce("own", "b"))
    x = x.select(*key, "date", F.when(there, F.col("value")).alias("value"), view["mean"].alias("baseline_mean"), view["std"].alias("baseline_std"), "status")
    return x.join(stamps, "body_id")


def changes(series: DataFrame) -> DataFrame:
    """Adds the change since the zone's and indicator's last date with a value; null for the first one and where there is no value."""
    w = Window.partitionBy("body_id", "zone_id", "indicator").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("change", F.col("value") - F.last("value", ignorenulls=True).over(w))

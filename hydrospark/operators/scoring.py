"""Seasonal baselines, comparisons, zone scores, persistence and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, INDICATORS, WEIGHTS, Settings
from ..functions.confidence import reasons
from ..functions.indices import falloff, finite, normalised_severity, season_of, severity_label, z_score

ZONE = ["body_id", "zone_id", "date"]


def ordinal() -> Column:
    """An indicator's place in the fixed order."""
    return F.array_position(F.array(*map(F.lit, INDICATORS)), F.col("indicator"))


def fit_baselines(observations: DataFrame) -> DataFrame:
    """Mean, sample deviation (NULL for one value) and count per season, and over all seasons as ALL, in one pass."""
    o = observations.filter(finite(F.col("value"))).withColumn("season", season_of(F.col("date")))
    g = o.groupingSets([["body_id", "zone_id", "indicator", "season"], ["body_id", "zone_id", "indicator"]], "body_id", "zone_id", "indicator", "season")
    out = g.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("samples"), F.grouping("season").alias("pooled"))
    return out.withColumn("season", F.when(F.col("pooled") == 1, "ALL").otherwise(F.col("season"))).drop("pooled")


def with_baseline(observations: DataFrame, baselines: DataFrame) -> DataFrame:
    """Adds mean, std, samples and used_fallback: the season's row, or else the one over all; without either the row goes."""
    key = ["body_id", "zone_id", "indicator"]
    b = F.struct("mean", "std", "samples")
    both = baselines.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("season", b))).alias("by_season"))  # five entries at most
    o = observations.join(both, key).withColumn("season", season_of(F.col("date")))
    own = F.try_element_at("by_season", F.col("season"))
    got = F.coalesce(own, F.try_element_at("by_season", F.lit("ALL")))
    return o.withColumn("b", got).filter("b IS NOT NULL").select(*observations.columns, "b.*", own.isNull().alias("used_fallback"))


def unscored(observations: DataFrame, baselines: DataFrame) -> DataFrame:
    """(body, zone, date, reason) of zones none of whose indicators has a baseline, of any season."""
    known = baselines.select("body_id", "zone_id", "indicator").distinct().withColumn("known", F.lit(True))
    by = observations.join(known, ["body_id", "zone_id", "indicator"], "left").groupBy(*ZONE).agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("any"))
    return by.filter("NOT any").select(*ZONE, F.lit("missing_baseline").alias("reason"))


def adjusted(baselines: DataFrame, adjustments: DataFrame | None) -> DataFrame:
    """Baselines with mean * scale + offset and std * scale where there is a row (body, zone, indicator, season, scale, offset)."""
    if adjustments is None:
        return baselines
    x = baselines.join(adjustments, ["body_id", "zone_id", "indicator", "season"], "left")
    scale = F.coalesce("scale", F.lit(1.0))
    return x.withColumns({"mean": F.col("mean") * scale + F.coalesce("offset", F.lit(0.0)), "std": F.col("std") * scale}).select(*baselines.columns)


def weight() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("indicator")), F.lit(0.0))


def compare(observations: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds z, crossed, fused and the reasons that a comparison gives."""
    z = z_score(F.col("value"), F.col("mean"), F.col("std"))
    out = observations.withColumn("z", z).withColumn("crossed", F.coalesce(F.abs("z") > s.sigma, F.lit(False))).withColumn("weight", weight()).withColumn("fused", F.col("weight") > 0)
    reason = F.when(F.col("z").isNull(), "baseline_std_missing").when(~finite(F.col("z")), "zero_baseline_std")
    return out.withColumn("reason", reason).withColumn("sigma", F.when(finite(F.col("z")), F.col("z")))


def zone_scores(comparisons: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row per (body, zone, date): fused score, what contributes in indicator order, flag, severity and confidence."""
    z, w = F.least(F.abs("z"), F.lit(s.z_cap)), F.col("weight")
    pooled = F.bool_or("used_fallback") if "used_fallback" in comparisons.columns else F.lit(False)
    counts, hit = F.col("z").isNotNull() & (w > 0), F.col("crossed") & F.col("fused")
    out = comparisons.groupBy(*ZONE).agg(
        F.coalesce(F.try_divide(F.sum(F.when(counts, w * z)), F.sum(F.when(counts, w))), F.lit(0.0)).alias("fused_score"),
        F.sort_array(F.collect_list(F.when(hit, F.struct(ordinal().alias("o"), F.col("indicator"))))).alias("hits"),
        F.max(F.when(hit, F.when(finite(F.col("z")), F.abs("z")).otherwise(s.z_cap))).alias("max_sigma"), F.bool_or(hit & ~finite(F.col("z"))).alias("endless"), F.min("samples").alias("least"), F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(ordinal().alias("o"), "reason")))).alias("why"), pooled.alias("pooled"),
        F.max_by(F.struct(F.col("indicator"), F.abs("sigma").alias("sigma")), F.when(hit & F.col("sigma").isNotNull(), F.struct(F.abs("sigma"), -ordinal()))).alias("top"),
    )
    out = out.withColumn("contributing", F.transform("hits", lambda x: x["indicator"])).withColumn("flagged", F.size("hits") > 0)
    out = out.withColumn("max_sigma", F.when(F.col("endless"), s.z_cap).otherwise(F.col("max_sigma")))
    out = out.withColumn("severity", F.when(F.col("flagged"), severity_label(F.col("max_sigma"))))
    out = out.withColumn("confidence", F.when(F.col("least") < s.min_samples, F.greatest(F.col("least"), F.lit(0)) / s.min_samples).otherwise(1.0))
    more = [F.when(c, F.array(F.lit(x))) for c, x in ((F.col("least") < s.min_samples, "baseline_sample_size"), (F.col("pooled"), "season_pool_fallback"))]
    out = out.withColumn("reasons", reasons(F.transform("why", lambda x: x["reason"]), *more))
    dominant = F.when(F.col("top").isNull(), F.struct(F.lit("turbidity").alias("indicator"), F.lit("watch").alias("severity"))).otherwise(F.struct(F.col("top.indicator").alias("indicator"), severity_label(F.col("top.sigma")).alias("severity")))
    return out.withColumn("dominant", dominant).drop("hits", "least", "top", "endless", "why", "pooled")


def persistence(scores: DataFrame) -> DataFrame:
    """Per zone, the share of scored dates that are flagged."""
    return scores.groupBy("body_id", "zone_id").agg(F.avg(F.col("flagged").cast("double")).alias("persistence"))


def rank_zones(scores: DataFrame, history: DataFrame, distances: DataFrame, bumps: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Flagged zones of each (body, date) by severity * persistence * proximity, in zone order where equal."""
    f = scores.filter("flagged").join(history, ["body_id", "zone_id"], "left").join(distances, ["body_id", "zone_id"], "left")
    if bumps is not None:
        f = f.join(bumps, ["body_id", "zone_id"], "left")
    bump = F.coalesce("bump", F.lit(0.0)) if bumps is not None else F.lit(0.0)
    severity = F.least(F.lit(1.0), normalised_severity(F.col("max_sigma"), s.z_cap) + bump)
    near = s.intake_weight * falloff(F.col("intake_m"), s.scale_m) + s.settlement_weight * falloff(F.col("settlement_m"), s.scale_m)
    f = f.withColumns({"severity_factor": severity, "persistence": F.coalesce("persistence", F.lit(1.0)), "proximity": near})
    f = f.withColumn("priority", F.col("severity_factor") * F.col("persistence") * F.col("proximity"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("body_id", "date").orderBy(F.desc("priority"), "zone_id")))

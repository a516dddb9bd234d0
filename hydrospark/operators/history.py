"""The history path: baselines over the oldest five normal rows, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import history_priority, history_score


def history_baselines(history: DataFrame, value: str = "ndti", keep: int = 5) -> DataFrame:
    """Per body, mean and population deviation (0.01 for one row) of its first `keep` NORMAL rows by day, or of its first `keep` rows if none is normal."""
    h = history.withColumn("normal", F.col("status") == "NORMAL")
    w = Window.partitionBy("body_id", "normal").orderBy("day", "analysis_id")  # row_number() <= keep is cut before the exchange, too
    few = h.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)
    by = few.groupBy("body_id", "normal").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("samples"))
    b = by.groupBy("body_id").agg(F.max_by(F.struct("mean", "std", "samples"), "normal").alias("b")).select("body_id", "b.*")
    return b.withColumn("std", F.when(F.col("samples") <= 1, 0.01).otherwise(F.col("std")))


def score_history(history: DataFrame, value: str = "ndti", days: int = 3, proximity: float = 1.5) -> DataFrame:
    """Every analysis scored against its body's baseline."""
    h = history.join(history_baselines(history, value), "body_id", "left")
    h = h.withColumn("s", history_score(F.col(value), F.coalesce("mean", F.lit(0.0)), F.coalesce("std", F.lit(0.0))))
    return h.select(*history.columns, F.col("s.status").alias("anomaly_status"), F.col("s.score").alias("anomaly_score"), F.col("s.confidence"), F.col("s.sigma"), history_priority(F.col("s.score"), F.lit(days), F.lit(proximity)).alias("priority"))


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert: of the rows of a key, the one that came last."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("r")).select("r.*")


def scan(history: DataFrame, body_id: str | None = None, limit: int | None = None) -> DataFrame:
    """History of one body or of all, newest first, at most `limit` rows (a top-k, not a sort, if it is given)."""
    h = history if body_id is None else history.filter(F.col("body_id") == body_id)
    h = h.orderBy(F.desc("day"), "analysis_id")
    return h if limit is None else h.limit(limit)


def lookup(history: DataFrame, ids: DataFrame) -> DataFrame:
    """(analysis_id, analysis) of asked ids as a struct; an id that isn't there has a null one."""
    return ids.select("analysis_id").join(history.select("analysis_id", F.struct(*(c for c in history.columns if c != "analysis_id")).alias("analysis")), "analysis_id", "left")


def feed(history: DataFrame, body_id: str) -> DataFrame:
    """What a chart of one body shows, oldest first."""
    return history.filter(F.col("body_id") == body_id).select("day", "ndti", "ndci", "status", "analysis_id").orderBy("day", "analysis_id").drop("analysis_id")


def baseline_report(history: DataFrame, bodies: DataFrame) -> DataFrame:
    """Means and deviations of both indices to three places; a body without history has zeros."""
    out = bodies.select("body_id").distinct()
    for v in ("ndti", "ndci"):
        b = history_baselines(history, v).select("body_id", F.bround("mean", 3).alias(f"{v}_mean"), F.bround("std", 3).alias(f"{v}_std"))
        out = out.join(b, "body_id", "left")
    return out.fillna(0.0)


def or_latest(asked: DataFrame, history: DataFrame) -> DataFrame:
    """(request, analysis_id, found) of asked (request, analysis_id): that analysis, else the newest of all, else null."""
    newest = history.agg(F.max_by("analysis_id", F.struct("day", "analysis_id")).alias("newest"))
    have = history.select("analysis_id", F.lit(True).alias("there"))
    x = asked.join(have, "analysis_id", "left").join(F.broadcast(newest), F.lit(True), "left")  # one row
    return x.select("request", F.when(F.col("there"), F.col("analysis_id")).otherwise(F.col("newest")).alias("analysis_id"), F.coalesce("there", F.lit(False)).alias("found"))


def masked_means(pixels: DataFrame, mask: str, **indices) -> DataFrame:
    """Per scene the means of index columns over a mask to three places, 0 where nothing is masked."""
    return pixels.groupBy("body_id", "date").agg(*(F.bround(F.coalesce(F.avg(F.when(F.col(mask), c)), F.lit(0.0)), 3).alias(n) for n, c in indices.items()))


def analyze(pixels: DataFrame, history: DataFrame, mask: str, indicators: dict[str, Column], days: int = 1, proximity: float = 1.0) -> DataFrame:
    """One analysis per scene (body_id, date): means of `indicators` (ndwi, ndti, ndci) over a mask, its ndti against the baseline of its body in `history`, and its priority.

    Pixels meet in one aggregate, whose few rows meet baselines of a row per body. The score is taken from the mean as it is, the indicators are
    kept to three places. A scene without masked pixels has means of 0; a body without history is normal with score 0.
    """
    means = pixels.groupBy("body_id", "date").agg(*(F.coalesce(F.avg(F.when(F.col(mask), c)), F.lit(0.0)).alias(n) for n, c in indicators.items()))
    x = means.join(history_baselines(history), "body_id", "left").withColumn("s", history_score(F.col("ndti"), F.col("mean"), F.col("std")))
    ident = F.concat_ws("_", F.lit("A"), F.replace("date", F.lit("-"), F.lit("")), F.replace("body_id", F.lit(" "), F.lit("")))
    return x.select(
        ident.alias("analysis_id"), "body_id", F.to_date(F.replace("date", F.lit("-"), F.lit("")), "yyyyMMdd").alias("day"), *(F.bround(n, 3).alias(n) for n in indicators), F.col("s.status").alias("status"), F.col("s.score").alias("anomaly_score"),
        F.col("s.confidence").alias("confidence"), F.coalesce("s.sigma", F.lit(0.0)).alias("sigma"), history_priority(F.col("s.score"), F.lit(days), F.lit(proximity)).alias("priority"),
    )


def saved(history: DataFrame, analyses: DataFrame) -> DataFrame:
    """History once `analyses` are put in: one with an id that is there takes its place."""
    both = history.withColumn("turn", F.lit(0)).unionByName(analyses.withColumn("turn", F.lit(1)))
    return last_wins(both, ["analysis_id"], ["turn"]).drop("turn")

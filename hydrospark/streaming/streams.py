"""Streaming forms: scoring against static baselines, daily windows, the running leaderboard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..config import DEFAULTS, Settings
from ..operators.reports import metres_apart
from ..operators.scenes import zone_observations
from ..operators.scoring import compare, with_baseline, zone_scores
from ..sources.shared import ship


def score_stream(observations: DataFrame, baselines: DataFrame) -> DataFrame:
    """Streamed observations joined with static baselines; append mode."""
    return compare(with_baseline(observations, baselines))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and means per day and type; rows later than the watermark are dropped."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def running_leaderboard(reports: DataFrame) -> DataFrame:
    """Credits by user, for complete mode."""
    return reports.groupBy("user_id").agg(F.sum("credits").alias("credits"))


def fresh_images(reports: DataFrame, memory: str = "7 days") -> DataFrame:
    """First reports of each image; forgets hashes after `memory`, which bounds the state."""
    return reports.withWatermark("taken_at", memory).dropDuplicatesWithinWatermark(["body_id", "image_hash"])


def score_new_scenes(pixels: DataFrame, baselines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores each batch of newly arrived scenes against static baselines and appends the scores under `path`; a batch that is repeated replaces itself.

    A file of pixels holds whole scenes, so a batch's gates and means are complete.
    """

    def batch(rows: DataFrame, number: int) -> None:
        scores = zone_scores(compare(with_baseline(zone_observations(rows), baselines)))
        scores.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pixels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Judge(StatefulProcessor):
    """Accepts or rejects the located reports of one body as they come.

    State: a map from image to the time of its accepted report, kept for ever since that rule has no time limit, and a map from (hour, latitude band) to the places accepted there. A report looks up its
    image and the nine cells around it, and nothing else is read. A timer for each hour removes the hour's cells once the watermark is beyond every report that they could stand in the way of.
    """

    def __init__(self, s: Settings):
        self.s, self.step = s, s.duplicate_m / 111_000.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.images = handle.getMapState("images", "image string", "at double")
        self.places = handle.getMapState("places", "hour long, band long", "lons array<double>, lats array<double>, ats array<double>")

    def _near(self, lon: float, lat: float, at: float, hour: int, band: int) -> bool:
        for key in ((h, b) for h in (hour - 1, hour, hour + 1) for b in (band - 1, band, band + 1)):
            if self.places.containsKey(key):
                for x, y, t in zip(*self.places.getValue(key)):
                    if abs(t - at) <= self.s.duplicate_s and metres_apart(x, y, lon, lat) <= self.s.duplicate_m:
                        return True
        return False

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch, good = pd.concat(rows).sort_values(["taken_at", "report_id"]), []
        for x in batch.itertuples():
            at = x.taken_at.timestamp()
            hour, band, image = int(at // self.s.duplicate_s), int(x.lat // self.step), ("none" if x.image_hash is None else f"={x.image_hash}",)
            accepted = not self.images.containsKey(image) and not self._near(x.lon, x.lat, at, hour, band)
            good.append(accepted)
            if accepted:
                self.images.updateValue(image, (at,))
                held = [list(v) for v in self.places.getValue((hour, band))] if self.places.containsKey((hour, band)) else [[], [], []]
                for own, v in zip(held, (x.lon, x.lat, at)):
                    own.append(v)
                self.places.updateValue((hour, band), tuple(held))
                self.handle.registerTimer(int((hour + 2) * self.s.duplicate_s * 1000))
        yield pd.DataFrame({"body_id": key[0], "report_id": batch["report_id"].to_numpy(), "accepted": good})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        hour = round(expiredTimerInfo.getExpiryTimeInMs() / 1000 / self.s.duplicate_s) - 2
        for cell in [c for c in self.places.keys() if c[0] <= hour]:
            self.places.removeKey(cell)
        yield pd.DataFrame({"body_id": pd.Series(dtype=object), "report_id": pd.Series(dtype="int64"), "accepted": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def adjudicate_stream(reports: DataFrame, s: Settings = DEFAULTS, late: str = "1 hour") -> DataFrame:
    """(body_id, report_id, accepted) of located reports as they come, keyed by body; see `Judge`. Needs the RocksDB state store (`keyed_state`).

    Reports of a batch are judged in order of time, then id; those later than the watermark by more than `late` are dropped, since the cells that they would have to be held against are gone.
    """
    ship(reports.sparkSession)
    rows = reports.withWatermark("taken_at", late).groupBy("body_id")
    return rows.transformWithStateInPandas(Judge(s), "body_id string, report_id long, accepted boolean", "append", "eventTime")


def keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

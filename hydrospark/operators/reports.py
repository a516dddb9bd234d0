"""Citizen reports: ordered duplicate check, credits, bumps."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.geo import haversine_m
from ..sources.shared import ship, written
from .components import components
from .places import cells_around


def metres_apart(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


class Ledger:
    """Accepted reports that stand in the way of one another: hashes, and places by hour so that few are compared."""

    def __init__(self, s: Settings):
        self.s, self.hashes, self.by_hour = s, set(), defaultdict(list)

    def submit(self, image_hash: str, lon: float, lat: float, at: float) -> bool:
        """Whether the report is accepted; only accepted ones stand in the way of later ones."""
        hour = int(at // self.s.duplicate_s)
        near = (x for h in (hour - 1, hour, hour + 1) for x in self.by_hour[h])
        if image_hash in self.hashes:
            return False
        if any(abs(t - at) <= self.s.duplicate_s and metres_apart(x, y, lon, lat) <= self.s.duplicate_m for x, y, t in near):
            return False
        self.hashes.add(image_hash)
        self.by_hour[hour].append((lon, lat, at))
        return True


def _cell(hour: Column, band: Column, across: Column) -> Column:
    """A cell of time and place of a body as one number; if two cells should share it, they are taken for one, which costs work and changes no result."""
    return F.xxhash64("body_id", hour, band, across)


def _gridded(rows: DataFrame, s: Settings) -> DataFrame:
    """Adds where the report's cell lies (as high and long as the limits) and its order."""
    step = s.duplicate_m / 111_000.0
    hour, band = F.floor(F.unix_timestamp("taken_at") / s.duplicate_s), F.floor(F.col("lat") / step).cast("long")
    x = rows.withColumns({"hour": hour, "band": band, "turn": F.struct("taken_at", "report_id")})
    return x.withColumn("across", _place(F.col("lon"), cells_around(F.col("band"), step)))


def _placed(reports: DataFrame, s: Settings) -> DataFrame:
    """Adds the report's cell, where that lies, its image key (for its hash) and its order."""
    image = F.coalesce(F.concat(F.lit("="), "image_hash"), F.lit("none"))
    return _gridded(reports, s).withColumns({"cell": _cell(F.col("hour"), F.col("band"), F.col("across")), "image": image}).drop("image_hash")


def _place(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * n), n).cast("long")


#: Fine cells by hour, band and across that make a block.
_BLOCK = (4, 8, 8)


def _cells(rows: DataFrame) -> DataFrame:
    """Occupied cells with the turn of their first report, written."""
    return written(rows.groupBy("body_id", "hour", "band", "across", "cell").agg(F.min("turn").alias("turn")), "cells")


def _blocks_across(band: Column, step: float) -> Column:
    return F.greatest(F.lit(1), F.floor(cells_around(band * _BLOCK[1], step) / _BLOCK[2])).cast("long")


def _reach(across: Column, n: Column, m: Column) -> tuple[Column, Column]:
    """The westernmost and easternmost cell, in a band of m, beside one of a band of n; they may lie beyond 0 and m."""
    return F.floor(across * m / n) - 1, F.floor((across + 1) * m / n) + 1


def _sent(cells: DataFrame, step: float) -> DataFrame:
    """Each cell once for every block in which a cell of its hour or the next one may lie beside it: some two rows a cell."""
    hours, bands, _ = _BLOCK
    later = F.explode(F.sequence(F.floor(F.col("hour") / hours), F.floor((F.col("hour") + 1) / hours))).alias("block_hour")
    x = cells.select("body_id", "hour", "band", "across", "cell", later)
    x = x.select("*", F.explode(F.sequence(F.floor((F.col("band") - 1) / bands), F.floor((F.col("band") + 1) / bands))).alias("block_band"))
    x = x.withColumns({"of": _blocks_across(F.col("block_band"), step), "n": cells_around(F.col("band"), step)})
    ends = []
    for d in (-1, 0, 1):
        m = cells_around(F.col("band") + d, step)
        ends.append([F.floor(k * F.col("of") / m) for k in _reach(F.col("across"), F.col("n"), m)])
    x = x.withColumns({"west": F.least(*(w for w, _ in ends)), "east": F.greatest(*(e for _, e in ends))})
    x = x.withColumn("k", F.explode(F.sequence(F.col("west"), F.least("east", F.col("west") + F.col("of") - 1))))
    return x.select(F.xxhash64("body_id", "block_hour", "block_band", F.pmod("k", "of").cast("long")).alias("block"), "hour", "band", "across", "cell")


def _links(cells: DataFrame, s: Settings) -> DataFrame:
    """(cell, other) of different occupied cells, one of which may hold a report that repeats one of the other by time and place.

    Cells meet in blocks of several hours, bands and cells: each lies in one and is sent to those around it, so what moves is some three rows a cell and not one for each cell beside it. A block's
    cells are bounded, and so are the pairs compared there.
    """
    step = s.duplicate_m / 111_000.0
    hours, bands, _ = _BLOCK
    band = F.floor(F.col("band") / bands)
    of = _blocks_across(band, step)
    own = F.xxhash64("body_id", F.floor(F.col("hour") / hours), band, F.floor(F.col("across") * of / cells_around(F.col("band"), step)).cast("long"))
    held = cells.select(own.alias("block"), F.col("hour").alias("h"), F.col("band").alias("b"), F.col("across").alias("k"), F.col("cell").alias("other"))
    n, m = cells_around(F.col("band"), step), cells_around(F.col("b"), step)
    west, east = _reach(F.col("across"), n, m)
    beside = (F.col("cell") != F.col("other")) & (F.col("h") - F.col("hour")).between(0, 1) & (F.col("b") - F.col("band")).between(-1, 1) & (F.pmod(F.col("k") - west, m) <= east - west)
    found = _sent(cells, step).join(held, "block").filter(beside).select("cell", "other")
    return found.unionByName(found.select(F.col("other").alias("cell"), F.col("cell").alias("other"))).distinct()


def _near(s: Settings) -> Column:
    apart = F.abs(F.unix_micros("taken_at") - F.unix_micros("o_at")) <= s.duplicate_s * 1_000_000
    return apart & (haversine_m(F.col("lon"), F.col("lat"), F.col("o_lon"), F.col("o_lat")) <= s.duplicate_m)


def _first_ones(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(decided, open): a report that comes first both of its image and in all cells around it is accepted, whatever else is; what repeats such a one is rejected.

    Most reports are first in both, so few stay open. Whether an image's first report comes first around its place is asked once an image, so reports move only to meet their image; those
    of images that stay open move once more, to meet the places. Of an image that a third of all reports bear, or of a crowded place, one row stands for all in each join.
    """
    cells = _cells(rows)
    links = written(_links(cells, s), "links")
    firsts = cells.select("cell", "turn")
    around = links.join(firsts.withColumnRenamed("cell", "other"), "other").select("cell", "turn").unionByName(firsts).groupBy("cell").agg(F.min("turn").alias("around"))
    images = rows.groupBy("body_id", "image").agg(F.min(F.struct("turn", "cell")).alias("first")).select("body_id", "image", "first.turn", "first.cell").withColumnRenamed("turn", "of_image")
    images = images.join(around, "cell").select("body_id", "image", "of_image", (F.col("of_image") == F.col("around")).alias("known"))
    x = rows.drop("hour", "band", "across").join(images, ["body_id", "image"])
    x = written(x.withColumn("accepted", F.when(F.col("known"), F.col("turn") == F.col("of_image"))).drop("known", "of_image", "turn"), "firsts")
    spots = x.filter("accepted").select(F.col("cell").alias("other"), F.col("body_id").alias("o_body"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"), F.col("taken_at").alias("o_at"))
    rest = x.filter("accepted IS NULL").drop("accepted")
    late = rest.select("report_id", "body_id", "lon", "lat", "taken_at", "cell")
    late = late.join(links, "cell").unionByName(late.withColumn("other", F.col("cell")))
    near = late.join(spots, "other").filter((F.col("body_id") == F.col("o_body")) & _near(s)).select("report_id").distinct().withColumn("close", F.lit(True))
    rest = written(rest.join(near, "report_id", "left"), "rest")
    decided = x.filter("accepted IS NOT NULL").unionByName(rest.filter("close").drop("close").withColumn("accepted", F.lit(False)))
    return decided, _gridded(rest.filter("close IS NULL").drop("close"), s)


def adjudicate(located: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(report_id, body_id, user_id, zone_id, taken_at, status, reason, credits) of located reports (see zones.locate).

    Outside the water is rejected first and stands in nobody's way. A report is rejected as duplicate if it repeats an accepted one of its body before it, by image or near in time
    and place, in order of time, then id; else it is accepted, with its place as the reason. First those are decided that nothing earlier can stand in the way of, and what
    repeats them. The others form components by equal images and neighbouring cells, and each is folded in order by itself, so one body's reports spread over tasks.
    `located` is read several times, a few columns each, so it should be a written table.
    """
    columns = ["report_id", "body_id", "user_id", "zone_id", "taken_at", "where"]
    kinds = "report_id long, body_id string, user_id long, zone_id string, taken_at timestamp, `where` string, accepted boolean"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, ledger = None, Ledger(s)
        for b in batches:
            good = []
            for x in b.itertuples():
                if x.component != component:
                    component, ledger = x.component, Ledger(s)
                good.append(ledger.submit(x.image, x.lon, x.lat, x.taken_at.timestamp()))
            yield b[columns].assign(accepted=good)

    ship(located.sparkSession)
    rows = _placed(located.filter("where <> 'outside_water_boundary'").select(*columns, "image_hash", "lon", "lat"), s)
    decided, left = _first_ones(rows, s)
    judged = decided.select(*columns, "accepted")
    if left.take(1):
        images = left.groupBy("body_id", "image").agg(F.min("cell").alias("b"))  # one cell of each image stands for it
        edges = _links(_cells(left), s).select(F.col("cell").alias("a"), F.col("other").alias("b")).unionByName(left.join(images, ["body_id", "image"]).select(F.col("cell").alias("a"), "b").distinct())
        parts = components(edges).withColumnRenamed("node", "cell")
        some = left.join(parts, "cell").select(*columns, "image", "lon", "lat", "component").repartition("component").sortWithinPartitions("component", "taken_at", "report_id")
        judged = judged.unionByName(some.mapInPandas(judge, kinds))
    judged = judged.unionByName(located.filter("where = 'outside_water_boundary'").select(*columns, F.lit(False).alias("accepted")))
    reason = F.when(F.col("accepted") | (F.col("where") == "outside_water_boundary"), F.col("where")).otherwise("duplicate")
    return judged.select(*columns[:5], F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"), F.when(F.col("accepted"), s.credits).otherwise(0).alias("credits"))


def accepted(judged: DataFrame, body_id: str | None = None) -> DataFrame:
    """The accepted reports, of one body if it is given."""
    rows = judged.filter("status = 'accepted'")
    return rows if body_id is None else rows.filter(F.col("body_id") == body_id)


def running_bumps(flagged: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The capped bump of a zone after each accepted report that lies in it while it is flagged.

    The cap is met after a few reports, so only a zone's first ones are ranked (cut before the exchange, too); all later ones have the cap.
    """
    most = math.ceil(s.bump_max / s.bump)
    w = Window.partitionBy("body_id", "zone_id").orderBy("taken_at", "report_id")
    first = flagged.select("body_id", "zone_id", "taken_at", "report_id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("report_id", "n")
    return flagged.join(first, "report_id", "left").withColumn("bump", F.least(F.lit(s.bump_max), s.bump * F.coalesce("n", F.lit(most)))).drop("n")


def zone_bumps(flagged: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Per zone the capped bump by its accepted reports that lie in it while it is flagged."""
    return flagged.groupBy("body_id", "zone_id").agg(F.least(F.lit(s.bump_max), s.bump * F.count(F.lit(1))).alias("bump"))


def leaderboard(judged: DataFrame, nobody: str = "demo") -> DataFrame:
    """Credits of accepted reports by user, largest first; without any accepted report one row of zero."""
    by = accepted(judged).groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.sum("credits").alias("credits"))
    none = by.sparkSession.range(1).select(F.lit(nobody).alias("user_id"), F.lit(0).cast("long").alias("credits"))
    return by.unionByName(none.join(by.limit(1).select(F.lit(1).alias("x")), how="left_anti", on=F.lit(True))).orderBy(F.desc("credits"), "user_id")


def user_totals(users: DataFrame, judged: DataFrame) -> DataFrame:
    """Each user's credits, 0 without an accepted report."""
    by = accepted(judged).groupBy("user_id").agg(F.sum("credits").alias("credits"))
    return users.select("user_id").distinct().join(by, "user_id", "left").select("user_id", F.coalesce("credits", F.lit(0).cast("long")).alias("credits"))


def average_hash(grey: Column, content: Column) -> Column:
    """Fingerprint of an 8 x 8 grey image (64 values): `ahash:` and, as hex without zeros in front, a bit per value that reaches the mean; without such an array `sha256:` and the content's hash."""
    mean = F.aggregate(grey, F.lit(0.0), lambda a, x: a + x) / 64
    bits = F.transform(grey, lambda x: F.when(x >= mean, "1").otherwise("0"))
    part = lambda i: F.lpad(F.lower(F.conv(F.array_join(F.slice(bits, i, 32), ""), 2, 16)), 8, "0")
    digits = F.regexp_replace(F.concat(part(1), part(33)), "^0+(?=.)", "")
    return F.when(F.size(grey) == 64, F.concat(F.lit("ahash:"), digits)).otherwise(F.concat(F.lit("sha256:"), F.sha2(content, 256)))

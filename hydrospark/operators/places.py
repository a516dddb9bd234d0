"""Points, nearest neighbours and radius searches, with a cell join in front of the exact distance."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.geo import haversine_m
from ..sources.shared import small, written

# Lakes with their centres and radii in km, and localities with the water body and district of each.
KNOWN_LAKES = (
    ("Hussain Sagar", 17.4239, 78.4738, 4.0), ("Chilika Lake", 19.72, 85.32, 25.0), ("Dal Lake", 34.11, 74.87, 6.0), ("Sardar Sarovar Dam", 21.831, 73.748, 15.0), ("Powai Lake", 19.125, 72.905, 2.5),
    ("Vembanad Lake", 9.6, 76.4, 20.0), ("Loktak Lake", 24.55, 93.8, 10.0), ("Bhojtal (Upper Lake)", 23.25, 77.35, 7.0), ("Sambhar Salt Lake", 26.9, 75.2, 18.0), ("Lake Pichola", 24.575, 73.678, 3.5),
    ("Nagarjuna Sagar", 16.57, 79.31, 12.0), ("Hirakud Reservoir", 21.57, 83.87, 20.0), ("Wular Lake", 34.33, 74.55, 10.0), ("Shivsagar Lake (Koyna)", 17.4, 73.75, 14.0), ("Gobind Sagar (Bhakra)", 31.41, 76.45, 15.0),
    ("Pulicat Lake", 13.67, 80.2, 16.0), ("Futala Lake", 21.154, 79.0417, 1.2), ("Ambazari Lake", 21.128, 79.043, 1.5), ("Gorewada Lake", 21.1972, 79.0375, 2.5), ("Sonegaon Lake", 21.133, 79.066, 0.8), ("Gandhisagar Lake", 21.1444, 79.107, 0.6),
)
LOCALITIES = (
    ("hussain_sagar", "Hussain Sagar", "Hussain Sagar", 17.4239, 78.4738, "Hyderabad, Telangana"), ("chilika_lake", "Chilika Lake", "Chilika Lake", 19.72, 85.32, "Puri/Ganjam, Odisha"),
    ("dal_lake", "Dal Lake", "Dal Lake", 34.11, 74.87, "Srinagar, Jammu & Kashmir"), ("sardar_sarovar", "Sardar Sarovar Dam", "Sardar Sarovar Dam", 21.831, 73.748, "Narmada, Gujarat"),
    ("powai_lake", "Powai Lake", "Powai Lake", 19.125, 72.905, "Mumbai, Maharashtra"), ("vembanad_lake", "Vembanad Lake", "Vembanad Lake", 9.6, 76.4, "Kottayam/Alappuzha, Kerala"),
    ("loktak_lake", "Loktak Lake", "Loktak Lake", 24.55, 93.8, "Bishnupur, Manipur"), ("bhojtal_lake", "Bhojtal (Upper Lake)", "Bhojtal", 23.25, 77.35, "Bhopal, Madhya Pradesh"),
    ("sambhar_lake", "Sambhar Salt Lake", "Sambhar Lake", 26.9, 75.2, "Jaipur, Rajasthan"), ("pichola_lake", "Lake Pichola", "Lake Pichola", 24.575, 73.678, "Udaipur, Rajasthan"),
    ("nagarjuna_sagar", "Nagarjuna Sagar Reservoir", "Nagarjuna Sagar", 16.57, 79.31, "Nalgonda/Guntur, AP/TS"), ("hirakud_reservoir", "Hirakud Reservoir", "Hirakud Reservoir", 21.57, 83.87, "Sambalpur, Odisha"),
    ("ambazari_lake", "Ambazari Lake", "Ambazari Lake", 21.1292, 79.0394, "Nagpur West, Maharashtra"), ("futala_lake", "Futala Lake", "Futala Lake", 21.1558, 79.0478, "Nagpur North, Maharashtra"),
    ("gorewada_lake", "Gorewada Reservoir", "Gorewada Lake", 21.1891, 79.0321, "Nagpur NW, Maharashtra"),
)
# Words of the place-name rules.
WATER_WORDS = ("lake", "dam", "sagar", "talao", "reservoir", "talav", "sarovar", "wetland", "canal", "ghat", "basin", "pond")
ROAD_WORDS = ("road", "street", "marg", "lane", "path", "highway", "expressway", "bridge", "flyover")
NO_NAMES = ("water", "yes", "stream", "river", "bay")


def known_lakes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_LAKES), "name string, lat double, lon double, radius_km double")


def localities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOCALITIES), "id string, name string, water_body string, lat double, lon double, district string")


#: About so many candidate pairs are one task's.
_TASK = 4_000_000


def _celled(left: DataFrame, right: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with their (band, cell) of a grid for `metres`: rows of `left` (lon, lat) once, rows of `right` (lon2, lat2) in their own and the neighbouring cells.

    The globe is cut in bands of latitude as high as the radius, and each band in cells of longitude that are as wide as the radius
    where the band and its neighbours are nearest a pole, so neighbours in both axes hold all partners; cells
    meet across 180 degrees.
    """
    step = metres / 111_000.0
    band = lambda lat: F.floor(lat / step)

    def count(b: Column) -> Column:
        far = F.least(F.lit(90.0), F.greatest(F.abs(b - 1), F.abs(b + 2)) * step)
        return F.greatest(F.lit(1), F.floor(360.0 / step * F.cos(F.radians(far)))).cast("long")

    cell = lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n), n)
    a = left.withColumn("band", band(F.col("lat"))).withColumn("cell", cell(F.col("lon"), count(F.col("band"))))
    b = right.withColumn("band", F.explode(F.sequence(band(F.col("lat2")) - 1, band(F.col("lat2")) + 1))).withColumn("n", count(F.col("band")))
    own = F.floor((F.col("lon2") + 180) / 360 * F.col("n"))
    return a, b.withColumn("cell", F.explode(F.array_distinct(F.array(*(F.pmod(own + i, F.col("n")) for i in (-1, 0, 1)))))).drop("n")


def _loads(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, int]:
    """(`on`, pairs) of the cells where both sides have rows, and the sum of pairs."""
    n = lambda x, c: x.groupBy(*on).agg(F.count(F.lit(1)).alias(c))
    out = written(n(a, "na").join(n(b, "nb"), on).select(*on, (F.col("na") * F.col("nb")).alias("pairs")), "loads")
    return out, out.agg(F.sum("pairs")).first()[0] or 0


def _meeting(a: DataFrame, b: DataFrame, metres: float, on: list[str]) -> DataFrame:
    """The pairs of two celled sides at most `metres` apart, with both sides' columns. The join is an equi-join on `on`, and the exact distance a filter.

    A cell's pairs are counted first: where they are more than a task's, the rows of `a` are dealt out and those of `b` repeated for each part, so neither a crowded cell nor a table of few files is one task's. Neither side is broadcast, whatever its files' sizes make Spark expect.
    """
    loads, total = _loads(a, b, on)
    parts = loads.select(*on, F.ceil(F.col("pairs") * 2 / _TASK).cast("int").alias("parts"))
    parts._held = loads._held
    a = a.join(small(parts), on).withColumn("part", F.pmod(F.xxhash64("key", "lon", "lat"), F.col("parts")).cast("int")).drop("parts")
    b = b.join(small(parts), on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = a.repartition(total // _TASK + 16, *on, "part")
    d = haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return dealt.hint("merge").join(b, [*on, "part"]).withColumn("metres", d).filter(F.col("metres") <= metres).drop("band", "cell", "part", "lon2", "lat2")


def _spots(left: DataFrame) -> DataFrame:
    return left.select("key", "lon", "lat")


def _goals(right: DataFrame, *more: str) -> DataFrame:
    return right.select(F.col("key").alias("to"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), *more)


def within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """All pairs (left.key, right.key, metres) at most `metres` apart."""
    return _meeting(*_celled(_spots(left), _goals(right), metres), metres, ["band", "cell"]).select("key", "to", "metres")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The `k` nearest of each key, ties by number."""
    w = Window.partitionBy("key").orderBy("metres", "to")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_within(left: DataFrame, right: DataFrame, metres: float, k: int) -> DataFrame:
    """(key, to, metres, rank): the `k` nearest of each key at most `metres` away, ties by number; what `nearest` makes of `within`, without its pairs.

    Who has k within a shorter radius has the k nearest there. The first radius is the longest, a quarter, a sixteenth and so on of `metres`, at which a spot meets some 40 candidates for each of the k on
    average, which is counted by cells; spots that lack some go on with twice the radius, up to `metres`.
    """
    spots, goals, radius = written(_spots(left), "spots"), written(_goals(right), "goals"), metres
    most = max(1, spots._held[0]) * 40 * k
    while radius > 1 and _loads(*_celled(spots, goals, radius), ["band", "cell"])[1] > most:
        radius /= 4
    waiting, done = spots, []
    while True:
        found = written(nearest(_meeting(*_celled(waiting, goals, radius), radius, ["band", "cell"]).select("key", "to", "metres"), k), "nearest")
        if radius >= metres:
            return functools.reduce(DataFrame.unionByName, [*done, found])
        full = found.filter(F.col("rank") == k).select(F.col("key").alias("full"))
        done.append(found.join(full, F.col("key").eqNullSafe(F.col("full")), "left_semi"))
        waiting, radius = written(waiting.join(full, F.col("key").eqNullSafe(F.col("full")), "left_anti"), "waiting"), min(metres, radius * 2)
        if not waiting._held[0]:
            return functools.reduce(DataFrame.unionByName, done)


#: Height in degrees of the cells whose neighbourhood is the whole globe, and by how much cells grow.
GLOBE, GROWTH = 128.0, 4.0


def pyramid(points: int) -> list[float]:
    """Heights of cells, finest first: the first is about the distance between so many points if they lay evenly, the last covers the globe."""
    even = 2 * (41_253 / max(1, points)) ** 0.5
    out = [GLOBE]
    while out[0] > max(even, 0.01):
        out.insert(0, out[0] / GROWTH)
    return out


def _band(lat: Column, step: float) -> Column:
    return F.floor(lat / step).cast("long")


def cells_around(band: Column, step: float) -> Column:
    """How many cells a band has: as many as keep a cell's width, at the band's own and its neighbours' latitudes, at `step` degrees of a great circle or more."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * step)
    return F.greatest(F.lit(1), F.floor(360.0 / step * F.cos(F.radians(far)))).cast("long")


def _cell(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * n), n).cast("long")


def least_metres(spots: DataFrame, points: DataFrame, key: list[str], steps: list[float] | None = None) -> DataFrame:
    """(`key`, kind, metres) from each spot (key, owner, lon, lat) to the nearest point (kind, owner, lon, lat) of each kind, of its owner or of none (null or ''); a kind without such a point has no row.

    Cells grow from round to round. In a round a spot meets the points of its own and the neighbouring cells, by an equi-join on (kind, owner, band, cell), and
    what it finds within half a cell's height is proven the nearest, since no farther cell reaches so near, across the 180th meridian and at the poles, too. Only
    spots without proof go on to the next round, four times as coarse; rounds begin at the points' mean distance and end when all are proven. Points stay in their
    partitions, from which only least distances move.
    """
    held = points.select("kind", F.coalesce("owner", F.lit("")).alias("p_owner"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    counts = {r.kind: r.n for r in held.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # kinds are a few words
    waiting, done = spots.select(*key, F.coalesce("owner", F.lit("")).alias("owner"), "lon", "lat").withColumn("kind", F.explode(F.array(*map(F.lit, sorted(counts))).cast("array<string>"))), []
    steps = steps or pyramid(max(counts.values(), default=0))
    for step in steps:
        band = F.explode(F.sequence(_band(F.col("lat"), step) - 1, _band(F.col("lat"), step) + 1)).alias("band")
        asked = waiting.select(*key, "kind", "lon", "lat", F.explode(F.array_distinct(F.array(F.col("owner"), F.lit("")))).alias("p_owner")).select("*", band).withColumn("n", cells_around(F.col("band"), step))
        own = F.floor((F.col("lon") + 180) / 360 * F.col("n"))
        asked = asked.withColumn("cell", F.explode(F.array_distinct(F.array(*(F.pmod(own + i, F.col("n")).cast("long") for i in (-1, 0, 1)))))).drop("n")
        there = held.withColumn("band", _band(F.col("p_lat"), step)).withColumn("cell", _cell(F.col("p_lon"), cells_around(F.col("band"), step)))
        metres = F.min(haversine_m(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat"))).alias("metres")
        met = there.join(small(asked), ["kind", "p_owner", "band", "cell"]).groupBy(*key, "kind").agg(metres)
        last = F.lit(step == steps[-1])
        found = written(waiting.join(met, [*key, "kind"], "left").withColumn("proven", last | F.coalesce(F.col("metres") <= step / 2 * 111_194.0, F.lit(False))), "nearest")
        done.append(found.filter("proven AND metres IS NOT NULL").select(*key, "kind", "metres"))
        waiting = found.filter("NOT proven").drop("metres", "proven")
        if step == steps[-1] or not waiting.take(1):
            break
    return functools.reduce(DataFrame.unionByName, done)


def nearest_known(points: DataFrame, lakes: DataFrame, ladder: tuple[float, ...] = (0.5, 15.0)) -> DataFrame:
    """(key, name, km) of the nearest lake nearer than a step of the ladder and no farther than its own radius; the first step that has one decides."""
    x = points.join(F.broadcast(lakes.select("name", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "radius_km")), F.lit(True))  # a fixed list
    km = haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"), 6_371.0)
    step = F.coalesce(*(F.when(F.col("km") < s, F.lit(i)) for i, s in enumerate(ladder)))
    x = x.select("key", "name", km.alias("km"), "radius_km").withColumn("step", step).filter((F.col("km") <= F.col("radius_km")) & F.col("step").isNotNull())
    return x.groupBy("key").agg(F.min(F.struct("step", "km", "name")).alias("x")).select("key", "x.name", "x.km")


#: So many places of a name around a spot are expected of the first slice; a later one is so many times larger.
_FIRST, _LATER = 6, 8


def first_named(spots: DataFrame, lakes: DataFrame, metres: float) -> DataFrame:
    """(key, name, to, metres): of each spot (key, lon, lat) the first place of every name in the order of its key, of the named lakes (key, lon, lat, name) at most `metres` away.

    Where a spot has few places of a name around it, that is the least of all pairs. Where it has many, as counted by cells, lakes are cut by key into slices that grow: what the first slice has of a
    name comes before all later ones, so only spots and names without any place yet meet the next slice.
    """
    on, none = ["band", "cell"], "name IS NOT NULL AND name <> ''"
    spots, goals = written(_spots(spots), "spots"), written(_goals(lakes.filter(none), "name"), "lakes")
    first = lambda pairs: pairs.groupBy("key", "name").agg(F.min(F.struct("to", "metres")).alias("first")).select("key", "name", "first.*")
    names = written(goals.select("name").distinct(), "names")
    around = 0.35 * _loads(*_celled(spots, goals, metres), on)[1] / max(1, spots._held[0] * names._held[0])  # a circle's share of nine cells
    share, cuts = _FIRST / around if around else 1.0, []
    while share < 0.5:
        cuts.append(share)
        share *= _LATER
    cuts = goals.approxQuantile("to", cuts, 0.0005 if cuts[0] > 0.005 else cuts[0] / 10) if cuts and isinstance(goals.schema["to"].dataType, NumericType) else []
    if not cuts:
        return first(_meeting(*_celled(spots, goals, metres), metres, on))
    waiting, done, low = spots, [], None
    for cut in [*dict.fromkeys(cuts), None]:
        part = F.col("to").isNull() if low is None else F.lit(False)
        part = goals.filter(part | ((F.lit(True) if low is None else F.col("to") > low) & (F.lit(True) if cut is None else F.col("to") <= cut)))
        a, b = _celled(waiting, part if low is None else part.withColumnRenamed("name", "own"), metres)
        pairs = _meeting(a, b, metres, on) if low is None else _meeting(a.withColumn("own", F.col("name")), b, metres, [*on, "own"])
        done.append(written(first(pairs), "first"))
        asked = spots.join(small(names)) if low is None else waiting
        found = done[-1].select(F.col("key").alias("k"), F.col("name").alias("n"))
        waiting, low = written(asked.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("name") == F.col("n")), "left_anti"), "waiting"), cut
        if not waiting._held[0]:
            break
    return functools.reduce(DataFrame.unionByName, done)


def listed_names(first: DataFrame, k: int = 10) -> DataFrame:
    """(key, name, km, rank) of `first_named`: kilometres to two places, nearest first (ties in the order of `to`), `k` at most."""
    w = Window.partitionBy("key").orderBy("km", "to")
    x = first.select("key", "name", F.round(F.col("metres") / 1000, 2).alias("km"), "to").withColumn("rank", F.row_number().over(w))
    return x.filter(F.col("rank") <= k).drop("to")


def nearby(pairs: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """(key, name, km, rank): of each key the first place of every name in the order of `to`, kilometres to two places, nearest first (ties in that order), `k` at most."""
    x = pairs.join(names.select(F.col("key").alias("to"), "name"), "to").filter("name IS NOT NULL AND name <> ''").groupBy("key", "name").agg(F.min(F.struct("to", "metres")).alias("first"))
    return listed_names(x.select("key", "name", "first.*"), k)


def others(listed: DataFrame, k: int = 4) -> DataFrame:
    """(position, other, name) of a list's first `k` other places, in list order, for every place of it.

    Only the first k + 1 places can be among them, so these few rows meet the list, never the list itself.
    """
    first = F.broadcast(listed.orderBy("position").limit(k + 1).select(F.col("position").alias("other"), "name"))
    x = listed.select("position").join(first, F.col("position") != F.col("other"))
    w = Window.partitionBy("position").orderBy("other")
    return x.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


def lake_search(spots: DataFrame, lakes: DataFrame, metres: float = 15_000.0, k: int = 10, listed: int = 4) -> DataFrame:
    """(key, name, km, rank, others): of each spot (key, lon, lat) the named lakes (key, lon, lat, name) around it as `nearby` lists them, each with the first `listed` others of its list."""
    near = listed_names(first_named(spots, lakes, metres), k)
    around = F.sort_array(F.collect_list(F.struct("rank", "name")).over(Window.partitionBy("key")))  # k at most
    rest = F.filter(around, lambda x: x["rank"] != F.col("rank"))
    return near.withColumn("others", F.slice(F.transform(rest, lambda x: x["name"]), 1, listed))


def around_detected(detected: DataFrame, near: DataFrame, k: int = 5) -> DataFrame:
    """(key, name, km, rank) of the first `k` of each spot's list that aren't the lake (key, name) detected there, whatever the case of its name; null, which is no lake, bars none."""
    x = near.select("key", "name", "km", "rank").join(detected.select("key", F.lower("name").alias("own")), "key")
    x = x.filter(F.col("own").isNull() | (F.lower("name") != F.col("own")))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("rank")))
    return x.filter(F.col("rank") <= k).drop("own")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(words))


def place_name() -> Column:
    """A name for a place from (name, class, addresstype, address map, display_name).

    A water tag that is a name, else a name with a water word, else a name that is no road's with its town, else the
    locality with its town, else the first two parts of the display name; nothing: null.
    """
    filled = lambda *keys: F.coalesce(*(F.nullif(F.try_element_at("address", F.lit(k)), F.lit("")) for k in keys))
    raw = F.nullif(F.regexp_replace(F.coalesce("name", F.lit("")), r"(?U)^\s+|\s+\z", ""), F.lit(""))
    water = filled("water", "reservoir", "lake", "pond", "waterway")
    locality, context = filled("suburb", "neighbourhood", "village", "town", "city", "municipality", "county"), filled("city", "state_district", "county", "state")
    road = F.coalesce((F.col("class") == "highway") | F.col("addresstype").isin("road", "highway"), F.lit(False)) | _any(raw, ROAD_WORDS)
    kept = F.filter(F.transform(F.split("display_name", ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"\A\d+\z") & (F.lower(p) != "india"))
    both = lambda a: F.when(context.isNotNull() & ~F.contains(F.lower(a), F.lower(context)), F.concat_ws(", ", a, context)).otherwise(a)
    town = F.when(context.isNotNull() & (F.lower(context) != F.lower(locality)), F.concat_ws(", ", locality, context)).otherwise(locality)
    parts = F.nullif(F.array_join(F.slice(kept, 1, 2), ", "), F.lit(""))
    return (
        F.when(water.isNotNull() & ~F.lower(water).isin(*NO_NAMES), F.initcap(water)).when(raw.isNotNull() & _any(raw, WATER_WORDS), raw)
        .when(raw.isNotNull() & ~road, both(raw)).when(locality.isNotNull(), town).otherwise(parts)
    )


ELEMENTS = "elements array<struct<type: string, id: long, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>, members: array<struct<type: string, role: string, geometry: array<struct<lat: double, lon: double>>>>>>"


def water_polygons(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(reply_id, osm_id, ring, position) of map replies as JSON: closed rings of at least three vertices, of rings with equal first three vertices the first."""
    e = replies.select("reply_id", F.posexplode(F.from_json(column, ELEMENTS)["elements"]).alias("at", "e"))
    own = F.array(F.struct(F.lit(0).alias("m"), F.col("e.geometry").alias("g")))
    outer = F.transform(F.coalesce("e.members", F.array()), lambda x, i: F.struct((i + 1).alias("m"), x["geometry"].alias("g")))
    rings = F.when(F.col("e.type") == "way", own).when(F.col("e.type") == "relation", outer).otherwise(F.array().cast("array<struct<m: int, g: array<struct<lat: double, lon: double>>>>"))
    r = e.select("reply_id", "at", F.col("e.id").alias("osm_id"), F.explode(rings).alias("r")).filter(F.size("r.g") >= 3).select("reply_id", "at", "osm_id", "r.m", F.col("r.g").alias("ring"))
    closed = F.when(F.get("ring", F.lit(0)) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    r = r.withColumn("ring", closed).withColumn("start", F.slice("ring", 1, 3).cast("string"))
    first = r.groupBy("reply_id", "start").agg(F.min_by(F.struct("osm_id", "ring", "at", "m"), F.struct("at", "m")).alias("x"))
    return first.select("reply_id", "x.osm_id", "x.ring", F.concat_ws(".", F.col("x.at").cast("string"), F.col("x.m").cast("string")).alias("position"))

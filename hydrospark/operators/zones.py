"""Areas as features: (body_id, feature, zone_id, polygons), polygons being an array of polygons, each an array of rings of (lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_polygon
from .covers import with_hits

POLYGONS = "array<array<array<struct<lon: double, lat: double>>>>"


def in_geometry(lon: Column, lat: Column, polygons: Column) -> Column:
    """Inside any of the polygons; a geometry without one (a point) holds nothing."""
    return F.exists(polygons, lambda p: in_polygon(lon, lat, p))


def polygons_of(kind: Column, coordinates: Column) -> Column:
    """Polygons of GeoJSON coordinates as text; other kinds than Polygon and MultiPolygon have none."""
    rings = F.when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).when(kind == "MultiPolygon", coordinates).otherwise("[]")
    pairs = F.from_json(rings, "array<array<array<array<double>>>>")
    return F.transform(pairs, lambda p: F.transform(p, lambda r: F.transform(r, lambda x: F.struct(x[0].alias("lon"), x[1].alias("lat")))))


def checked_boundaries(catalog: DataFrame) -> DataFrame:
    """The catalog's rows; one whose boundary is neither Polygon nor MultiPolygon ends the run with its body's name."""
    wrong = F.concat(F.lit("boundary of "), "body_id", F.lit(" must be Polygon or MultiPolygon"))
    return catalog.withColumn("type", F.when(F.col("type").isin("Polygon", "MultiPolygon"), F.col("type")).otherwise(F.raise_error(wrong).cast("string")))


def feature_id(ident: Column, name: Column, fallback: Column) -> Column:
    """Id, else name, else the fallback; an empty text counts as missing."""
    return F.coalesce(F.nullif(ident, F.lit("")), F.nullif(name, F.lit("")), fallback)


def feature_name(ident: Column, name: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(ident, F.lit("")), fallback)


def burn(pixels: DataFrame, features: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds zone_index and zone_id by the pixel's centre: of features that overlap the later one wins; none: 0 and null. Pixels meet their cell's cover (see `covers`)."""
    hit = with_hits(pixels, features, x, y, "__hits").withColumn("__hit", F.try_element_at("__hits", F.lit(-1)))
    return hit.select(*pixels.columns, F.coalesce("__hit.feature", F.lit(0)).alias("zone_index"), F.col("__hit.zone_id").alias("zone_id"))


def locate(points: DataFrame, boundaries: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds where (outside_water_boundary, inside_boundary, inside_zone) and zone_id, of overlapping zones the first.

    Points meet one cover of boundaries and zones by cell, so a body's points spread over tasks and no polygon is tested but near its edge.
    """
    both = boundaries.withColumn("feature", F.col("feature") * 2).unionByName(zones.withColumn("feature", F.col("feature") * 2 + 1))  # even: a boundary
    out = with_hits(points, both, "lon", "lat", "__hits")
    inside = F.exists("__hits", lambda f: f["feature"] % 2 == 0)
    hit = F.get(F.filter("__hits", lambda f: f["feature"] % 2 != 0), F.lit(0))
    where = F.when(~inside, "outside_water_boundary").when(hit.isNull(), "inside_boundary").otherwise("inside_zone")
    return out.select(*points.columns, where.alias("where"), F.when(inside, hit["zone_id"]).alias("zone_id"))


def in_flagged_zone(located: DataFrame, scores: DataFrame, dates: DataFrame) -> DataFrame:
    """Adds zone_flagged: the point's zone is flagged on its body's last configured date."""
    last = dates.groupBy("body_id").agg(F.max("date").alias("date"))
    flags = scores.join(last, ["body_id", "date"], "left_semi").filter("flagged").select("body_id", "zone_id", F.lit(True).alias("zone_flagged"))
    return located.join(flags, ["body_id", "zone_id"], "left").withColumn("zone_flagged", F.coalesce("zone_flagged", F.lit(False)))


def bounds(features: DataFrame) -> DataFrame:
    """Per body the box around all its features' vertices; a body without vertices has nulls."""
    vertex = F.explode_outer(F.flatten(F.flatten("polygons")))
    v = features.select("body_id", vertex.alias("p"))
    return v.groupBy("body_id").agg(*(f(f"p.{k}").alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in ("lon", "lat")))


def zone_map(features: DataFrame, analysis: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON document per (body, date): every feature with its geometry, analysed or not, and the properties of its analysis."""
    dates = analysis.select("body_id", "date").distinct()
    rows = features.join(dates, "body_id").join(analysis, ["body_id", "date", "zone_id"], "left")
    pairs = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda x: F.array(x["lon"], x["lat"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates"))
    entry = F.struct("feature", F.struct(F.lit("Feature").alias("type"), F.struct(F.col("zone_id").alias("id"), *properties).alias("properties"), geometry.alias("geometry")).alias("f"))
    by = rows.groupBy("body_id", "date").agg(F.sort_array(F.collect_list(entry)).alias("z"))
    return by.select("body_id", "date", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("z.f").alias("features"))).alias("document"))


def compare_dates(analysis: DataFrame, date: Column, other: Column, values: list[str]) -> DataFrame:
    """Zones of two dates side by side; a zone that only one of them has stays, with nulls on the other side."""
    side = lambda d, n: analysis.filter(F.col("date") == d).select("body_id", "zone_id", *(F.col(v).alias(f"{v}_{n}") for v in values))
    return side(date, "now").join(side(other, "then"), ["body_id", "zone_id"], "full_outer")

"""Distances, rings and tiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6_371_000.0) -> Column:
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dp) * F.sin(dp) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl) * F.sin(dl)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def crosses(lon: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the edge from a to b has the place on its left at the place's latitude."""
    rise = F.when(by == ay, 1e-15).otherwise(by - ay)
    return ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / rise + ax)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test against an array of (lon, lat); a ring of fewer than three points holds nothing."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + n - 1) % n).alias("b")))

    hit = lambda p: crosses(lon, lat, p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"])
    return (n >= 3) & (F.size(F.filter(pairs, hit)) % 2 == 1)


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside the first ring and outside all others."""
    return in_ring(lon, lat, F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, 2, 1_000_000), lambda r: in_ring(lon, lat, r))


def on_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether the place lies on an edge of the ring, ends included."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + n - 1) % n).alias("b")))

    def touches(p: Column) -> Column:
        (ax, ay), (bx, by) = ((p[e]["lon"], p[e]["lat"]) for e in "ab")
        return lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by)) & ((bx - ax) * (lat - ay) == (by - ay) * (lon - ax))

    return (n >= 3) & F.exists(pairs, touches)


def within_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """`in_polygon` with edges as SQL's strict comparisons have them: a place on the first ring lies outside, one on another ring isn't in the hole."""
    strictly = lambda r: in_ring(lon, lat, r) & ~on_ring(lon, lat, r)
    return strictly(F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, 2, 1_000_000), strictly)


def ring_centroid(ring: Column, closing: bool) -> Column:
    """Mean of a ring's vertices, with or without the one that closes it."""
    open_ = ring if closing else F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    mean = lambda k: F.aggregate(open_, F.lit(0.0), lambda s, p: s + p[k]) / F.size(open_)
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def tile_of(lon: Column, lat: Column, zoom: int) -> Column:
    """Web-mercator tile (x, y)."""
    n, rad = float(1 << zoom), F.radians(lat)
    y = (1 - F.asinh(F.tan(rad)) / F.lit(3.141592653589793)) / 2 * n
    return F.struct(((lon + 180) / 360 * n).cast("int").alias("x"), y.cast("int").alias("y"))


def circle(lon: Column, lat: Column, radius_km: Column, points: int = 36) -> Column:
    """A closed ring of `points` points around a centre, to 6 decimals."""
    def at(i: Column) -> Column:
        a = F.radians(i * (360.0 / points))
        dlat = radius_km / 111.0
        return F.struct(F.round(lon + dlat * F.cos(a) / F.greatest(F.lit(0.1), F.cos(F.radians(lat))), 6).alias("lon"), F.round(lat + dlat * F.sin(a), 6).alias("lat"))

    return F.transform(F.concat(F.sequence(F.lit(0), F.lit(points - 1)), F.array(F.lit(0))), at)

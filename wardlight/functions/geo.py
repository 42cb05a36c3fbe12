"""Geometry as column expressions. A ring is an array of structs (x, y), closed: its last point is its first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def edges(ring: Column) -> Column:
    """An array of structs (a, b): the ring's sides."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring, by the parity of the sides that a ray to the right crosses; lower and left sides belong to it."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        rise = F.when(b["y"] == a["y"], F.lit(1e-12)).otherwise(b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / rise + a["x"])

    return F.aggregate(edges(ring), F.lit(False), lambda odd, e: odd != crossed(e))


def signed_area(ring: Column) -> Column:
    """Shoelace area in the ring's units, positive against the clock."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def ring_area_m2(ring: Column) -> Column:
    """Area of a ring of degrees in square metres, on the plane that is true to scale at the ring's mean latitude."""
    middle = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(ring)
    degree = F.lit(EARTH_M) * F.radians(F.lit(1.0))
    return F.abs(signed_area(ring)) * degree * degree * F.cos(F.radians(middle))


def polygon_area_m2(rings: Column) -> Column:
    """Area in square metres of an array of rings: the first one's less those of its holes."""
    areas = F.transform(rings, ring_area_m2)
    return F.aggregate(areas, 2 * F.get(areas, F.lit(0)), lambda s, a: s - a)


def centroid(ring: Column) -> Column:
    """Struct (x, y): the centre of a ring's area, relative to its first point for precision."""
    o = ring[0]
    part = lambda k: F.aggregate(
        edges(ring), F.lit(0.0),
        lambda s, e: s + (e["a"][k] + e["b"][k] - 2 * o[k]) * ((e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])),
    )
    area6 = signed_area(ring) * 6
    return F.struct((o["x"] + part("x") / area6).alias("x"), (o["y"] + part("y") / area6).alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring against the clock."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Planar distance from a point to the segment between two points."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ox, oy = x - a["x"] - t * dx, y - a["y"] - t * dy
    return F.sqrt(ox * ox + oy * oy)  # hypot rounds otherwise than a plain root, which tells between equals


def compass(bearing: Column) -> Column:
    """N, NE, E ... of a bearing in degrees."""
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, F.pmod(F.bround(bearing / 45).cast("int"), F.lit(8)) + 1)


def utm_epsg(lon: Column) -> Column:
    """The northern UTM zone of a longitude as an EPSG number."""
    return F.lit(32600) + F.floor((lon + 180) / 6).cast("int") + 1


def web_mercator(lon: Column, lat: Column) -> Column:
    """Struct (x, y) in EPSG 3857."""
    r = 6_378_137.0
    return F.struct((F.radians(lon) * r).alias("x"), (F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * r).alias("y"))

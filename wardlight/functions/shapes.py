"""Measures of general polygons and paths as column expressions. A polygon is an array of rings: the first its outline, the others holes; a ring or path is an array of structs (x, y).

Overlaps need no clipped outline: a polygon's inside is the signed sum of the strips below its sides, so the area that two polygons share is the signed sum, over pairs of sides, of what lies below both.
Concave outlines and holes need no cases of their own. Sides must not cross each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.functions import geo

#: Two angles or distances closer than this are one.
TINY = 1e-12


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def sides(rings: Column) -> Column:
    """All sides (a, b) of a polygon with its inside on their left: the outline against the clock, holes with it."""

    def turned(ring: Column, i: Column) -> Column:
        against = geo.signed_area(ring) > 0
        return geo.once(F.when(against == (i == 0), ring).otherwise(F.reverse(ring)), geo.edges)

    return F.flatten(F.transform(rings, turned))


def area(rings: Column) -> Column:
    """Area in the coordinates' units."""
    parts = F.transform(rings, lambda r: F.abs(geo.signed_area(r)))
    return F.aggregate(parts, 2 * F.get(parts, F.lit(0)), lambda s, a: s - a)


def bounds(rings: Column) -> Column:
    """Struct (x0, y0, x1, y1) of the outline; nulls without one."""
    ring = F.get(rings, F.lit(0))
    of = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def inside(x: Column, y: Column, polygon_sides: Column) -> Column:
    """Whether a point is in the polygon of these sides, by the parity of the sides to its right."""
    crossed = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] == e["a"]["y"], TINY).otherwise(e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.aggregate(polygon_sides, F.lit(False), lambda odd, e: odd != crossed(e))


def strips(polygon_sides: Column, x0: Column, x1: Column, base: Column) -> Column:
    """The strips below the sides that reach into x0..x1: structs (l, r, yl, yr, sign), y above the base; upright sides have none."""
    reaching = F.filter(polygon_sides, lambda e: (e["a"]["x"] != e["b"]["x"]) & (F.greatest(e["a"]["x"], e["b"]["x"]) > x0) & (F.least(e["a"]["x"], e["b"]["x"]) < x1))

    def strip(e: Column) -> Column:
        right = e["b"]["x"] > e["a"]["x"]  # a side that runs to the right has the inside above it
        pick = lambda k, first: F.when(right == first, e["a"][k]).otherwise(e["b"][k])
        return F.struct(pick("x", True).alias("l"), pick("x", False).alias("r"), (pick("y", True) - base).alias("yl"), (pick("y", False) - base).alias("yr"), F.when(right, -1.0).otherwise(1.0).alias("sign"))

    return F.transform(reaching, strip)


def _below_both(s: Column, t: Column) -> Column:
    """The area below both of two strips."""
    left, right = F.greatest(s["l"], t["l"]), F.least(s["r"], t["r"])
    at = lambda q, x: q["yl"] + (q["yr"] - q["yl"]) * (x - q["l"]) / (q["r"] - q["l"])
    s0, s1, t0, t1 = at(s, left), at(s, right), at(t, left), at(t, right)
    d0, d1 = s0 - t0, s1 - t1
    low = (F.least(s0, t0) + F.least(s1, t1)) / 2
    # where the two cross in between, the lower line is bent: what the chord takes too much or too little is the triangle at the crossing
    bend = F.when(d0 * d1 < 0, F.abs(d0) * F.abs(d1) / (2 * (F.abs(d0) + F.abs(d1)))).otherwise(0.0)
    return F.when(right > left, (low + bend) * (right - left)).otherwise(0.0)


def overlap_area(sides_a: Column, bounds_a: Column, sides_b: Column, bounds_b: Column) -> Column:
    """The area that two polygons share, from their sides and bounds."""
    x0, x1 = F.greatest(bounds_a["x0"], bounds_b["x0"]), F.least(bounds_a["x1"], bounds_b["x1"])
    base = F.least(bounds_a["y0"], bounds_b["y0"])
    of_b = strips(sides_b, x0, x1, base)
    total = F.aggregate(strips(sides_a, x0, x1, base), F.lit(0.0), lambda s, e: s + e["sign"] * F.aggregate(of_b, F.lit(0.0), lambda u, f: u + f["sign"] * _below_both(e, f)))
    apart = (x1 <= x0) | (F.least(bounds_a["y1"], bounds_b["y1"]) <= F.greatest(bounds_a["y0"], bounds_b["y0"]))
    return F.when(apart, 0.0).otherwise(F.greatest(total, F.lit(0.0)))


def inside_point(rings: Column) -> Column:
    """A point inside the polygon: the middle of the widest run of a level line, halfway between the two corner heights around the middle of its bounds. Null without an area."""

    def level(heights: Column) -> Column:
        middle = (F.array_min(heights) + F.array_max(heights)) / 2
        return geo.once(middle, lambda m: (F.array_max(F.filter(heights, lambda h: h <= m)) + F.array_min(F.filter(heights, lambda h: h > m))) / 2)

    def crossings(y: Column) -> Column:
        met = F.filter(sides(rings), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        return F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"])))

    def widest(xs: Column) -> Column:
        run = lambda x, i: geo.once(F.get(xs, i - 1), lambda before: F.struct(F.round(x - before, 12).alias("width"), (-i).alias("first"), ((x + before) / 2).alias("x")))
        return F.array_max(F.filter(F.transform(xs, run), lambda r: (r["first"] % 2 != 0) & r["width"].isNotNull()))

    heights = F.array_sort(F.array_distinct(F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))))
    middle_of = lambda y: geo.once(geo.once(crossings(y), widest), lambda w: F.when(w.isNotNull() & (w["width"] > 0), point(w["x"], y)))
    return geo.once(geo.once(heights, level), middle_of)


def length(path: Column) -> Column:
    """Length along a path in its units; 0 of fewer than two points."""
    return F.aggregate(geo.edges(path), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def haversine_length(path: Column) -> Column:
    """Length in metres along a path of longitudes and latitudes."""
    return F.aggregate(geo.edges(path), F.lit(0.0), lambda s, e: s + geo.haversine(e["a"]["y"], e["a"]["x"], e["b"]["y"], e["b"]["x"]))


def simplified(path: Column, tolerance: float) -> Column:
    """The path with those inner points left out that lie within the tolerance of the line between the kept ones around them (Douglas-Peucker: split at the farthest point, the first of equals).

    A fold with a stack of the spans that are still to be looked at; each step takes one and puts its two halves back, or settles it. A path of fewer than three points stays.
    """
    n = F.size(path)
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    start = F.struct(F.array(span(F.lit(0), n - 1)).alias("open"), F.array(F.lit(0), n - 1).alias("kept"))

    def step(state: Column, _: Column) -> Column:
        top = F.get(state["open"], F.size(state["open"]) - 1)
        rest = F.slice(state["open"], F.lit(1), F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        a, b = F.get(path, top["lo"]), F.get(path, top["hi"])
        inner = F.sequence(top["lo"] + 1, F.greatest(top["hi"] - 1, top["lo"] + 1))
        far = F.array_max(F.transform(inner, lambda i: F.struct(geo.segment_distance(F.get(path, i)["x"], F.get(path, i)["y"], a, b).alias("d"), (-i).alias("at"))))
        split = (top["hi"] - top["lo"] > 1) & (far["d"] > tolerance)
        at = -far["at"]
        halves = F.concat(rest, F.array(span(top["lo"], at), span(at, top["hi"])))
        out = F.struct(F.when(split, halves).otherwise(rest).alias("open"), F.when(split, F.concat(state["kept"], F.array(at))).otherwise(state["kept"]).alias("kept"))
        return F.when(F.size(state["open"]) == 0, state).otherwise(out)

    done = F.aggregate(F.sequence(F.lit(1), 2 * n), start, step, lambda s: F.array_sort(s["kept"]))
    return F.when(n < 3, path).otherwise(F.transform(done, lambda i: F.get(path, i)))


def clipped(path: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The pieces of a path inside a box, in order: arrays of points, which begin and end where the path enters and leaves. A piece that only touches the box is left out.

    Each side keeps its part between two shares of its length; parts join where one ends and the next begins at the same corner of the path.
    """

    def part(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        enter, leave = [F.lit(0.0)], [F.lit(1.0)]
        out = F.lit(False)
        for d, p, low, high in ((dx, a["x"], x0, x1), (dy, a["y"], y0, y1)):
            s, t = F.try_divide(low - p, d), F.try_divide(high - p, d)
            enter.append(F.coalesce(F.least(s, t), F.lit(0.0)))
            leave.append(F.coalesce(F.greatest(s, t), F.lit(1.0)))
            out = out | ((d == 0) & ((p < low) | (p > high)))
        t0, t1 = F.greatest(*enter), F.least(*leave)
        at = lambda t: F.when(t == 0, a).when(t == 1, b).otherwise(point(a["x"] + dx * t, a["y"] + dy * t))
        return F.struct((~out & (t0 < t1)).alias("within"), (t0 == 0).alias("from_start"), (t1 == 1).alias("to_end"), at(t0).alias("a"), at(t1).alias("b"))

    empty = F.array().cast("array<array<struct<x:double,y:double>>>")
    state = F.struct(empty.alias("pieces"), F.lit(False).alias("open"))

    def add(s: Column, p: Column) -> Column:
        last = F.size(s["pieces"])
        longer = F.concat(F.slice(s["pieces"], F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.get(s["pieces"], last - 1), F.array(p["b"]))))
        grown = F.when(s["open"] & p["from_start"], longer).otherwise(F.concat(s["pieces"], F.array(F.array(p["a"], p["b"]))))
        return F.struct(F.when(p["within"], grown).otherwise(s["pieces"]).alias("pieces"), (p["within"] & p["to_end"]).alias("open"))

    straight = F.filter(geo.edges(path), lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"]))
    return F.aggregate(F.transform(straight, part), state, add, lambda s: s["pieces"])

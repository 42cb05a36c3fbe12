"""Joins and unions of general polygons: (id, rings), the first ring the outline, the others holes."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import geo, shapes
from wardlight.plans.session import cut_lineage

#: Bytes of a tiled side that may be broadcast, by its counted tiles and corners.
BROADCAST_BYTES = 16 << 20


def tile_width(polys: DataFrame, box: Column) -> tuple[float, int]:
    """The side of square tiles that fits these polygons, twice their mean extent, and the bytes of all of them on such tiles, about."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    corners = F.coalesce(F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)), F.lit(0))
    extent, n, total = polys.agg(F.avg(F.greatest(w, h)), F.count(F.lit(1)), F.sum(corners)).first()
    return (2 * extent if extent else 1.0), 4 * (64 * n + 80 * (total or 0))


def tiled(polys: DataFrame, prefix: str, width: float, keep: list[str], box: Column | None = None) -> DataFrame:
    """Each polygon with its sides, bounds (those of its rings unless given) and area once for each tile that its bounds meet."""
    box = shapes.bounds(F.col("rings")) if box is None else box
    named = polys.select(*[F.col(c).alias(f"{prefix}_{c}") for c in keep], shapes.sides(F.col("rings")).alias(f"{prefix}_sides"), box.alias(f"{prefix}_box"), shapes.area(F.col("rings")).alias(f"{prefix}_area"))
    span = lambda k: F.explode(F.sequence(F.floor(F.col(f"{prefix}_box")[f"{k}0"] / width), F.floor(F.col(f"{prefix}_box")[f"{k}1"] / width)))
    named = named.where(F.col(f"{prefix}_box")["x0"].isNotNull() & F.col(f"{prefix}_box")["y0"].isNotNull())
    return named.withColumn("_tx", span("x")).withColumn("_ty", span("y"))


def overlaps(a: DataFrame, b: DataFrame, keep_a: list[str] | None = None, keep_b: list[str] | None = None, least_area: float = 0.0) -> DataFrame:
    """Every pair that shares more than the least area: a_id, b_id (and a_, b_ of the kept columns), overlap, share_of_a, share_of_b.

    Both sides are dealt to tiles of the size of their polygons and joined on them; the smaller one is broadcast if its counted tiles are few. A pair is made in one tile alone, that of the lower left corner of
    what their bounds share. Polygons without rings meet nothing; repeated rows give repeated pairs. Polygons that only touch may share
    what their coordinates' rounding makes of a side, which a least area leaves out.
    """
    box = shapes.bounds(F.col("rings"))
    (wa, bytes_a), (wb, bytes_b) = tile_width(a, box), tile_width(b, box)
    width = max(wa, wb)
    left, right = tiled(a, "a", width, ["id", *(keep_a or [])]), tiled(b, "b", width, ["id", *(keep_b or [])])
    if min(bytes_a, bytes_b) * (width / min(wa, wb)) <= BROADCAST_BYTES:
        left, right = (F.broadcast(left), right) if bytes_a < bytes_b else (left, F.broadcast(right))
    corner = lambda k: F.floor(F.greatest(F.col("a_box")[f"{k}0"], F.col("b_box")[f"{k}0"]) / width)
    pairs = left.join(right, ["_tx", "_ty"]).where((F.col("_tx") == corner("x")) & (F.col("_ty") == corner("y")))
    shared = shapes.overlap_area(F.col("a_sides"), F.col("a_box"), F.col("b_sides"), F.col("b_box"))
    out = pairs.withColumn("overlap", shared).where(F.col("overlap") > least_area)
    return out.withColumn("share_of_a", F.col("overlap") / F.col("a_area")).withColumn("share_of_b", F.col("overlap") / F.col("b_area")).drop("_tx", "_ty", "a_sides", "b_sides", "a_box", "b_box", "a_area", "b_area")


def above_threshold(pairs: DataFrame, least_area: float, least_share: float) -> DataFrame:
    """Pairs of overlaps() without slivers: small both in area and as a share of a."""
    return pairs.where(~((F.col("overlap") < least_area) & (F.col("share_of_a") < least_share)))


def overlay_weighted(a: DataFrame, b: DataFrame, value: str, least_area: float = 0.0) -> DataFrame:
    """(id, mean, most) for every polygon of a: the mean of b's value weighted by shared area, and the largest; nulls where nothing is shared. Null values of b don't count, nor what is shared up to the least area."""
    pairs = overlaps(a, b, keep_b=[value], least_area=least_area).where(F.col(f"b_{value}").isNotNull())
    v = F.col(f"b_{value}")
    met = pairs.groupBy(F.col("a_id").alias("id")).agg((F.sum(v * F.col("overlap")) / F.sum("overlap")).alias("mean"), F.max(v).alias("most"))
    return a.select("id").join(met, "id", "left")


def best_overlap(a: DataFrame, b: DataFrame, label: str, fallback: str, order: str = "ordinal", places: int = 12, least_area: float = 0.0) -> DataFrame:
    """(id, label) for every polygon of a: the label of the polygon of b that shares most area with it, the first in order of equals (areas are rounded); the fallback column of a where none shares area or the best has a blank label."""
    pairs = overlaps(a, b, keep_b=[label, order], least_area=least_area)
    best = pairs.groupBy(F.col("a_id").alias("id")).agg(F.min_by(f"b_{label}", F.struct(-F.round("overlap", places), f"b_{order}")).alias("_best"))
    filled = F.when(F.trim("_best") != "", F.trim("_best"))
    return a.select("id", fallback).join(best, "id", "left").select("id", F.coalesce(filled, F.col(fallback)).alias(label))


def holding_siblings(polys: DataFrame, group: str, name: str, least: int = 2, origin: str | None = None) -> DataFrame:
    """(id, n): polygons that hold the centroids of at least so many others of another name in their group, as a parent drawn among its parts does. A centroid is of the outline's area.

    Rings may be given about an origin of each polygon, a column of structs (x, y): a centroid that lies on a side is then told by the sides' own lengths and not by what is left of them in large coordinates.
    """
    o = F.col(origin) if origin else F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    shape = shapes.bounds(F.col("rings"))
    box = F.struct(*[(shape[f"{k}{i}"] + o[k]).alias(f"{k}{i}") for i in (0, 1) for k in ("x", "y")])
    width, bytes_ = tile_width(polys, box)
    c = geo.centroid(F.get("rings", F.lit(0)))
    points = polys.select(F.col(group).alias("_group"), F.col(name).alias("_name"), F.struct((o["x"] + c["x"]).alias("x"), (o["y"] + c["y"]).alias("y")).alias("_c"))
    points = points.withColumn("_tx", F.floor(F.col("_c.x") / width)).withColumn("_ty", F.floor(F.col("_c.y") / width))
    areas = tiled(polys.withColumn("_origin", o), "a", width, ["id", group, name, "_origin"], box).withColumn("_group", F.col(f"a_{group}"))
    areas = F.broadcast(areas) if bytes_ <= BROADCAST_BYTES else areas
    held_in = shapes.inside(F.col("_c.x") - F.col("a__origin.x"), F.col("_c.y") - F.col("a__origin.y"), F.col("a_sides"))
    held = points.join(areas, ["_group", "_tx", "_ty"]).where((F.col("_name") != F.col(f"a_{name}")) & held_in)
    return held.groupBy(F.col("a_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def dissolve(polys: DataFrame, key: str) -> DataFrame:
    """(key, ring_no, hole, ring): the outline of the union of each key's polygons, as closed rings that begin at their least side; holes run with the clock.

    Polygons of a key may touch but not overlap, and neighbours must have the same corners: sides that two of them share run against each other and cancel. The sides left are numbered in the order of their corners and chained
    by doubling: each knows the side some steps ahead and the least side up to there, so a ring of n sides takes log2(n) joins on numbers, and no key's sides come together before their rings are known. A side whose two halves
    have the same least has been round its ring; it serves the others for one more round, which ends them too, and leaves, so a round costs what rings are still open. Where rings touch in a corner the next side is the sharpest
    to the left, which keeps them apart. Rings of a key are numbered by their least side. Null keys are one key; polygons without rings add nothing.
    """
    by = F.col(key).alias("_key")
    e = polys.select(by, F.explode(shapes.sides(F.col("rings"))).alias("e")).select("_key", F.col("e.a").alias("a"), F.col("e.b").alias("b")).where("a <> b")
    forward = F.struct("a.x", "a.y") < F.struct("b.x", "b.y")
    low, high = F.when(forward, F.col("a")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("a"))
    net = e.groupBy("_key", low.alias("_low"), high.alias("_high")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("_n")).where("_n <> 0")
    ends = net.select("_key", F.when(F.col("_n") > 0, F.col("_low")).otherwise(F.col("_high")).alias("a"), F.when(F.col("_n") > 0, F.col("_high")).otherwise(F.col("_low")).alias("b"))
    # a side's number orders it among its key's by its corners, with gaps between the ranges
    left = cut_lineage(ends.orderBy("_key", "a", "b").withColumn("id", F.monotonically_increasing_id()))
    out = left.select(F.col("_key").alias("_k"), F.col("a").alias("_at"), F.col("b").alias("_to"), F.col("id").alias("next"))
    met = left.join(out, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_at")))
    ux, uy, vx, vy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("_to.x") - F.col("_at.x"), F.col("_to.y") - F.col("_at.y")
    turn = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)  # to the left is positive; straight back last
    turn = F.when(turn >= math.pi - 1e-12, -math.pi).otherwise(turn)
    steps = cut_lineage(met.groupBy("id").agg(F.max_by("next", F.struct(turn, "next")).alias("ahead")).select("id", "ahead", F.col("id").alias("least"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("done")))
    ended, reach = [], 1
    while not (open_ := steps.where("not done")).isEmpty():
        there = steps.select(F.col("id").alias("ahead"), F.col("least").alias("_least"), F.col("offset").alias("_offset"), F.col("ahead").alias("_ahead"), F.col("done").alias("_done"))
        lower = F.col("_least") < F.col("least")
        least, offset = F.when(lower, F.col("_least")).otherwise(F.col("least")), F.when(lower, F.col("_offset") + reach).otherwise(F.col("offset"))
        doubled = open_.join(there, "ahead").select("id", F.col("_ahead").alias("ahead"), least.alias("least"), offset.alias("offset"), (F.col("_done") | (F.col("_least") == F.col("least"))).alias("done"))
        steps, reach = cut_lineage(doubled), 2 * reach
        ended.append(steps.where("done").select("id", "least", "offset"))
    placed = left.join(functools.reduce(DataFrame.unionByName, ended, steps.where("done").select("id", "least", "offset").limit(0)), "id")
    rings = placed.groupBy("_key", "least").agg(F.array_sort(F.collect_list(F.struct((F.when(F.col("offset") == 0, F.lit(-(1 << 62))).otherwise(-F.col("offset"))).alias("o"), F.col("a")))).alias("_c"))
    ring = F.transform("_c", lambda c: c["a"])
    closed = rings.withColumn("ring", F.concat(ring, F.slice(ring, 1, 1)))
    numbered = closed.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("least", "ring"))).alias("_rings"))
    one = numbered.select(F.col("_key").alias(key), F.posexplode("_rings").alias("ring_no", "_r"))
    return one.select(key, "ring_no", (geo.signed_area(F.col("_r.ring")) < 0).alias("hole"), F.col("_r.ring").alias("ring"))


TURN = 2 * math.pi


def _gaps(intervals: Column) -> Column:
    """What intervals (s, e) within 0..1 leave free, as structs (s, e) in order."""
    start = F.struct(F.array().cast("array<struct<s:double,e:double>>").alias("free"), F.lit(0.0).alias("upto"))

    def add(state: Column, i: Column) -> Column:
        gap = F.struct(state["upto"].alias("s"), i["s"].alias("e"))
        return F.struct(F.when(i["s"] > state["upto"] + shapes.TINY, F.concat(state["free"], F.array(gap))).otherwise(state["free"]).alias("free"), F.greatest(state["upto"], i["e"]).alias("upto"))

    last = lambda s: F.when(s["upto"] < 1 - shapes.TINY, F.concat(s["free"], F.array(F.struct(s["upto"].alias("s"), F.lit(1.0).alias("e"))))).otherwise(s["free"])
    return F.aggregate(F.array_sort(intervals), start, add, last)


def _near(points: DataFrame, width: float) -> DataFrame:
    """Each point once for its cell and the eight around it."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    dealt = points.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return dealt.withColumn("_cx", F.floor(F.col("x") / width) + F.col("_i")).withColumn("_cy", F.floor(F.col("y") / width) + F.col("_j")).drop("_i", "_j")


def disc_cover(points: DataFrame, radius: float, polys: DataFrame) -> DataFrame:
    """(id, area, covered, share) for every polygon: the area within the radius of any point (x, y), on the plane.

    Exact, by Green's theorem over the boundary of the covered part: the arcs of each circle that no other disc covers, where they run inside the polygon, and the parts of the polygon's sides that discs
    cover. Circles meet those near them through an equi-join on cells of two radii, and polygons' sides through one on cells of a radius. Points at one place are one disc; points without a coordinate none.
    A circle's neighbours come together, so the work grows with how crowded discs are, not with their number.
    """
    discs = cut_lineage(points.where("x is not null and y is not null").select("x", "y").distinct())
    d = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    other = _near(discs, 2 * radius).select(F.col("x").alias("x2"), F.col("y").alias("y2"), "_cx", "_cy")
    own = discs.withColumn("_cx", F.floor(F.col("x") / (2 * radius))).withColumn("_cy", F.floor(F.col("y") / (2 * radius)))
    # a disc d away covers the arc of acos(d / 2r) to both sides of its direction; angles are shares of a turn
    way, half = F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")) / TURN, F.acos(d / (2 * radius)) / TURN
    s = F.pmod(way - half, F.lit(1.0))
    e = s + 2 * half
    interval = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    parts = F.when(e > 1, F.array(interval(s, F.lit(1.0)), interval(F.lit(0.0), e - 1))).otherwise(F.array(interval(s, e)))
    covered = own.join(other, ["_cx", "_cy"]).where((d > 0) & (d < 2 * radius)).groupBy("x", "y").agg(F.flatten(F.collect_list(parts)).alias("_taken"))
    none = F.array().cast("array<struct<s:double,e:double>>")
    arcs = discs.join(covered, ["x", "y"], "left").select("x", "y", _gaps(F.coalesce("_taken", none)).alias("_free"))

    sides = cut_lineage(polys.select("id", shapes.sides(F.col("rings")).alias("_sides"), shapes.bounds(F.col("rings")).alias("_box"), shapes.area(F.col("rings")).alias("area")))
    cell = max(tile_width(polys, shapes.bounds(F.col("rings")))[0], 2 * radius)
    reach = lambda k: F.explode(F.sequence(F.floor((F.col("_box")[f"{k}0"] - radius) / cell), F.floor((F.col("_box")[f"{k}1"] + radius) / cell)))
    around = sides.where(F.col("_box.x0").isNotNull()).withColumn("_tx", reach("x")).withColumn("_ty", reach("y"))
    placed = lambda df: df.withColumn("_tx", F.floor(F.col("x") / cell)).withColumn("_ty", F.floor(F.col("y") / cell))

    # arcs inside: cut at the angles where sides cross the circle, kept where their middle is in the polygon
    def crossings(side: Column) -> Column:
        dx, dy = side["b"]["x"] - side["a"]["x"], side["b"]["y"] - side["a"]["y"]
        fx, fy = side["a"]["x"] - F.col("x"), side["a"]["y"] - F.col("y")
        a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - radius * radius
        root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
        at = lambda t: F.when((b * b - a * c > 0) & t.between(0, 1), F.pmod(F.atan2(fy + dy * t, fx + dx * t) / TURN, F.lit(1.0)))
        return F.array(at((-b - root) / a), at((-b + root) / a))

    cuts = F.array_sort(F.array_compact(F.flatten(F.transform(F.filter("_sides", lambda e: e["a"] != e["b"]), crossings))))

    def pieces(arc: Column) -> Column:
        inner = F.concat(F.array(arc["s"]), F.filter("_cuts", lambda t: (t > arc["s"]) & (t < arc["e"])), F.array(arc["e"]))
        return F.transform(F.slice(inner, F.lit(1), F.size(inner) - 1), lambda t, i: F.struct(t.alias("s"), F.get(inner, i + 1).alias("e")))

    def arc_area(p: Column) -> Column:
        a, b = p["s"] * TURN, p["e"] * TURN
        return (radius * radius * (b - a) + radius * (F.col("x") * (F.sin(b) - F.sin(a)) - F.col("y") * (F.cos(b) - F.cos(a)))) / 2

    middle = lambda p: (p["s"] + p["e"]) / 2 * TURN
    within = lambda p: shapes.inside(F.col("x") + radius * F.cos(middle(p)), F.col("y") + radius * F.sin(middle(p)), F.col("_sides"))
    met = placed(arcs.where(F.size("_free") > 0)).join(around, ["_tx", "_ty"]).withColumn("_cuts", cuts)
    inside = F.filter(F.flatten(F.transform("_free", pieces)), within)
    of_arcs = met.groupBy("id").agg(F.sum(F.aggregate(inside, F.lit(0.0), lambda t, p: t + arc_area(p))).alias("_arcs"))

    # sides inside discs: the union of the shares of each side that discs cover
    fx, fy = F.col("_side.a.x") - F.col("x"), F.col("_side.a.y") - F.col("y")
    dx, dy = F.col("_side.b.x") - F.col("_side.a.x"), F.col("_side.b.y") - F.col("_side.a.y")
    a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - radius * radius
    root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
    t0, t1 = F.greatest(F.lit(0.0), (-b - root) / a), F.least(F.lit(1.0), (-b + root) / a)
    single = sides.select("id", F.posexplode("_sides").alias("_no", "_side")).where("_side.a <> _side.b")
    lower = lambda k: F.least(F.col(f"_side.a.{k}"), F.col(f"_side.b.{k}"))
    upper = lambda k: F.greatest(F.col(f"_side.a.{k}"), F.col(f"_side.b.{k}"))
    spread = lambda k: F.explode(F.sequence(F.floor((lower(k) - radius) / cell), F.floor((upper(k) + radius) / cell)))
    reached = placed(discs).join(single.withColumn("_tx", spread("x")).withColumn("_ty", spread("y")), ["_tx", "_ty"]).where((b * b - a * c > 0) & (t0 < t1))
    per_side = reached.groupBy("id", "_no", "_side").agg(F.collect_list(interval(t0, t1)).alias("_in"))
    free = F.aggregate(_gaps(F.col("_in")), F.lit(0.0), lambda t, g: t + g["e"] - g["s"])
    turn = (F.col("_side.a.x") * F.col("_side.b.y") - F.col("_side.b.x") * F.col("_side.a.y")) / 2
    of_sides = per_side.groupBy("id").agg(F.sum(turn * (1 - free)).alias("_edges"))

    out = sides.select("id", "area").join(of_arcs, "id", "left").join(of_sides, "id", "left")
    total = F.coalesce("_arcs", F.lit(0.0)) + F.coalesce("_edges", F.lit(0.0))
    return out.select("id", "area", total.alias("covered"), F.try_divide(total, F.col("area")).alias("share"))

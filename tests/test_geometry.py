"""Polygons and paths against plain versions and fine sampling."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.functions import shapes
from wardlight.operators import polygons, transit

POLYGON = "id long, label string, ordinal long, rings array<array<struct<x:double,y:double>>>"


def closed(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def star(rnd, cx, cy, n, low, high):
    """A concave ring around a centre."""
    turn = [2 * math.pi * (i + rnd.random() * 0.8) / n for i in range(n)]
    return closed([(cx + r * math.cos(a), cy + r * math.sin(a)) for a in turn for r in [rnd.uniform(low, high)]])


def within(rings, x, y):
    """Parity of crossings of all rings, for arrays of points."""
    odd = np.zeros(x.shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def grid(n=900, size=10.0):
    at = (np.arange(n) + 0.5) * size / n
    return np.meshgrid(at, at), (size / n) ** 2


@pytest.fixture(scope="module")
def stars():
    rnd = random.Random(5)
    out = []
    for i in range(8):
        cx, cy = rnd.uniform(3, 7), rnd.uniform(3, 7)
        rings = [star(rnd, cx, cy, rnd.randint(5, 11), 1.2, 3.0)]
        if i % 2:
            rings.append(star(rnd, cx, cy, 6, 0.3, 0.9)[:: rnd.choice([1, -1])])
        if i % 3 == 0:
            rings[0] = rings[0][::-1]
        out.append((i, f"p{i}", i, rings))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, label, o, None if rings is None else [[(x, y) for x, y in r] for r in rings]) for i, label, o, rings in rows], POLYGON)


def test_overlaps_of_concave_polygons_with_holes(spark, stars):
    rows = [*stars, (90, "none", 90, None), (91, "empty", 91, [])]
    found = {(r.a_id, r.b_id): r for r in polygons.overlaps(frame(spark, rows[:4] + rows[8:]), frame(spark, rows[4:])).collect()}
    (x, y), cell = grid()
    masks = [within(s[3], x, y) for s in stars]
    for a in range(4):
        for b in range(4, 8):
            want = (masks[a] & masks[b]).sum() * cell
            assert (found[a, b].overlap if (a, b) in found else 0.0) == pytest.approx(want, abs=0.03)
            if (a, b) in found:
                assert found[a, b].share_of_a == pytest.approx(want / (masks[a].sum() * cell), abs=0.01)
    assert set(found) <= {(a, b) for a in range(4) for b in range(4, 8)}
    own = {r.a_id: r for r in polygons.overlaps(frame(spark, stars), frame(spark, stars)).where("a_id = b_id").collect()}
    assert len(own) == 8 and all(r.share_of_a == pytest.approx(1.0) for r in own.values())  # one piece in one tile, however many tiles both meet
    assert polygons.overlaps(frame(spark, []), frame(spark, stars)).count() == 0


def test_overlaps_without_a_broadcast_are_the_same(spark, stars, monkeypatch):
    want = sorted((r.a_id, r.b_id, round(r.overlap, 9)) for r in polygons.overlaps(frame(spark, stars), frame(spark, stars)).collect())
    monkeypatch.setattr(polygons, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted((r.a_id, r.b_id, round(r.overlap, 9)) for r in polygons.overlaps(frame(spark, stars), frame(spark, stars)).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_overlap_is_strict_and_falls_back(spark):
    box = lambda x0, y0, x1, y1: [closed([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]
    own = frame(spark, [(1, "own1", 0, box(0, 0, 2, 1)), (2, "own2", 0, box(10, 0, 11, 1)), (3, "own3", 0, box(20, 0, 21, 1)), (4, "own4", 0, None)]).withColumnRenamed("label", "own")
    other = frame(spark, [(7, "right", 1, box(1, 0, 3, 1)), (6, "left", 0, box(-1, 0, 1, 1)), (8, " ", 2, box(10, 0, 11, 1))])
    assert {r.id: r.label for r in polygons.best_overlap(own, other, "label", "own").collect()} == {1: "left", 2: "own2", 3: "own3", 4: "own4"}


def test_slivers_are_small_in_both(spark):
    pairs = spark.createDataFrame([(1.0, 0.5), (0.1, 0.5), (1.0, 0.01), (0.1, 0.01)], "overlap double, share_of_a double")
    assert polygons.above_threshold(pairs, 0.5, 0.1).count() == 3


def test_parents_hold_their_siblings(spark):
    box = lambda x0, y0, w: [closed([(x0, y0), (x0 + w, y0), (x0 + w, y0 + w), (x0, y0 + w)])]
    rows = [(1, "all", 0, box(0, 0, 10)), (2, "a", 0, box(1, 1, 2)), (3, "b", 0, box(5, 5, 2)), (4, "a", 0, box(1, 1, 1)), (5, "far", 0, box(50, 50, 1))]
    held = polygons.holding_siblings(frame(spark, rows).withColumn("g", F.lit("x")), "g", "label").collect()
    assert [(r.id, r.n) for r in held] == [(1, 3)]
    apart = frame(spark, rows).withColumn("g", F.col("id").cast("string"))
    assert polygons.holding_siblings(apart, "g", "label").count() == 0


def test_dissolve_of_a_mosaic(spark):
    """Cells of a grid, keyed so that one key surrounds another, touches itself in a corner and has parts apart."""
    picture = ["aaaaa.b", "abbba..", "abcba.b", "abbba..", "aaaaac.", "......c"]
    cells = [(k, x, -y) for y, line in enumerate(picture) for x, k in enumerate(line) if k != "."]
    rows = [(i, k, 0, [closed([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])[:: -1 if i % 3 else 1]]) for i, (k, x, y) in enumerate(cells)]
    found = {}
    for r in polygons.dissolve(frame(spark, rows), "label").collect():
        ring = [(p.x, p.y) for p in r.ring]
        assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2
        assert r.hole == (area < 0)
        found.setdefault(r.label, []).append(area)
    assert sorted(found["a"]) == [-9.0, 25.0]
    assert sorted(found["b"]) == [-1.0, 1.0, 1.0, 9.0]
    assert sorted(found["c"]) == [1.0, 1.0, 1.0]
    assert polygons.dissolve(frame(spark, []), "label").count() == 0


def test_dissolve_carries_open_rings_alone(spark, monkeypatch):
    written, cut = [], polygons.cut_lineage
    monkeypatch.setattr(polygons, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    cells = [(x, 0) for x in range(40)] + [(2 * i, 5) for i in range(100)]
    rows = [(i, None if i % 2 and y else "a", 0, [closed([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])]) for i, (x, y) in enumerate(cells)]
    found = polygons.dissolve(frame(spark, rows), "label").collect()
    assert sorted(len(r.ring) - 1 for r in found) == [4] * 100 + [82] and sorted(r.ring_no for r in found if r.label is None) == list(range(50))
    assert all(r.ring[0] == min(r.ring) for r in found) and not any(r.hole for r in found)
    assert written[-1].count() <= 82 < written[1].count() == 482


def test_cover_by_discs(spark, stars):
    rnd = random.Random(2)
    points = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(25)]
    points += [points[0]] * 3 + [(None, 1.0), (points[1][0] + 1e-3, points[1][1])]
    found = {r.id: r for r in polygons.disc_cover(spark.createDataFrame(points, "x double, y double"), 1.1, frame(spark, [*stars, (50, "far", 0, [closed([(90, 90), (91, 90), (91, 91)])])])).collect()}
    (x, y), cell = grid(2000)
    near = np.zeros(x.shape, bool)
    for px, py in points:
        if px is not None:
            near |= (x - px) ** 2 + (y - py) ** 2 <= 1.1**2
    for i, _, _, rings in stars:
        inside = within(rings, x, y)
        assert found[i].share == pytest.approx((near & inside).sum() / inside.sum(), abs=1e-3)
    assert found[50].covered == 0.0
    whole = polygons.disc_cover(spark.createDataFrame([(5.0, 5.0)], "x double, y double"), 1.0, frame(spark, [(1, "b", 0, [closed([(0, 0), (10, 0), (10, 10), (0, 10)])])])).first()
    assert whole.covered == pytest.approx(math.pi)


def test_points_inside(spark, stars):
    for r in frame(spark, [*stars, (90, "none", 0, None)]).select("id", "rings", shapes.inside_point(F.col("rings")).alias("p")).collect():
        if r.rings is None:
            assert r.p is None
        else:
            assert within([[(p.x, p.y) for p in ring] for ring in r.rings], np.array([r.p.x]), np.array([r.p.y]))[0]


def peucker(path, tolerance):
    def far(i, lo, hi):
        (x, y), (ax, ay), (bx, by) = path[i], path[lo], path[hi]
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / n))
        return math.hypot(x - ax - t * dx, y - ay - t * dy)

    kept, open_ = {0, len(path) - 1}, [(0, len(path) - 1)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo > 1:
            d, at = max((far(i, lo, hi), -i) for i in range(lo + 1, hi))
            if d > tolerance:
                kept.add(-at)
                open_ += [(lo, -at), (-at, hi)]
    return [path[i] for i in sorted(kept)]


def test_simplified_paths(spark):
    rnd = random.Random(7)
    paths = [[(float(i), rnd.uniform(-1, 1)) for i in range(rnd.randint(3, 60))] for _ in range(20)]
    paths += [[(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0)], [], [(0.0, 0.0), (3.0, 1.0), (0.0, 0.0)]]
    table = spark.createDataFrame(list(enumerate(paths)) + [(99, None)], "id int, path array<struct<x:double,y:double>>")
    found = {r.id: r.s for r in table.select("id", shapes.simplified(F.col("path"), 0.6).alias("s")).collect()}
    for i, path in enumerate(paths):
        assert [(p.x, p.y) for p in found[i]] == (peucker(path, 0.6) if len(path) > 2 else path)
    assert found[99] is None


def test_clipped_paths(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    cases = {
        "through": ([(-1, 0.5), (2, 0.5)], [[(0, 0.5), (1, 0.5)]]),
        "twice": ([(-1, 0.2), (0.5, 0.2), (2, 0.2), (2, 0.8), (0.5, 0.8)], [[(0, 0.2), (0.5, 0.2), (1, 0.2)], [(1, 0.8), (0.5, 0.8)]]),
        "inside": ([(0.1, 0.1), (0.1, 0.1), (0.9, 0.1), (0.9, 0.9)], [[(0.1, 0.1), (0.9, 0.1), (0.9, 0.9)]]),
        "corner": ([(-1, 1), (1, 3)], []),
        "touches": ([(-1, 0.5), (0, 0.5), (-1, 0.7)], []),
        "apart": ([(5, 5), (6, 6)], []),
        "one": ([(0.5, 0.5)], []),
    }
    table = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, (p, _) in cases.items()], "id string, path array<struct<x:double,y:double>>")
    for r in table.select("id", shapes.clipped(F.col("path"), *box).alias("c")).collect():
        assert [[(pytest.approx(p.x), pytest.approx(p.y)) for p in piece] for piece in r.c] == cases[r.id][1]


def test_lines_of_a_city(spark):
    routes = spark.createDataFrame([("r1", "City Rail"), ("r2", "city bus"), ("r3", None)], "route_id string, route_name string")
    trips = spark.createDataFrame([("t1", "r1", "s1"), ("t2", "r1", "s2"), ("t3", "r2", None), ("t4", "r3", "s1")], "trip_id string, route_id string, shape_id string")
    times = spark.createDataFrame([(t, i, s) for t, stops in {"t1": "az", "t2": "abz", "t3": "ba", "t4": "ab"}.items() for i, s in enumerate(stops)], "trip_id string, stop_sequence int, stop_id string")
    stops = spark.createDataFrame([("a", 0.2, 0.2), ("b", 0.8, 0.2), ("z", 5.0, 5.0)], "stop_id string, x double, y double")
    shaped = transit.shape_paths(spark.createDataFrame([("s2", 2, 0.9, 0.5), ("s2", 1, 0.1, 0.5), ("s2", 3, 2.0, 0.5), ("s1", 1, 0.0, 0.0)], "shape_id string, sequence int, x double, y double"))
    tables = {"routes": routes, "trips": trips, "stop_times": times, "stops": stops}
    found = {r.route_id: r for r in transit.city_lines(tables, shaped, (0.0, 0.0, 1.0, 1.0), ["rail", "bus"]).collect()}
    assert set(found) == {"r1", "r2"}  # r3 has no name; t1 stops once
    assert found["r1"].trip_id == "t2" and [(p.x, p.y) for p in found["r1"].line] == [(0.1, 0.5), (0.9, 0.5)] and [(p.x, p.y) for p in found["r1"].pieces[0]] == [(0.1, 0.5), (0.9, 0.5), (1.0, 0.5)]
    assert [(p.x, p.y) for p in found["r2"].line] == [(0.8, 0.2), (0.2, 0.2)]
    longest = transit.longest_shape(trips, transit.shape_paths(spark.createDataFrame([("s1", 1, 0.0, 0.0), ("s1", 2, 1.0, 0.0), ("s2", 1, 0.0, 0.0), ("s2", 2, 1.0, 0.0)], "shape_id string, sequence int, x double, y double")))
    assert {r.route_id: r.trip_id for r in longest.collect()} == {"r1": "t1", "r3": "t4"}


def test_simplified_takes_the_first_of_equally_far_points(spark):
    path = [(72.51, 23.41), (72.302, 23.282), (72.476, 23.716), (72.809, 23.719), (72.684, 23.844), (72.073, 23.343), (72.076, 23.316), (72.281, 23.471), (72.738, 23.358)]  # an order of the tables: two of its points are equally far but for the last place
    rnd = random.Random(3)
    paths = [path] + [[(72 + rnd.randrange(1000) / 1000, 23 + rnd.randrange(1000) / 1000) for _ in range(rnd.randint(3, 7))] for _ in range(3000)]

    def kept(p):
        out, spans = {0, len(p) - 1}, [(0, len(p) - 1)]
        while spans:
            lo, hi = spans.pop()
            (ax, ay), (bx, by) = p[lo], p[hi]
            far = (0.25, 0)
            for i in range(lo + 1, hi):
                dx, dy, n = bx - ax, by - ay, (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
                f = max(0.0, min(1.0, ((p[i][0] - ax) * dx + (p[i][1] - ay) * dy) / n)) if n else 0.0
                ox, oy = p[i][0] - ax - f * dx, p[i][1] - ay - f * dy
                d = math.sqrt(ox * ox + oy * oy)
                if d > far[0]:
                    far = (d, i)
            if far[1]:
                out.add(far[1])
                spans += [(lo, far[1]), (far[1], hi)]
        return [p[i] for i in sorted(out)]

    # a triangle whose inner points lie on either side of its base, equally far but for the rounding
    paths += [[(72 + x / 1000, 23 + y / 1000), (72 + (x + 300) / 1000, 23 + (y + 400) / 1000), (72 + (x + 400) / 1000, 23 + (y - 300) / 1000), (72 + x / 1000, 23 + y / 1000)] for x, y in [(rnd.randrange(1000), rnd.randrange(1000)) for _ in range(500)]]
    rows = spark.createDataFrame(list(enumerate(paths)), "id int, path array<struct<x:double,y:double>>")
    got = {r.id: [(q.x, q.y) for q in r.p] for r in rows.select("id", shapes.simplified(F.col("path"), 0.25).alias("p")).collect()}
    assert [i for i, p in enumerate(paths) if got[i] != kept(p)] == []


def test_touching_polygons_share_no_area(spark):
    square = lambda x, y, w: [closed([(x, y), (x + w, y), (x + w, y + w), (x, y + w)])]
    a = frame(spark, [(1, "a", 1, square(72.31, 23.3, 0.09)), (2, "b", 2, square(72.39, 23.3, 0.01))])
    b = frame(spark, [(1, "left", 1, square(72.2, 23.2, 0.2)), (2, "right", 2, square(72.31 + 0.09 - 1e-14, 23.2, 0.2))]).withColumn("value", F.col("id"))
    assert [tuple(r) for r in polygons.overlay_weighted(a, b, "value", 1e-10).orderBy("id").collect()] == [(1, 1.0, 1), (2, 1.0, 1)]
    named = polygons.best_overlap(a, b.where("id = 2").withColumnRenamed("label", "name"), "name", "label", least_area=1e-10)
    assert {r.id: r.name for r in named.collect()} == {1: "a", 2: "b"}


def test_centroids_on_the_sides_of_siblings(spark):
    rnd = random.Random(11)
    rows = [(i, "g", f"n{i}", 72 + rnd.randrange(30) / 100, 23 + rnd.randrange(30) / 100, 0.3 if i % 10 == 0 else 0.06) for i in range(150)]
    ring = lambda w: closed([(0.0, 0.0), (w, 0.0), (w, w), (0.0, w)])
    made = [(i, g, n, (x, y), [ring(w)]) for i, g, n, x, y, w in rows]
    own = spark.createDataFrame(made, "id int, g string, name string, corner struct<x:double,y:double>, rings array<array<struct<x:double,y:double>>>")
    got = {r.id: r.n for r in polygons.holding_siblings(own, "g", "name", 2, "corner").collect()}
    within_ = lambda a, b: all(0 <= b[k] + b[5] / 2 - a[k] < a[5] for k in (3, 4))
    want = {a[0]: sum(within_(a, b) for b in rows if b[2] != a[2]) for a in rows}
    assert got == {i: n for i, n in want.items() if n >= 2}

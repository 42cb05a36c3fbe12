"""Fixtures with known results for what the driver tables don't reach."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.functions import coerce, forms, geo, stats
from wardlight.operators import finance, spatial, tables, transit
from wardlight.sources import readers, writers
from wardlight.streaming.daily import daily_mean_stream


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def square(spark, rows):
    made = spark.createDataFrame(rows, "poly_id string, ordinal int, x0 double, y0 double, x1 double, y1 double")
    return made.select("poly_id", "ordinal", geo.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))


def test_wards_and_services(spark):
    wards = square(spark, [("North", 0, 0.0, 0.0, 1.0, 1.0), ("South", 1, 2.0, 0.0, 3.0, 1.0)])
    points = spark.createDataFrame([(1, 0.25, 0.25), (2, 2.25, 0.25), (3, 9.0, 9.0)], "point_id int, x double, y double")
    assert {(r.poly_id, r.n) for r in spatial.count_per_polygon(points, wards).collect()} == {("North", 1), ("South", 1)}
    assert spatial.count_per_polygon(points.limit(0), wards).agg(F.sum("n")).first()[0] == 0


def test_first_polygon_wins(spark):
    wards = square(spark, [("b", 1, 0.0, 0.0, 1.0, 1.0), ("a", 0, 0.0, 0.0, 2.0, 2.0)])
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5)], "point_id int, x double, y double")
    assert {(r.point_id, r.poly_id) for r in spatial.first_containing(points, wards).collect()} == {(1, "a"), (2, "a")}


def test_grid_nearest_is_exact(spark, monkeypatch):
    import random

    rnd = random.Random(1)
    points = [(i, rnd.random(), rnd.random()) for i in range(60)]
    targets = [(i, rnd.random() * (1 if i % 9 else 8), rnd.random(), float(i)) for i in range(50)]
    monkeypatch.setattr(spatial, "ARRAY_ROWS", 10)
    got = spatial.nearest(spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(targets, "target_id int, x double, y double, value double"), 3)
    for r in got.collect():
        best = sorted((math.hypot(r.x - x, r.y - y), t) for t, x, y, _ in targets)[:3]
        assert [n["target_id"] for n in r.near] == [t for _, t in best]


def test_medians_and_quantiles(spark):
    df = spark.createDataFrame([(5.0, 10.0), (20.0, 80.0), (60.0, 10.0)], "v double, w double")
    q = stats.weighted_quantiles(df, "v", "w", [0.5, 0.9]).first()
    assert (q.q50, q.q90) == (20.0, 60.0)
    assert stats.threshold_shares(df, "v", "w", [30]).first().share == 90.0
    assert stats.weighted_median(df, "v", "w").first()[0] == 20.0
    assert stats.weighted_median(df.withColumn("w", F.lit(0.0)), "v", "w").first()[0] == 0.0


def test_scaling(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r.s for r in stats.min_max(df, "v", "s").collect()] == [0.0, 0.0]
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert same.agg(stats.pearson(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_first_wins(spark):
    df = spark.createDataFrame([("k", 0, 1.0), ("k", 1, 9.9)], "k string, o int, v double")
    assert [r.v for r in stats.first_wins(df, ["k"], [F.col("o")]).collect()] == [1.0]


def test_deflate(spark):
    index = spark.createDataFrame([(2011, 93.3), (2012, 102.5)], "fy_start int, index_value double")
    df = spark.createDataFrame([(2011, 100.0)], "fy_start int, amount double")
    assert finance.deflate(df, index, 2012).first().real == pytest.approx(100 * 102.5 / 93.3)
    with pytest.raises(Exception, match="no index for 1990"):
        finance.deflate(spark.createDataFrame([(1990, 1.0)], "fy_start int, amount double"), index, 2012).collect()


@pytest.mark.parametrize("text, want", [("Closing figures at 31-03-2018", "2017-18"), ("ward works 2014-15 v2", "2014-15"), ("no year", None)])
def test_fiscal_year(spark, text, want):
    assert one(spark, coerce.fiscal_in_text(F.lit(text))) == want


def test_coercions(spark):
    assert one(spark, coerce.numeric_tokens(F.lit("કુલ ૧,૨૩૪ અને 0 અને 56.5"))) == [1234.0, 56.5]
    assert one(spark, coerce.digits_only(F.lit("1,234.50"))) == 123450
    assert one(spark, coerce.clean_value(F.lit(" None "))) is None
    assert one(spark, coerce.roman(F.lit("iv"))) == 4
    assert one(spark, coerce.human_bytes(F.lit(2048))) == "2.0KB"
    assert one(spark, coerce.fiscal_valid(F.lit("2019-20"))) is True
    assert one(spark, coerce.fiscal_valid(F.lit("2019-21"))) is False
    assert one(spark, geo.compass(F.lit(350.0))) == "N"


def test_box_feed(spark):
    routes = spark.createDataFrame([("r1",), ("r2",)], "route_id string")
    trips = spark.createDataFrame([("t1", "r1"), ("t2", "r2")], "trip_id string, route_id string")
    times = spark.createDataFrame([("t1", 1, "a"), ("t1", 2, "b"), ("t2", 1, "a"), ("t2", 2, "z")], "trip_id string, stop_sequence int, stop_id string")
    stops = spark.createDataFrame([("a", 83.1, 17.6), ("b", 83.2, 17.7), ("z", 90.0, 20.0)], "stop_id string, x double, y double")
    feed = transit.filter_box(routes, trips, times, stops, transit.in_box(83.0, 17.5, 83.5, 18.0))
    assert [r.route_id for r in feed["routes"].collect()] == ["r1"]
    kept = transit.filter_routes(routes, trips, times, stops, F.col("route_id") == "r1")
    assert kept["stops"].count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "k string, value int, pos long")
    new = spark.createDataFrame([("b", 9, 0), ("c", 3, 1)], "k string, value int, pos long")
    assert sorted((r.pos, r.k, r.value) for r in tables.upsert(old, new, "k", "pos").collect()) == [(0, "a", 1), (1, "b", 9), (2, "c", 3)]


def test_links_and_labels(spark):
    pages = spark.createDataFrame([(1, '<a class=x href="/p">T <b>1</b></a><a href="q">u</a>')], "page_id int, html string")
    assert [(r.href, r.label) for r in tables.html_links(pages).orderBy("ordinal").collect()] == [("/p", "T 1"), ("q", "u")]


def test_geojson_round_trip(spark, tmp_path):
    polygon = {"type": "Feature", "properties": {"Name": "A", "n": "2"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    point = {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [polygon, point]}))
    got = readers.geojson(spark, str(tmp_path / "a.geojson")).orderBy("feature_id").collect()
    assert got[0].props["Name"] == "A" and got[0].rings[0][1].x == 1.0 and got[1].rings is None
    wards = square(spark, [("North", 0, 0.0, 0.0, 1.0, 1.0)])
    writers.feature_lines(wards, str(tmp_path / "out"), order="ordinal")
    assert readers.feature_lines(spark, str(tmp_path / "out")).first().type == "Polygon"


def test_ledger(spark, tmp_path):
    (tmp_path / "Work_Orders_for_X_Num-7_Ward.csv").write_text('Report\n,,\nJob Number,Name of Work,Nett\n1,"road, main","9,00,000"\n')
    r = readers.ledger(spark, str(tmp_path)).first()
    assert r.cells["Name of Work"] == "road, main" and one(spark, coerce.digits_only(F.lit(r.cells["Nett"]))) == 900000


def test_json_and_feed(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"results": [{"a": {"type": "Text", "value": "x"}, "b": "y"}]}))
    assert tuple(readers.json_rows(spark, str(tmp_path / "e.json"), ["a", "b"]).first()) == ("x", "y")
    (tmp_path / "stops.txt").write_text("﻿stop_id,stop_name\ns1,\n")
    assert readers.feed_table(spark, str(tmp_path), "stops").columns == ["stop_id", "stop_name"]
    assert readers.feed_table(spark, str(tmp_path), "shapes") is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select 's' station, timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,i*9) ts, double(i) value from (select explode(sequence(1,9)) i)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = daily_mean_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 0, 1200)
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = {(r.day, r.mean, r.n) for r in tables.daily_mean(rows, 0, 1200).collect()}
    assert {(r.day, r.mean, r.n) for r in spark.table("daily").collect()} == want


def test_nearest_line_is_the_nearest_of_all(spark):
    rng = np.random.default_rng(4)
    paths = [rng.uniform(0, 1, (int(rng.integers(2, 5)), 2)).tolist() for _ in range(120)] + [[[-40.0, -40.0], [60.0, 61.0]], [[0.5, 0.5], [0.5, 0.5]], [[0.2, 0.2]], None]
    paths += [paths[3]]  # a line twice: the smaller id
    points = [(k, *map(float, p)) for k, p in enumerate(np.concatenate([rng.uniform(0, 1, (300, 2)), rng.normal(0, 300, (6, 2))]))]
    lines = spark.createDataFrame([(k, p and [(x, y) for x, y in p]) for k, p in enumerate(paths)], "line_id int, path array<struct<x:double,y:double>>")
    frame = spark.createDataFrame([*points, (900, None, 0.5), (901, 0.5, None)], "point_id int, x double, y double")
    got = {r["point_id"]: (r["line_id"], r["d"]) for r in spatial.nearest_line(frame, lines).collect()}
    assert len(got) == len(points) + 2 and got[900] == got[901] == (None, None)
    for k, x, y in points:
        best = []
        for line, path in enumerate(paths):
            for a, b in zip((path or [])[:-1], (path or [])[1:], strict=True):
                a, b, p = np.array(a), np.array(b), np.array([x, y])
                t = min(1.0, max(0.0, float((p - a) @ (b - a) / max((b - a) @ (b - a), 1e-300))))
                best.append((round(float(np.hypot(*(p - a - t * (b - a)))), 9), line))
        d, line = min(best)
        assert got[k][0] == line and abs(got[k][1] - d) < 1e-8
    none = spatial.nearest_line(frame.limit(3), lines.where("false")).collect()
    assert [tuple(r)[1:] for r in none] == [(None, None)] * 3
    assert spatial.nearest_line(frame.where("false"), lines).count() == 0


def test_stations_by_code_or_name(spark):
    stations = spark.createDataFrame([("a", "X1", "park", 2), ("b", None, "park lane", 1), ("c", " ", "", 0), ("d", "X1", None, 9)], "station string, code string, name string, position int")
    rows = spark.createDataFrame([(1, "x1 ", "lane"), (2, None, "old park"), (3, "", "park lane"), (4, "Z", None), (5, None, " "), (6, None, "zoo"), (6, None, "zoo")], "id int, code string, name string")
    got = sorted(tuple(r) for r in transit.code_or_name(rows, stations).collect())
    want = [(1, "a", "code"), (2, "a", "name"), (3, "b", "name"), (4, None, None), (5, None, None), (6, None, None), (6, None, None)]
    assert got == want
    assert transit.code_or_name(rows.where("false"), stations).count() == 0
    assert {r.station for r in transit.code_or_name(rows, stations.where("false")).collect()} == {None}
    assert transit.code_or_name(rows.where("id < 4"), stations, strict=True).count() == 3
    with pytest.raises(Exception, match="no station for zoo"):
        transit.code_or_name(rows.where("id = 6"), stations, strict=True).collect()


def test_forms_of_odd_cells(spark):
    one = lambda **c: spark.range(1).select(*[e.alias(n) for n, e in c.items()]).first().asDict()
    null, text = F.lit(None).cast("string"), F.lit
    years = one(
        a=forms.year_of_file_name(null), b=forms.year_of_link(text("31_03_21")), c=forms.year_of_estimate(null), d=forms.year_written_out(text("202023")), e=forms.earliest_year(null),
        f=forms.earliest_year(text("2019-21-22 then 2011/2012")), g=forms.year_of_link(text("19-21")), h=forms.earliest_year(text("2016-123, 15_16")),
    )
    assert years == {"a": None, "b": "2020-21", "c": "", "d": None, "e": None, "f": "2021-22", "g": None, "h": "2015-16"}
    names = one(a=forms.key_without(text("ﬁrst Čapek Rd")), b=forms.key_without(null), c=forms.key_expanded(text("A&B jcn")), d=forms.numbered_name(null), e=forms.first_class(null, {"x": "x"}, "other"))
    assert names == {"a": "first capek", "b": None, "c": "a and b junction", "d": ("", ""), "e": "other"}
    checks = one(
        a=forms.is_day(null), b=forms.is_day(text("20240229")), c=forms.is_day(text("20230229")), d=forms.is_clock(text("25:00:59")), e=forms.is_clock(text("1:60:00")), f=forms.is_whole(text("2.0"), 0), g=forms.is_whole(text("7"), 1),
        h=forms.is_number(text("nan"), -1, 1), i=forms.are_points(F.lit(None).cast("array<array<double>>")), j=forms.are_points(F.array(F.array(F.lit(181.0), F.lit(0.0)))),
    )
    assert [k for k, ok in checks.items() if ok] == ["b", "d", "g"]
    colours = one(a=forms.colour(F.lit(None)), b=forms.colour(F.lit(float("nan"))), c=forms.colour(F.lit(31.5)), d=forms.colour(F.lit(99)))
    assert [tuple(c) for c in colours.values()] == [(0, 80, 30, 0), (0, 80, 30, 0), (60, 130, 35, 220), (90, 0, 25, 220)]


def test_years_in_their_forms(spark):
    """By form: the text, then what each reader makes of it."""
    rows = {
        "plan 2014-15 b": ("2014-15", "2014-15", "2014-15", "2014-15", "2014-15"),
        "x_2014_2015": ("2014-20", "2014-20", "", "2014-15", "2014-15"),
        "note 12-13": ("2012-13", "2012-13", "", None, "2012-13"),
        "note12-13": (None, None, "", None, "2012-13"),
        "03-04 and 08-09": ("2003-04", "2008-09", "", None, None),
        "at 31 - 03 - 2019": (None, "2018-19", "", None, None),
        "RBE 2017-18, BE_18-19": ("2017-18", "2017-18", "2018-19", "2017-18", "2017-18"),
        "v201617 a": (None, None, "", "2016-17", None),
        "v201618": (None, None, "", None, None),
        "no 5, 123-456": (None, None, "", None, None),
        "": (None, None, "", None, None),
    }
    table = spark.createDataFrame([(t,) for t in rows], "t string")
    readers_ = [forms.year_of_file_name, forms.year_of_link, forms.year_of_estimate, forms.year_written_out, forms.earliest_year]
    for r in table.select("t", *[f(F.col("t")).alias(f"y{i}") for i, f in enumerate(readers_)]).collect():
        assert tuple(r)[1:] == rows[r.t], r.t
    assert one(spark, forms.year_of_estimate(F.lit(None).cast("string"))) == "" and one(spark, forms.year_of_link(F.lit(None).cast("string"))) is None


def test_numbered_names(spark):
    names = {"007 New Town Ward": ("7", "newtown"), "12 ward": ("12", "ward"), "000  A-b": ("0", "ab"), "Old Ward": ("", "oldward"), "12": ("", ""), None: ("", "")}
    for name, want in names.items():
        assert tuple(one(spark, forms.numbered_name(F.lit(name).cast("string")))) == want


@pytest.mark.parametrize("distance", [spatial.planar, spatial.spherical])
def test_nearest_of_many_targets(spark, distance):
    """Two levels of cells, crowds at one place, ties, and points far from all targets or without a coordinate."""
    rnd = np.random.default_rng(3)
    xy = np.round(np.concatenate([rnd.normal((77, 28), 0.05, (1800, 2)), rnd.uniform((70, 20), (80, 30), (600, 2)), np.tile([[77.0, 28.0]], (150, 1))]), 4)
    targets = spark.createDataFrame([(i, float(x), float(y), float(i % 7)) for i, (x, y) in enumerate(xy)], "target_id long, x double, y double, value double")
    asked = [(0, 77.0, 28.0), (1, -120.0, -60.0), (2, 179.0, 85.0), (3, 75.0, 25.0), (4, None, 25.0), *[(10 + i, float(x), float(y)) for i, (x, y) in enumerate(rnd.uniform((69, 19), (81, 31), (60, 2)))]]
    points = spark.createDataFrame(asked, "point_id long, x double, y double")

    def away(x, y):
        if distance is spatial.planar:
            return np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        p, q = np.radians(y), np.radians(xy[:, 1])
        a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(xy[:, 0] - x) / 2) ** 2
        return 2 * 6_371_000 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))

    for k in (1, 6, 200):
        found = {r.point_id: r.near for r in spatial.nearest(points, targets, k, distance, round_to=3).collect()}
        assert found[4] is None and len(found) == len(asked)
        for i, x, y in asked:
            if x is not None:
                d = np.round(away(x, y), 3)
                want = sorted(zip(d.tolist(), range(len(d)), strict=True))[:k]
                assert [round(t.d, 3) for t in found[i]] == pytest.approx([w[0] for w in want], abs=2e-3)
                if distance is spatial.planar:
                    assert [t.target_id for t in found[i]] == [w[1] for w in want]


def test_points_of_one_tile_and_large_polygons(spark, monkeypatch):
    """All points in one place, and polygons of very different sizes; with and without a broadcast."""
    points = spark.range(500).select(F.col("id").alias("point_id"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    polys = square(spark, [(f"p{i}", i, -float(i), -float(i), 1.0 + i, 1.0 + i) for i in range(40)] + [("off", 99, 900.0, 900.0, 901.0, 901.0)])
    want = {f"p{i}": 500 for i in range(40)} | {"off": 0}
    for limit in (spatial.BROADCAST_BYTES, 0):
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", limit)
        assert {r.poly_id: r.n for r in spatial.count_per_polygon(points, polys).collect()} == want
    assert spatial.count_per_polygon(points, polys.limit(0)).count() == 0


def test_running_totals(spark):
    """Copies of one value, nulls, negative amounts, dates and texts, in one range or many."""
    rnd = np.random.default_rng(1)
    rows = [(int(i), int(v), None if a == 0 else int(a)) for i, (v, a) in enumerate(zip(np.where(rnd.random(3000) < 0.4, 7, rnd.integers(0, 500, 3000)), rnd.integers(-3, 9, 3000), strict=True))]
    table = spark.createDataFrame(rows, "id long, v long, a long")
    total, want = 0, {}
    for i, _, a in sorted(rows, key=lambda r: (r[1], r[0])):
        total += a or 0
        want[i] = total
    for partitions in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {r.id: r.s for r in stats.running_total(table, "v", "a", "s", ["id"]).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    texts = stats.running_total(table.select(F.concat(F.lit("t"), F.lpad("v", 4, "0")).alias("v"), "id"), "v", F.lit(0.5), "s", ["id"])
    assert texts.agg(F.max("s")).first()[0] == 1500.0 and texts.schema["s"].dataType.simpleString() == "double"
    assert stats.running_total(table.limit(0), "v", "a", "s").count() == 0


def test_sizes_beyond_the_largest_unit(spark):
    sizes = lambda *a: [one(spark, coerce.human_bytes(F.lit(n).cast("long"), *a)) for n in (0, 1023, 3 << 19, 3 << 29, 3 << 39, 3 << 49, 3 << 59, None)]
    assert sizes("MB") == ["0B", "1023B", "1.5MB", "1536.0MB", "1572864.0MB", "1610612736.0MB", "1649267441664.0MB", None]
    assert sizes() == ["0B", "1023B", "1.5MB", "1.5GB", "1.5TB", "1.5PB", "1536.0PB", None]

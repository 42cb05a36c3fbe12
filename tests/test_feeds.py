"""Each feed builder against the gates, and written as an archive."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import feeds, transit
from wardlight.sources import archives, writers

STOPS = [("a", "Old Town", 77.0, 28.0), ("b", "b", 77.1, 28.0), ("c", "C. Road", 77.2, 28.0), ("d", None, None, 28.0)]
STOP = feeds.STOP


def stops(spark):
    return spark.createDataFrame(STOPS, "stop_id string, stop_name string, x double, y double")


def built(spark):
    of = {s[0]: s for s in STOPS}
    ends = spark.createDataFrame([("r1", "R", of["a"], of["b"]), ("same", "R", of["a"], of["a"]), ("lost", "R", of["a"], of["d"])], f"route_id string, route_name string, origin {STOP}, destination {STOP}")
    yield "ends", feeds.from_ends(ends, pace=10.0, detour=1.0), {"r1_0": "ab", "r1_1": "ba"}
    relations = spark.createDataFrame([("r1", "R", [("a", "stop"), ("x", ""), ("a", "platform"), ("b", "stop_exit_only"), ("zz", "stop")]), ("r2", "S", [("c", "stop")]), ("r3", None, None)], "route_id string, route_name string, members array<struct<ref:string,role:string>>")
    yield "relations", feeds.from_relations(relations, stops(spark).withColumnsRenamed({"stop_id": "ref", "stop_name": "name"})), {"r1_0": "ab", "r1_1": "ba"}
    lists = spark.createDataFrame([("r1", "R", ["old  town", "OLD-TOWN", None, "?", "c road", "b"]), ("r2", "S", ["b", "nowhere"])], "route_id string, route_name string, names array<string>")
    yield "lists", feeds.from_stop_lists(lists, stops(spark)), {"r1_0": "acb", "r1_1": "bca"}
    seen = spark.createDataFrame([("t1", "r1", "R", "b", 90000), ("t1", "r1", "R", "a", 60), ("t1", "r1", "R", "a", 65), ("t1", "r1", "R", "d", 70), ("t1", "r1", "R", "c", None), ("t2", "r2", "R", "a", 5)], "trip_id string, route_id string, route_name string, stop_id string, second int")
    yield "sightings", feeds.from_sightings(seen, stops(spark)), {"t1": "ab"}
    stations = stops(spark).select(F.lit("m").alias("line_id"), F.lit("Metro").alias("line_name"), F.col("stop_id").alias("position"), "stop_id", "stop_name", "x", "y")
    service = spark.createDataFrame([("m", 21600, 21700, 60), ("none", 0, 1, 1)], "line_id string, first long, last long, headway long")
    yield "lines", feeds.from_lines(stations, service), {f"m_{d}_{s}": p for d, p in (("0", "abc"), ("1", "cba")) for s in (21600, 21660)}
    once = spark.createDataFrame([("m", 30000, 0, 0)], "line_id string, first long, last long, headway long")
    yield "one departure", feeds.from_lines(stations, once), {"m_0_30000": "abc", "m_1_30000": "cba"}


def test_builders(spark, tmp_path):
    for name, feed, want in built(spark):
        faults = {r.gate: r.bad for r in transit.feed_gates(feed, required=tuple(writers.REQUIRED)).collect()}
        assert not any(faults.values()), (name, faults)
        found = {}
        for r in feed["stop_times"].orderBy("trip_id", "stop_sequence").collect():
            found.setdefault(r.trip_id, []).append(r.stop_id)
        assert {k: "".join(x) for k, x in found.items()} == want, name
    path = str(tmp_path / "ends.zip")
    writers.feed(next(iter(built(spark)))[1], path)
    assert archives.zip_table(spark, path, "stop_times").count() == 4


def test_ride_times(spark):
    line = F.array(*[F.struct(F.lit(i).alias("stop_id"), F.lit(i).alias("stop_name"), F.lit(x).alias("x"), F.lit(0.0).alias("y")) for i, x in (("a", 0.0), ("b", 0.01), ("c", 0.03))])
    step = 6_371_000 * 3.141592653589793 / 180 * 0.01
    times = spark.range(1).select(feeds.ride_times(line, 10.0, 30.0, 2.0).alias("t")).first().t
    assert times == pytest.approx([0.0, step / 5, step / 5 + 30 + 2 * step / 5], rel=1e-9)
    assert [r.c for r in spark.createDataFrame([(0.4,), (90000.0,), (3599.6,)], "s double").select(feeds.clock(F.col("s")).alias("c")).collect()] == ["00:00:00", "25:00:00", "01:00:00"]


def test_sightings_stay_narrow(spark):
    seen = spark.createDataFrame([("t", "r", "R", 1, 10), ("t", "r", "R", 1, 20), ("t", "r", "R", 2, 30), ("t", "r", "R", 9, 40), ("u", "r", "R", 2, 5), ("t", "r", "R", 1, None)], "trip_id string, route_id string, route_name string, stop_id int, second int")
    stops = spark.createDataFrame([(1, "b", 1.0, 2.0), (1, "a", 1.0, 2.0), (2, "c", 3.0, 4.0), (3, "unseen", 0.0, 0.0), (9, "nowhere", None, 1.0)], "stop_id int, stop_name string, x double, y double")
    feed = feeds.from_sightings(seen, stops)
    rows = lambda name, *c: sorted(tuple(r) for r in feed[name].select(*c).collect())
    assert rows("stop_times", "trip_id", "stop_sequence", "stop_id", "arrival_time") == [("t", 0, "1", "00:00:10"), ("t", 1, "2", "00:00:30")]
    assert rows("stops", "stop_id", "stop_name", "stop_lat", "stop_lon") == [("1", "a", 2.0, 1.0), ("2", "c", 4.0, 3.0)] and rows("trips", "trip_id", "route_id", "direction_id") == [("t", "r", 0)]
    plan = feed["stop_times"]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "stop_name" not in plan.split("Window", 1)[1].split("Join", 1)[0]

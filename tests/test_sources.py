"""Archives, drifting headers, encodings and writers, as round trips."""

import gzip
import json
import lzma
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from wardlight.operators import transit
from wardlight.sources import archives, readers, writers


@pytest.fixture
def zips(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("old/stops.txt", "stop_id,stop_name\nx,gone\n")
        z.writestr("in/feed/", "")
        z.writestr("in/feed/stops.txt", '﻿stop_id, stop_name,\n1,"A, ""b"""\n\n2\n3,c,d,e\n'.encode())
        z.writestr("routes.txt", "route_id\nr1\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("stops.txt", b"zone,stop_id\nz\xff,9\n")
    (tmp_path / "readme.md").write_text("no archive")
    return str(tmp_path)


def test_members_of_zips(spark, zips):
    stops = archives.zip_table(spark, f"{zips}/*.zip", "stops")
    assert stops.columns == ["stop_id", "zone", "stop_name"]
    assert sorted(map(tuple, stops.collect()), key=str) == sorted([("1", None, 'A, "b"'), ("2", None, ""), ("3", None, "c"), ("9", "z�", None)], key=str)
    assert [(r.line, r.cells["stop_id"]) for r in archives.zip_rows(spark, f"{zips}/a.zip", "stops.txt").orderBy("line").collect()] == [(0, "1"), (1, "2"), (2, "3")]
    assert archives.zip_table(spark, f"{zips}/*.zip", "shapes") is None
    with pytest.raises(FileNotFoundError, match=r"shapes\.txt"):
        archives.zip_table(spark, f"{zips}/*.zip", "shapes", required=True)
    assert archives.zip_table(spark, f"{zips}/b.zip", "routes") is None


def test_large_members_come_in_batches(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "l.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("t.txt", "k,v\n" + "".join(f"{i},{i * i}\n" for i in range(12_345)))
    t = archives.zip_table(spark, str(tmp_path / "l.zip"), "t")
    assert t.count() == 12_345 and t.where("cast(v as long) <> cast(k as long) * cast(k as long)").count() == 0


def test_xz_features(spark, tmp_path):
    lines = ["[", ' {"type":"Feature","properties":{"a":1},"geometry":{"type":"Point","coordinates":[1,2]}},', '{"type": "Feature","properties":{},"geometry":{"type":"LineString","coordinates":[]}}', "{}", "]"]
    with lzma.open(tmp_path / "f.xz", "wt") as f:
        f.write("\n".join(lines))
    (tmp_path / "f.json").write_text("\n".join(lines))
    for name in ("f.xz", "f.json"):
        assert sorted(r.type for r in readers.feature_lines(spark, str(tmp_path / name)).collect()) == ["LineString", "Point"]


def test_checksums_join():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randint(0, 300)), rnd.randbytes(rnd.choice([0, 1, 7, 5000]))
        assert archives.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def feed(spark, **other):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "agency": t([("a", 'The "A", Ltd', None)], "agency_id string, agency_name string, extra string"), "calendar": t([("s", 1)], "service_id string, monday int"),
        "routes": t([("r2", "a", "line\nend"), ("r1", "a", None)], "route_id string, agency_id string, route_long_name string"), "trips": t([("t1", "r1", "s")], "trip_id string, route_id string, service_id string"),
        "stop_times": t([("t1", 2, "y"), ("t1", 1, "x")], "trip_id string, stop_sequence int, stop_id string"), "stops": t([("x", "é"), ("y", "Y")], "stop_id string, stop_name string"),
    }
    return {**tables, **other}


def test_feed_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "CHUNK", 16)  # tasks see the module's own value; either way the file must be whole
    path = str(tmp_path / "out" / "feed.zip")
    sizes = writers.feed(feed(spark, shapes=spark.range(20000).select(F.col("id").cast("string").alias("shape_id"), F.lit("x" * 100).alias("note"))), path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert z.namelist() == ["agency.txt", "calendar.txt", "routes.txt", "trips.txt", "stop_times.txt", "stops.txt", "shapes.txt"]
        assert {n: z.getinfo(n).file_size for n in z.namelist()} == sizes and sizes["shapes.txt"] > 2_000_000
        assert z.read("routes.txt").decode() == 'route_id,agency_id,route_long_name\nr1,a,\nr2,a,"line\nend"\n'
        assert z.read("agency.txt").decode() == 'agency_id,agency_name,extra\na,"The ""A"", Ltd",\n'
        assert z.read("stop_times.txt").decode() == "trip_id,stop_id,stop_sequence\nt1,x,1\nt1,y,2\n"
    assert archives.zip_table(spark, path, "stops").orderBy("stop_id").collect()[0].stop_name == "é"
    writers.feed(feed(spark), path)  # again, over the first
    assert archives.zip_table(spark, path, "shapes") is None and [f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")] == ["feed.zip"]


@pytest.mark.parametrize("gate", ["has_agency", "has_calendar", "has_stops", "short_trips", "trips_without_service", "routes_without_agency", "stop_times_without_stop"])
def test_a_failing_gate_leaves_nothing(spark, tmp_path, gate):
    tables = feed(spark)
    broken = {
        "has_agency": {k: v for k, v in tables.items() if k != "agency"}, "has_calendar": {**tables, "calendar": tables["calendar"].limit(0)}, "has_stops": {**tables, "stops": tables["stops"].limit(0)},
        "short_trips": {**tables, "stop_times": tables["stop_times"].limit(1)}, "trips_without_service": {**tables, "calendar": spark.createDataFrame([("other",)], "service_id string")},
        "routes_without_agency": {**tables, "agency": spark.createDataFrame([("other",)], "agency_id string")}, "stop_times_without_stop": {**tables, "stops": tables["stops"].where("stop_id = 'x'")},
    }[gate]
    with pytest.raises(ValueError, match=gate):
        writers.feed(broken, str(tmp_path / "feed.zip"))
    assert not list(tmp_path.iterdir())
    assert {r.gate: r.bad for r in transit.feed_gates(tables, required=tuple(writers.REQUIRED)).collect()} == dict.fromkeys([f"has_{t}" for t in writers.REQUIRED] + ["short_trips", "stop_times_without_stop", "stop_times_without_trip", "trips_without_route", "trips_without_service", "routes_without_agency"], 0)


def test_an_error_while_writing_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken row")).cast("string")).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="broken row"):
        archives.write_text(spark, bad, str(tmp_path / "t.json"))
    assert not [f for f in tmp_path.iterdir()]


def test_feature_collection(spark, tmp_path):
    table = spark.createDataFrame([(2, "b", '{"type":"Point","coordinates":[1,2]}'), (1, None, None)], "n int, name string, g string")
    writers.feature_collection(table, str(tmp_path / "f.geojson"), "g", ["n"])
    assert json.loads((tmp_path / "f.geojson").read_text()) == {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": 1, "name": None}, "geometry": None}, {"type": "Feature", "properties": {"n": 2, "name": "b"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]}
    writers.feature_collection(table.limit(0), str(tmp_path / "e.geojson"), "g", ["n"])
    assert json.loads((tmp_path / "e.geojson").read_text())["features"] == []


def test_drifting_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,PM2.5 (ug/m3),other\n1,10,x\n2,20,y\n")
    (tmp_path / "b.csv").write_bytes("﻿id,PM2.5 raw,PM2.5,Timestamp\nq,0,30,3\n".encode())
    (tmp_path / "c.csv").write_text("Timestamp,PM10\n9,9\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("Timestamp,PM2.5 (ug/m3),other\n4,40,z\n")
    table = readers.drifting_csv(spark, str(tmp_path / "*.csv"), {"Timestamp": "Timestamp", "PM2.5": "PM2.5"})
    assert sorted(map(tuple, table.collect())) == [("1", "10", "a.csv"), ("2", "20", "a.csv"), ("3", "30", "b.csv"), ("4", "40", "e.csv")]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "ReadSchema: struct<c0:string,c1:string>" in plan and "ReadSchema: struct<c2:string,c3:string>" in plan
    assert readers.drifting_csv(spark, str(tmp_path / "*.csv"), {"x": "none"}).columns == ["x", "_file"]
    assert readers.drifting_csv(spark, str(tmp_path / "no*.csv"), {"x": "none"}).count() == 0


def test_encodings(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("name,n\ncafé – x,1\n".encode("cp1252"))
    (tmp_path / "u.csv").write_bytes("﻿name,n\nok,1\n".encode() + b"bad\xff,2\n")
    assert readers.csv_text(spark, str(tmp_path / "w.csv"), "windows-1252").first().name == "café – x"
    assert [r.name for r in readers.csv_text(spark, str(tmp_path / "u.csv")).orderBy("n").collect()] == ["ok", "bad�"]


def test_keys_and_manifests(spark, tmp_path):
    table = spark.createDataFrame([("Orders_for_North_No-7_x.csv",), ("other",)], "_file string")
    assert [r.k for r in table.select(readers.key_from_file(r"_for_(\w+?)_No-(\d+)", 2).alias("k")).collect()] == ["7", None]
    for city, text in {"pune": '{"feeds": [{"id": "f1"}, {"id": "f2"}]}', "agra": "{}", "bad": "no json"}.items():
        folder = tmp_path / city / "source"
        folder.mkdir(parents=True)
        (folder / "m.json").write_text(text)
    found = {r.city: r.m for r in readers.manifests(spark, str(tmp_path), "source/m.json", "feeds array<struct<id:string>>").collect()}
    assert [f.id for f in found["pune"].feeds] == ["f1", "f2"] and found["agra"].feeds is None and found["bad"] in (None, (None,))
    (tmp_path / "rows.json").write_text('{"features": [{"a": {"type": "T", "value": 5}, "b": "x"}, {"b": null}]}')
    assert [tuple(r) for r in readers.json_rows(spark, str(tmp_path / "rows.json"), ["a", "b"]).collect()] == [("5", "x"), (None, None)]


def test_tables_and_logs(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", None), (2, "b,c", 0.5)], "id int, name string, v double")
    writers.csv(table.coalesce(1), str(tmp_path / "c"), ["name", "id"], compress=True)
    part = next((tmp_path / "c").glob("*.csv.gz"))
    assert gzip.open(part, "rt").read() == 'name,id\na,1\n"b,c",2\n'
    writers.fan_out(table, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f/parquet")).count() == spark.read.csv(str(tmp_path / "f/csv"), header=True).count() == spark.read.json(str(tmp_path / "f/json")).count() == 2
    log = spark.createDataFrame([("2024-01-01", "all", 3)], "started string, scope string, n int")
    writers.run_log(log, str(tmp_path / "log"))
    writers.run_log(log.withColumn("n", F.lit(4)), str(tmp_path / "log"))
    rows = spark.read.json(str(tmp_path / "log")).orderBy("n").collect()
    import hashlib

    assert [r.id for r in rows] == [hashlib.sha256(f"2024-01-01:all:{n}".encode()).hexdigest()[:16] for n in (3, 4)]

"""City tables on rows with nulls, blanks, ties and repeats."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import cities, documents


def test_first_filled(spark):
    t = spark.createDataFrame([(" ", "b "), (None, None), ("nan", "1e3"), ("200", "-80.5")], "a string, b string")
    rows = t.select(cities.first_text(F.col("a"), F.col("b")).alias("t"), cities.first_number(F.col("a"), F.col("b"), low=-180, high=180).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [("b", None), (None, None), ("nan", None), ("200", -80.5)]


def test_named_wards(spark):
    wards = spark.createDataFrame([("007", None, "East", None), (" ", "8A", " ", "Own"), (None, None, None, None)], "no string, alt string, zone string, Name string")
    roster = spark.createDataFrame([("7", "B", "X", "1"), ("07", "A", None, None), ("8-a", "C", "Y", "2"), ("7", " ", "Z", "3"), ("", "nobody", "Z", "4")], "number string, name string, party string, phone string")
    got = {r.number: r for r in cities.named_wards(wards, roster, ["no", "alt"], ["zone"]).collect()}
    assert (got["007"].Name, got["007"].councillor_count, got["007"].councillors, got["007"].parties) == ("Ward 007 · East", 2, "A; B", "; X")
    assert (got["8A"].Name, got["8A"].councillors, got["8A"].phones) == ("Own", "C", "2") and (got[""].Name, got[""].councillor_count, got[""].councillors) == ("Ward ", 0, None)
    assert cities.named_wards(wards.drop("Name"), roster.limit(0), ["no", "alt"], ["zone"]).count() == 3


def test_audits(spark):
    metrics = spark.createDataFrame([("visits", "Visits"), ("loans", "Loans")], "metric string, label string")
    systems = spark.createDataFrame([("a",), ("b",), ("a",)], "system string")
    values = spark.createDataFrame([("a", "visits", 2020, "5"), ("a", "visits", 2021, " "), ("a", "loans", 2019, "7 "), ("c", "loans", 2019, "7")], "system string, metric string, year int, value string")
    partial = spark.createDataFrame([("a", "loans"), ("b", "loans")], "system string, metric string")
    got = {(r.system, r.metric): (r.status, r.value, r.year, r.priority) for r in cities.disclosure_audit(metrics, systems, values, partial).collect()}
    assert got == {("a", "visits"): ("available", "5", 2020, ""), ("a", "loans"): ("partial", "7", 2019, "clarify"), ("b", "visits"): ("missing", "", None, "request"), ("b", "loans"): ("missing", "", None, "request")}
    places = spark.createDataFrame([("s", "9-5", None), ("s", " ", None), ("t", "x", "y")], "system string, hours string, seats string")
    assert {(r.system, r.field): (r.filled, r.total, r.status) for r in cities.detail_audit(places, "system", ["hours", "seats"]).collect()} == {("s", "hours"): (1, 2, "partial"), ("s", "seats"): (0, 2, "missing"), ("t", "hours"): (1, 1, "complete"), ("t", "seats"): (1, 1, "complete")}


def test_headlines(spark):
    own = spark.createDataFrame([(2020, 1.0, None), (2021, None, None)], "year int, a double, b double")
    lines = spark.createDataFrame([(2020, "A", "actual", 9.0), (2020, "B", "BE", 5.0), (2020, "B", "BE", 7.0), (2020, "B", "odd", 99.0), (2022, "A", "RE", 3.0), (2022, "A", "actual", None), (2021, "C", "BE", 4.0)], "year int, head string, basis string, amount double")
    got = {r.year: (r.a, r.b, r.filled) for r in cities.filled_headlines(own, lines, {"a": "A", "b": "B"}, {"actual": 0, "RE": 1, "BE": 2}).collect()}
    assert got == {2020: (1.0, 7.0, ["b"]), 2021: (None, None, []), 2022: (3.0, None, ["a"])}


def test_samples_stations_and_queues(spark):
    stops = spark.createDataFrame([("", "s1", "One", "x", "77"), (None, "s1", "Again", "1", "78"), ("s2", None, None, "1", "999"), (None, None, "no id", "1", "2")], "a string, b string, n string, lat string, lon string")
    routes = spark.createDataFrame([("r1", None, [["77", "28"], ["x", "1"], ["78", "28", "5"]]), ("r2", "R", [["1", "1"]]), ("r3", "R", None), (" ", "R", [["1", "1"], ["2", "2"]])], "id string, n string, path array<array<string>>")
    points, lines = cities.sample_layers(stops, routes, ["a", "b"], ["n"], ["lon"], ["lat"], ["id"], ["n"], "path")
    assert [tuple(r) for r in points.collect()] == [("s1", "Again", 78.0, 1.0)]
    assert [(r.id, r.name, len(r.line)) for r in lines.collect()] == [("r1", "r1", 2)]
    rows = [(" a1", "A", "red", "x", 2), ("A1", "B", "blue", "y", 1), ("a1", "C", "red", "x", 3), ("a1", "D", "red", " ", 0), ("", "E", "red", "z", 0), ("b", None, None, None, 5)]
    got = {r.code: (r.name, r.line, r.connections) for r in cities.station_inventory(spark.createDataFrame(rows, "code string, name string, line string, connection string, order int")).collect()}
    assert got == {"A1": ("D", "red", ["y", "x"]), "B": (None, None, [])}
    path = cities.line_by_distance(spark.createDataFrame([("l", 3.0, 0.0, 30.0), ("l", 1.0, 0.0, 10.0), ("l", 1.0, 0.0, 40.0), ("l", 2.0, 0.0, None)], "line string, x double, y double, metres double"), "line").first().path
    assert [p.x for p in path] == [1.0, 3.0]
    places = spark.createDataFrame([("k1", " 1, Road,  North ", None, 1.0), ("k2", "1 Road North", None, None), ("k3", "2 Road", None, None), ("k4", "3 Road", 1.0, 2.0), ("k5", " , ", None, None), ("k6", None, None, None)], "key string, address string, lat double, lon double")
    queue = cities.geocode_queue(places, spark.createDataFrame([("k3",)], "key string"), "key", "address").collect()
    assert ("k1", "1 Road North", 2) in [tuple(r) for r in queue] and all(r["query"] in ("1 Road North", "") for r in queue)


def test_partial_layers(spark):
    wards = spark.createDataFrame([(i, float(10 * i), 1.0) for i in range(1, 7)] + [(7, 1e9, 1.0), (8, None, 1.0), (9, 5.0, 0.0)], "ward int, people double, km double")
    heat = spark.createDataFrame([(i, 30.0 + i) for i in range(1, 8)], "ward int, heat double")
    got = {r.ward: r for r in cities.partial_layer(wards, heat, F.col("km"), "people").collect()}
    assert got[7].suspect and not got[7].vulnerable and got[8].density is None and got[9].density is None and not got[8].vulnerable
    assert [i for i in range(1, 7) if got[i].vulnerable] == [5, 6]


@pytest.mark.parametrize("base, href, want", [("https://a.b/c/d.html?x=/y#z", "e.pdf", "https://a.b/c/e.pdf"), ("https://a.b", "/e.pdf", "https://a.b/e.pdf"), ("https://a.b/c/", "//o.p/e.pdf", "https://o.p/e.pdf"), ("https://a.b/c", "http://x.y/e.pdf", "http://x.y/e.pdf")])
def test_finance_links(spark, base, href, want):
    html = f'<a href="{href}">Budget 2020-21</a><a href="{href}">budget 2020-21 again</a><a href="n.pdf">Budget</a><a>budget 2020-21</a><a href="m.pdf">Notice 2020-21</a><A HREF="viewFile?id=budget_2019-20"> </A>'
    found = documents.finance_links(spark.createDataFrame([(1, html, base), (2, None, base)], "page_id int, html string, url string"), ["budget"], "book").collect()
    assert ("2020-21", "Budget 2020-21", want) in [(r.year, r.label, r.url) for r in found] and [r.label for r in found if r.year == "2019-20"] == ["book 2019-20"] and len(found) == 2

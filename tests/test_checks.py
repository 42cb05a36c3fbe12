"""Gates and budget readers on rows with nulls, blanks and ties."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import budget, gates


def faults(df):
    return sorted(((r.id, r.rule, r.detail) for r in df.collect()), key=str)


def test_evidence_faults(spark):
    facts = spark.createDataFrame(
        [("f1", "high", "found", "1", "IN", "text"), ("f2", None, "found", None, " ", "PdfText"), ("f2", "low", "not_found", "3", None, None), (None, "high", "not_found", None, "IN", "x")],
        "id string, confidence string, status string, value string, country string, extractor string",
    )
    claims = spark.createDataFrame([("c1", "t", ["f1", "f1"], "/r", "roads"), ("c2", None, [], "r", ""), ("c3", "t", ["f9", "f1", "f9"], None, "x")], "id string, text string, fact_ids array<string>, route string, function string")
    assert faults(gates.evidence_faults(facts, claims, ["high", "low"], ["found", "not_found"])) == sorted([
        ("f2", "confidence", None), ("f2", "value when found", "found"), ("f2", "country required", " "), ("f2", "extractor", "PdfText"), ("f2", "null when not found", "3"), ("f2", "country required", None), ("f2", "extractor", None),
        (None, "id required", None), ("f2", "duplicate id", "1"), ("c2", "text required", None), ("c2", "facts required", None), ("c2", "absolute route", "r"), ("c2", "function required", ""), ("c3", "absolute route", None), ("c3", "unknown fact", "f9"),
    ], key=str)
    assert gates.evidence_faults(facts.limit(0), claims.limit(0), ["high"], ["found"]).count() == 0


def test_sources_and_manifests(spark):
    entries = spark.createDataFrame([(0, "a", "k", "l", "http://x"), (1, "a", "k", "\t", None), (2, None, "k", "l", "javascript:x"), (3, "b", None, "l", "")], "position int, id string, kind string, label string, url string")
    assert faults(gates.source_faults(entries)) == sorted([("a", "label required", "\t"), ("a", "duplicate id", "1"), (None, "id required", None), (None, "web address", "javascript:x"), ("b", "kind required", None), ("b", "web address", "")], key=str)
    layers = spark.createDataFrame([("l1", "image", "a.png", "a.json"), ("l2", "image", "b.png", None), ("l3", "points", "gone", None), ("l3", "odd", None, "x")], "id string, kind string, file string, bounds_file string")
    files = spark.createDataFrame([("a.png",), ("b.png",)], "file string")
    assert faults(gates.manifest_faults(layers, files, ["image", "points"])) == sorted([("l1", "missing bounds", "a.json"), ("l2", "image bounds", None), ("l3", "missing file", "gone"), ("l3", "kind", "odd"), ("l3", "file required", None), ("l3", "duplicate id", "1")], key=str)


def test_preflight(spark):
    t = spark.createDataFrame
    times = t([("t1", "a"), ("t1", "b")], "trip_id string, stop_id string")
    good = {"routes": t([("r", 3)], "route_id string, route_type int"), "stop_times": times}
    fields, valid = {"routes": ["route_id", "route_type"], "stop_times": ["trip_id", "stop_id"]}, {"routes": {"route_type": F.col("route_type").between(0, 12)}}
    assert gates.preflight(good, fields, valid).count() == 0
    bad = {"routes": t([(" ", 99), (None, None)], "route_id string, route_type int"), "stop_times": t([("t1", "a"), ("t1", "a"), (None, "b"), ("t2", "")], "trip_id string, stop_id string"), "stops": times.limit(0)}
    got = sorted(((r.gate, r.input, r.field, r.n) for r in gates.preflight(bad, {**fields, "stops": ["stop_id", "name"], "agency": ["id"]}, valid).collect()), key=str)
    assert got == sorted([
        ("missing_input", "agency", None, 1), ("empty_input", "stops", None, 1), ("missing_field", "stops", "name", None), ("missing_field", "routes", "route_id", 2), ("missing_field", "routes", "route_type", 1), ("invalid_value", "routes", "route_type", 1),
        ("missing_field", "stop_times", "trip_id", 1), ("missing_field", "stop_times", "stop_id", 1), ("stop_sequence", "stop_times", None, 1),
    ], key=str)


def test_probes_and_readiness(spark):
    rows = [("g1", 200, '{"results": {"accessToken": "t"}}'), ("g1", 403, '{"detail": "No policy exist"}'), ("g2", 401, "{}"), (None, 500, None), ("g2", 200, '{"title": "APD evaluation failed"}')]
    found = gates.probe_status(spark.createDataFrame(rows, "group string, http_status int, payload string"))
    assert [r.status for r in found.collect()] == ["ok", "gated", "denied", "error", "gated"]
    groups = gates.probe_groups(found)
    assert {r.group: (r.resources, r.ok, r.gated, r.denied, r.error, r.blocked) for r in groups.collect()} == {"g1": (2, 1, 1, 0, 0, True), "g2": (2, 0, 1, 1, 0, True), "unknown": (1, 0, 0, 0, 1, False)}
    coverage = gates.field_coverage(spark.createDataFrame([("b1", "x"), ("b1", "y"), ("b1", "y"), ("b2", "x")], "resource string, field string"), spark.createDataFrame([("b1", "y"), ("b2", "x"), ("b2", "z"), ("b3", "q")], "resource string, field string"))
    assert {r.resource: (r.expected, r.present, r.missing, r.extra) for r in coverage.collect()} == {"b1": (2, 1, ["x"], []), "b2": (1, 1, [], ["z"]), "b3": (0, 0, [], ["q"])}
    builds = spark.createDataFrame([("b1", ["g1", "g9"]), ("b2", ["unknown"]), ("b4", None)], "build string, groups array<string>")
    feeds = spark.createDataFrame([("f", "open")], "feed string, status string")
    ready = {r.build: r for r in gates.readiness(builds, groups, coverage, feeds).collect()}
    assert (ready["b1"].gates, ready["b2"].gates, ready["b4"].gates) == (["policy_access", "missing_fields"], [], ["missing_fields"]) and ready["b2"].next_action == "request_policy"
    open_ = gates.readiness(builds, groups.where("not blocked"), coverage, feeds)
    assert {r.next_action for r in open_.collect()} == {"build_layers"}


def test_loaders(spark):
    verified = spark.createDataFrame(
        [("2020-21", "bus", "Actual spend", 1.23456, "r", "p", None, 0), ("2020-21", "bus", "Revised", 2.0, None, None, "low", 1), ("2020-21", "odd", None, None, None, None, None, 2)],
        "fiscal_year string, line string, account_head string, amount double, raw string, source string, confidence string, position int",
    )
    line_map = spark.createDataFrame([("bus", "BUS", "support", "Bus loan", "capital", "expenditure")], "line string, entity string, category string, head string, section string, flow string")
    one = [(r.basis, r.head, r.entity, r.category, r.amount, r.confidence) for r in budget.verified_lines(verified, line_map).orderBy("position").collect()]
    assert one == [("actual", "Bus loan", "BUS", "support", 1.2346, "high"), ("RE", "Bus loan", "BUS", "support", 2.0, "low"), ("BE", "odd", None, "other_expenditure", None, "high")]
    docs = spark.createDataFrame([('{"year": "2021-22", "source": "s", "in": {"fare_box": 5, "note": "x", "none": null, "e": 1e2}, "total": 7, "debt": "n/a"}', 0), ("{}", 1), (None, 2), ("broken", 3)], "json string, position int")
    two = budget.json_components(docs, "BUS", {"in": ("Income ", "non_tax", "income"), "out": ("Out ", "x", "y")}, {"total": ("Total", "non_tax", "income", "revenue"), "debt": ("Debt", "loan", "expenditure", "capital")})
    assert sorted((r.head, r.amount, r.fiscal_year) for r in two.collect()) == [("Income e", 100.0, "2021-22"), ("Income fare box", 5.0, "2021-22"), ("Total", 7.0, "2021-22")]
    wide = spark.createDataFrame([("2020-21", "3.5", " ", None, 0), ("2021-22", "", "9", "high", 1)], "fiscal_year string, a string, b string, confidence string, position int")
    three = budget.wide_lines(wide, {"a": ("Bus loan", "BUS", "support", "expenditure", "capital"), "b": ("Total", None, "total", None, "revenue")})
    assert sorted((r.fiscal_year, r.head, r.amount, r.confidence) for r in three.collect()) == [("2020-21", "Bus loan", 3.5, "medium"), ("2021-22", "Total", 9.0, "high")]
    told = spark.createDataFrame([("2020-21", "A grant to  Old \t Library, of Rs. 1,234.5 crore. Grant to X is Rs 200000 crores", "p", 0), ("2020-21", None, "p", 1)], "fiscal_year string, text string, source string, position int")
    four = budget.told_grants(told)
    assert [(r.head, r.amount) for r in four.collect()] == [("Grant to Old Library", 1234.5)]
    every = budget.first_loader_wins(three, two, budget.verified_lines(verified.withColumn("account_head", F.lit(None).cast("string")), line_map), four, four)
    kept = {(r.fiscal_year, r.entity, r.head): r.loader for r in every.collect()}
    assert kept["2020-21", "BUS", "Bus loan"] == 1 and kept["2020-21", "", "Grant to Old Library"] == 4 and kept["2020-21", "", "odd"] == 1 and len(kept) == 7


def test_labelled_lines(spark):
    lines = spark.createDataFrame([("d", 0, "Total income"), ("d", 1, "  Total income 0 and 5 or 6.5"), ("d", 2, "total income 9"), ("d", 3, None), ("e", 0, "x 4")], "doc string, line_no int, text string")
    found = budget.labelled_candidates(lines, {"income": "(?i)total income", "x": "^x"}, ["doc"])
    assert sorted(map(tuple, found.collect())) == [("d", "income", "5|6.5", "Total income 0 and 5 or 6.5"), ("e", "x", "4", "x 4")]
    labels = spark.createDataFrame([("inc", "Total income")], "label string, begins string")
    assert budget.rows_of_labels(lines.where("doc = 'd'"), labels, ["doc"], 3).first().figures == [0.0, 5.0, 6.5]
    with pytest.raises(Exception, match="no line for inc in e"):
        budget.rows_of_labels(lines, labels, ["doc"], 1).collect()


def test_cells_by_title(spark):
    rows = [(1, 0, 0, "Receipts  of States"), (1, 1, 0, "State"), (1, 1, 1, "2020-21"), (1, 1, 2, "2021-22 "), (1, 2, 0, "A"), (1, 2, 1, "1,200"), (1, 2, 2, "-"), (1, 3, 0, " "), (1, 3, 1, "5"), (2, 1, 0, "State"), (2, 1, 1, "2020-21"), (2, 2, 0, "B"), (2, 2, 1, "7")]
    cells = spark.createDataFrame([("d", *r) for r in rows], "doc string, table int, row int, column int, text string")
    found = budget.cells_by_title(cells, ["doc"], "receipts of states", 0, {"y20": "2020-21", "y21": "2021-22", "y22": "2022-23"}).collect()
    assert [tuple(r) for r in found] == [("d", 1, "A", 1200.0, None, None)]
    assert budget.cells_by_title(cells, ["doc"], "no title", 0, {"y20": "2020-21"}).count() == 0


def test_staffing(spark):
    texts = {
        "split": "Total  Posts Sanctioned: 10 Filled up : 7 Vacant Post : 3 of 1 2 3 4 5 6", "pair": "total posts sanctioned : 10 filledup Post : 10 VacantPost:0 a 4 b 6", "total": "Total Posts Sanctioned : 0 Filled up : 0 Vacant Post : 0",
        "told": "A sanctioned staff strength of 9 comprising of 4 professional and 5 non-professionals, out of which 2 post are lying vacant", "none": "staff", "null": None,
    }
    found = {r.id: r for r in budget.staffing(spark.createDataFrame(list(texts.items()), "id string, text string")).collect()}
    of = lambda k: tuple(found[k][c] for c in (*budget.STAFF, "vacancy_rate", "status"))
    none = (None,)
    assert of("split") == (10, 7, 3, 1, 2, 3, 4, 5, 6, 30.0, "observed_split") and of("pair") == (10, 10, 0, 4, 6, *none * 4, 0.0, "observed_total_only")
    assert of("total") == (0, 0, 0, *none * 7, "observed_total_only") and of("told") == (9, 7, 2, 4, 5, *none * 4, 22.2, "observed_total_only") and of("none") == of("null") == (*none * 10, "not_found")

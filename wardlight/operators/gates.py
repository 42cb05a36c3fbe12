"""Gates: rules that rows, tables and exports must keep, as rows (id, rule, detail) of those that don't."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null, or without a character but white space."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")) == "", F.lit(True))


def broken(df: DataFrame, id_col: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(id, rule, detail) of rows that break a rule, in one pass. rules: name to (holds, detail); an unknown answer breaks it."""
    each = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (holds, detail) in rules.items()])
    return df.select(F.col(id_col).cast("string").alias("id"), F.inline(F.array_compact(each)))


def repeated(df: DataFrame, id_col: str, order: str, rule: str = "duplicate id") -> DataFrame:
    """A row for every id's second and later rows, in order: their number as the detail; null ids are not compared."""
    n = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")).where("n > 1")
    return n.select("id", F.lit(rule).alias("rule"), (F.col("n") - 1).cast("string").alias("detail"))


def unknown(df: DataFrame, id_col: str, field: str, others: DataFrame, key: str, rule: str) -> DataFrame:
    """References of rows, a text or an array of texts, to ids that others doesn't have: a row each, the missing id as the detail."""
    array = df.schema[field].dataType.typeName() == "array"
    asked = df.select(F.col(id_col).cast("string").alias("id"), (F.explode(F.array_distinct(field)) if array else F.col(field)).alias("detail")).where("detail is not null")
    return asked.withColumn("detail", F.col("detail").cast("string")).join(others.select(F.col(key).cast("string").alias("detail")), "detail", "left_anti").select("id", F.lit(rule).alias("rule"), "detail")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def source_names(c: Column) -> Column:
    """A name of a source contract, not of a class: no capital, no 'fetcher'."""
    return ~c.rlike(r"\p{Lu}") & ~F.contains(F.lower(c), F.lit("fetcher"))


def evidence_faults(facts: DataFrame, claims: DataFrame, confidences: list[str], statuses: list[str]) -> DataFrame:
    """Of facts (id, confidence, status, value, country, extractor) and claims (id, text, fact_ids, route, function): unknown confidences and statuses, values that don't go with the status, missing countries and texts,
    extractors named after a class, claims without facts, with unknown facts, without an absolute route or function, and ids that stand twice."""
    c = F.col
    fact = broken(facts, "id", {
        "id required": (~blank(c("id")), c("id")), "confidence": (c("confidence").isin(confidences), c("confidence")), "status": (c("status").isin(statuses), c("status")), "null when not found": ((c("status") != "not_found") | c("value").isNull(), c("value")),
        "value when found": ((c("status") != "found") | c("value").isNotNull(), c("status")), "country required": (~blank(c("country")), c("country")), "extractor": (source_names(c("extractor")), c("extractor")),
    })
    claim = broken(claims, "id", {
        "text required": (~blank(c("text")), c("text")), "facts required": (F.size("fact_ids") > 0, F.lit(None)), "absolute route": (F.startswith("route", F.lit("/")), c("route")), "function required": (~blank(c("function")), c("function")),
    })
    return _all(fact, claim, unknown(claims, "id", "fact_ids", facts, "id", "unknown fact"), repeated(facts, "id", "id"), repeated(claims, "id", "id"))


def source_faults(entries: DataFrame, order: str = "position") -> DataFrame:
    """Of sources (id, kind, label, url): missing fields, ids that stand twice, addresses that are neither null nor http(s)."""
    c = F.col
    rules = {f"{name} required": (~blank(c(name)), c(name)) for name in ("id", "kind", "label")}
    rules["web address"] = (c("url").isNull() | c("url").rlike("^https?://"), c("url"))
    return _all(broken(entries, "id", rules), repeated(entries, "id", order))


def manifest_faults(layers: DataFrame, files: DataFrame, kinds: list[str]) -> DataFrame:
    """Of layers (id, kind, file, bounds_file) and the files (file) there are: ids that stand twice, unknown kinds, files that are missing, images without bounds or with bounds that are missing."""
    c = F.col
    image = c("kind") == "image"
    rows = broken(layers, "id", {"kind": (c("kind").isin(kinds), c("kind")), "file required": (~blank(c("file")), c("file")), "image bounds": (~F.coalesce(image, F.lit(False)) | ~blank(c("bounds_file")), c("bounds_file"))})
    return _all(rows, unknown(layers, "id", "file", files, "file", "missing file"), unknown(layers.where(image), "id", "bounds_file", files, "file", "missing bounds"), repeated(layers, "id", "id"))


def preflight(tables: dict[str, DataFrame], fields: dict[str, list[str]], valid: dict[str, dict[str, Column]], stop_times: str = "stop_times") -> DataFrame:
    """(gate, input, field, n) of an export that can't be built yet; no row if it can.

    fields: the inputs that are needed and their fields. missing_input: one is not there; empty_input: it has no row; missing_field: no column of the name, or n rows where it is blank; invalid_value: n rows where `valid` doesn't hold for a
    filled field; stop_sequence: no trip has two distinct stops. Each input is read once.
    """
    spark = next(iter(tables.values())).sparkSession
    told = "gate string, input string, field string, n long"
    out = [spark.createDataFrame([("missing_input", name, None, 1) for name in fields if name not in tables], told)]
    for name, needed in fields.items():
        if name not in tables:
            continue
        df = tables[name]
        there = [f for f in needed if f in df.columns]
        out.append(spark.createDataFrame([("missing_field", name, f, None) for f in needed if f not in df.columns], told))
        checks = {f: v for f, v in valid.get(name, {}).items() if f in df.columns}
        counted = [F.count(F.lit(1)).alias("_rows"), *[F.count_if(blank(F.col(f))).alias(f"_blank_{f}") for f in there], *[F.count_if(~blank(F.col(f)) & ~F.coalesce(v, F.lit(False))).alias(f"_bad_{f}") for f, v in checks.items()]]
        row = lambda gate, f, n, ok: F.when(~ok, F.struct(F.lit(gate).alias("gate"), F.lit(name).alias("input"), F.lit(f).cast("string").alias("field"), n.cast("long").alias("n")))  # noqa: B023, E731
        rows = [row("empty_input", None, F.lit(1), F.col("_rows") > 0), *[row("missing_field", f, F.col(f"_blank_{f}"), F.col(f"_blank_{f}") == 0) for f in there], *[row("invalid_value", f, F.col(f"_bad_{f}"), F.col(f"_bad_{f}") == 0) for f in checks]]
        out.append(df.agg(*counted).select(F.inline(F.array_compact(F.array(*rows)))))
    if stop_times in tables and {"trip_id", "stop_id"} <= set(tables[stop_times].columns):
        # two distinct stops: the least and the greatest differ
        ends = tables[stop_times].where(~blank(F.col("trip_id")) & ~blank(F.col("stop_id"))).groupBy("trip_id").agg((F.min(F.col("stop_id").cast("string")) < F.max(F.col("stop_id").cast("string"))).alias("two"))
        ready = ends.agg(F.count_if("two").alias("n"))
        out.append(ready.where("n = 0").select(F.lit("stop_sequence").alias("gate"), F.lit(stop_times).alias("input"), F.lit(None).cast("string").alias("field"), F.lit(1).cast("long").alias("n")))
    elif stop_times in fields:
        out.append(spark.createDataFrame([("stop_sequence", stop_times, None, 1)], told))
    return _all(*out)


def probe_status(results: DataFrame, payload: str = "payload", http_status: str = "http_status") -> DataFrame:
    """results with status, title, detail: what a token server answered. ok: it gave a token; gated: no policy yet; denied: 401 or 403; else error. payload is JSON text."""
    at = lambda path: F.get_json_object(payload, path)
    token = F.coalesce(at("$.results.accessToken"), F.lit(""))
    gated = F.coalesce(F.contains(at("$.detail"), F.lit("No policy exist")), F.lit(False)) | F.coalesce(F.contains(at("$.title"), F.lit("APD evaluation failed")), F.lit(False))
    status = F.when(token != "", "ok").when(gated, "gated").when(F.col(http_status).isin(401, 403), "denied").otherwise("error")
    return results.select("*", status.alias("status"), F.nullif(at("$.title"), F.lit("")).alias("title"), F.nullif(at("$.detail"), F.lit("")).alias("detail"))


def probe_groups(classified: DataFrame, group: str = "group") -> DataFrame:
    """(group, resources, ok, gated, denied, error, blocked): what the resources of each group answered; blocked is a group with one that is gated or denied."""
    n = {s: F.count_if(F.col("status") == s) for s in ("ok", "gated", "denied", "error")}
    return classified.groupBy(F.coalesce(group, F.lit("unknown")).alias("group")).agg(F.count(F.lit(1)).alias("resources"), *[c.alias(s) for s, c in n.items()], ((n["gated"] + n["denied"]) > 0).alias("blocked"))


def readiness(builds: DataFrame, groups: DataFrame, coverage: DataFrame, feeds: DataFrame) -> DataFrame:
    """(build, access_gated, inputs_ready, missing, gates, next_action) for builds (build, groups): gated where one of its groups is blocked, ready where coverage (resource, missing) lacks nothing.

    gates names what remains. next_action asks for the policy while any group is blocked or any of feeds (feed, status) is gated, else builds again.
    """
    blocked = builds.select("build", F.explode("groups").alias("group")).join(groups.where("blocked").select("group"), "group").groupBy("build").agg(F.count(F.lit(1)).alias("_blocked"))
    lacking = coverage.select(F.col("resource").alias("build"), "missing")
    one = groups.agg(F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("_any")).join(feeds.agg((F.count_if(F.col("status") == "gated") > 0).alias("_feeds")))
    gated, ready = F.col("_blocked").isNotNull(), F.coalesce(F.size("missing") == 0, F.lit(False))
    gates = F.array_compact(F.array(F.when(gated, "policy_access"), F.when(~ready, "missing_fields")))
    out = builds.join(blocked, "build", "left").join(lacking, "build", "left").join(F.broadcast(one))
    return out.select("build", gated.alias("access_gated"), ready.alias("inputs_ready"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), gates.alias("gates"), F.when(F.col("_any") | F.col("_feeds"), "request_policy").otherwise("build_layers").alias("next_action"))


def field_coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(resource, expected, present, missing, extra) of (resource, field) rows: how many fields are wanted and how many of them there are, and the names of those that lack and of those nobody asked for, in order."""
    wanted = expected.distinct().groupBy("resource").agg(F.array_sort(F.collect_set("field")).alias("_w"))
    given = present.distinct().groupBy("resource").agg(F.array_sort(F.collect_set("field")).alias("_g"))
    none = F.array().cast("array<string>")
    both = wanted.join(given, "resource", "full").select("resource", F.coalesce("_w", none).alias("_w"), F.coalesce("_g", none).alias("_g"))
    return both.select("resource", F.size("_w").alias("expected"), F.size(F.array_intersect("_w", "_g")).alias("present"), F.array_sort(F.array_except("_w", "_g")).alias("missing"), F.array_sort(F.array_except("_g", "_w")).alias("extra"))

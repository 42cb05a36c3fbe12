"""Readers of the formats that civic data comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = "type string, coordinates string"


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, props, geom_type, rings): features of GeoJSON files in their order, with the rings of polygons as arrays of structs (x, y); other geometries have none."""
    features = "struct<features: array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", features).alias("c"))
    one = whole.select(F.posexplode("c.features").alias("feature_id", "f"))
    kind = F.col("f.geometry.type")
    multi = F.when(kind == "Polygon", F.concat(F.lit("["), F.col("f.geometry.coordinates"), F.lit("]"))).when(kind == "MultiPolygon", F.col("f.geometry.coordinates"))
    rings = F.flatten(F.from_json(multi, "array<array<array<array<double>>>>"))
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return one.select("feature_id", F.col("f.properties").alias("props"), kind.alias("geom_type"), points.alias("rings"))


def feed_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of a transit feed, all text, empty cells kept, a byte-order mark taken off; None if the feed has none."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.csv(f"{folder}/{name}.txt", header=True, inferSchema=False, emptyValue="", nullValue="\0")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def csv_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with all columns as text and the file name in _file; a byte-order mark is taken off, bytes that the encoding has no character for become U+FFFD.

    Windows-1252, which Spark doesn't read, is Latin-1 but for its bytes from 0x80 to 0x9F.
    """
    windows = encoding.lower().replace("_", "-") in ("cp1252", "windows-1252")
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="ISO-8859-1" if windows else encoding, multiLine=True).select("*", F.col("_metadata.file_name").alias("_file"))
    if windows:
        controls = bytes(range(0x80, 0xA0))
        mend = str.maketrans(controls.decode("latin-1"), controls.decode("cp1252", "replace"))
        df = df.select(*[F.translate(f"`{c}`", "".join(map(chr, mend)), "".join(map(chr, mend.values()))).alias(c.translate(mend)) if c != "_file" else F.col(c) for c in df.columns])
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def header_groups(spark: SparkSession, path: str, encoding: str = "utf-8-sig") -> dict[tuple[str, ...], list[str]]:
    """Files at a path (a pattern of Spark's file systems) by the header that begins them; of a file only the first line is read, empty files are left out. A few files at a time, through the file system that Spark uses."""
    import csv
    from concurrent.futures import ThreadPoolExecutor

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)

    def header(file: str) -> tuple[str, ...]:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(file))
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding.removesuffix("-sig")))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        return tuple(c.strip() for c in next(csv.reader([(line or "").lstrip("\ufeff")]), []))

    files = sorted(s.getPath().toString() for s in fs.globStatus(place) or [] if s.isFile())
    with ThreadPoolExecutor(16) as pool:
        heads = list(pool.map(header, files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for head, file in zip(heads, files, strict=True):
        if any(head):
            groups.setdefault(head, []).append(file)
    return groups


def drifting_csv(spark: SparkSession, path: str, wanted: dict[str, str], encoding: str = "utf-8") -> DataFrame:
    """The wanted columns of CSV files whose headers differ, all as text, with the file's name in _file.

    wanted: output name to the start of a header's name. A header that is the output name itself counts, else the first that starts so; files without one of the columns are left out. Files with one header are one scan, which
    reads the wanted columns alone.
    """
    out = None
    for head, files in header_groups(spark, path, f"{encoding}-sig").items():
        at = {name: head.index(name) if name in head else next((i for i, h in enumerate(head) if h.startswith(start)), None) for name, start in wanted.items()}
        if None in at.values():
            continue
        scan = spark.read.schema(", ".join(f"c{i} string" for i in range(len(head)))).csv(files, header=True, enforceSchema=True, encoding=encoding)
        one = scan.select(*[F.col(f"c{i}").alias(name) for name, i in at.items()], F.col("_metadata.file_name").alias("_file"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in [*wanted, "_file"]))
    return out


def manifests(spark: SparkSession, root: str, tail: str, fields: str) -> DataFrame:
    """(city, m): JSON documents at <root>/<city>/<tail>, one a city, parsed to the given fields; m is null where a document is no JSON."""
    whole = spark.read.text(f"{root}/*/{tail}", wholetext=True).select(F.col("_metadata.file_path").alias("_path"), "value")
    return whole.select(F.element_at(F.split(F.replace("_path", F.lit(f"/{tail}"), F.lit("")), "/"), -1).alias("city"), F.from_json("value", fields).alias("m"))


def ledger(spark: SparkSession, path: str, marks: tuple[str, ...] = ("Name of Work", "Job Number")) -> DataFrame:
    """(file, line, cells): the rows below the header of ledgers that begin with other lines; the header is the first line with one of the marks.

    cells maps header names to text. A file without such a line gives no rows.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    is_header = F.lit(False)
    for m in marks:
        is_header = is_header | F.contains("text", F.lit(m))
    heads = lines.where(is_header).groupBy("file").agg(F.min_by("text", "line").alias("header"), F.min("line").alias("at"))
    cells = lambda c: F.transform(F.split(c, r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    body = lines.join(F.broadcast(heads), "file").where((F.col("line") > F.col("at")) & (F.trim("text") != ""))
    pairs = F.arrays_zip(cells(F.col("header")).alias("k"), cells(F.col("text")).alias("v"))
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & (p["k"] != ""))
    return body.select("file", "line", F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"]))).alias("cells"))


def json_rows(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Text columns of JSON exports: an array of objects, or one under results, data, features or records; a cell may be {"type": .., "value": ..}."""
    whole = spark.read.text(path, wholetext=True)
    body = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in ("results", "data", "features", "records")], F.col("value"))
    row = F.explode(F.from_json(body, "array<map<string,string>>"))
    one = whole.select(row.alias("r"))
    cell = lambda f: F.coalesce(F.get_json_object(F.col("r")[f], "$.value"), F.col("r")[f])
    return one.select(*[cell(f).alias(f) for f in fields])


def feature_lines(spark: SparkSession, path: str, prefix: str = '{"type":"Feature"') -> DataFrame:
    """Features that stand one to a line, a comma at the end or not: (type, geometry and properties as text); other lines are left out. Files whose names end in .xz are decompressed."""
    from wardlight.sources.archives import xz_lines

    lines = (xz_lines(spark, path) if path.endswith(".xz") else spark.read.text(path)).select(F.rtrim(F.trim("value"), F.lit(",")).alias("t"))
    fits = F.startswith(F.regexp_replace("t", r"\s", ""), F.lit(prefix))
    return lines.where(fits).select(F.get_json_object("t", "$.geometry.type").alias("type"), F.get_json_object("t", "$.geometry.coordinates").alias("coordinates"), F.get_json_object("t", "$.properties").alias("properties"))


def key_from_file(pattern: str, group: int = 1, column: str = "_file") -> Column:
    """A key from the file name, as in Work_Orders_for_<name>_Num-<n>_Ward.csv."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))

"""Writers of tables and feature collections; all write in parallel, a folder of parts each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str], compress: bool = False) -> None:
    """CSV with a fixed column order, gzipped if asked for."""
    df.select(*columns).write.mode("overwrite").option("compression", "gzip" if compress else "none").csv(path, header=True)


def feature_lines(df: DataFrame, path: str, ring: str = "ring", order: str | None = None) -> None:
    """GeoJSON features, one to a line, polygons from a ring column and all other columns as properties; in the order of a column if given."""
    if order:
        df = df.orderBy(order)
    coordinates = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(*[c for c in df.columns if c != ring]).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(coordinates).alias("coordinates")).alias("geometry"),
    )
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def fan_out(df: DataFrame, folder: str) -> None:
    """The table as Parquet, CSV and JSON."""
    df.write.mode("overwrite").parquet(f"{folder}/parquet")
    df.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    df.write.mode("overwrite").json(f"{folder}/json")


def run_log(df: DataFrame, path: str) -> None:
    """Append (started, scope, n, ...) rows as JSON lines with id: the first 16 hex digits of SHA-256 of started:scope:n."""
    ids = F.substring(F.sha2(F.concat_ws(":", "started", "scope", F.col("n").cast("string")), 256), 1, 16)
    df.withColumn("id", ids).write.mode("append").json(path)


#: The order of a feed table's fields; others follow in alphabetical order.
FEED_FIELDS = {
    "routes": ["route_id", "agency_id", "route_short_name", "route_long_name", "route_desc", "route_type"], "trips": ["route_id", "service_id", "trip_id", "shape_id"],
    "agency": ["agency_id", "agency_name", "agency_url", "agency_timezone"], "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"], "stops": ["stop_id", "stop_name", "stop_code", "stop_lat", "stop_lon"],
}


#: The tables that a feed must have, in their order, and the columns that order their rows.
REQUIRED = {"agency": ["agency_id"], "calendar": ["service_id"], "routes": ["route_id"], "trips": ["trip_id"], "stop_times": ["trip_id", "stop_sequence"], "stops": ["stop_id"]}


def feed(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """A transit feed as one zip archive of text tables, agency and calendar among them; returns the bytes of each. Raises, and leaves nothing behind, if a gate of transit.feed_gates finds a fault or a table is missing or empty.

    Fields stand in their order, others after them by name; rows by the columns of REQUIRED, of other tables by the first field.
    """
    from wardlight.operators.transit import feed_gates
    from wardlight.sources.archives import csv_lines, write_zip

    faults = {r["gate"]: r["bad"] for r in feed_gates(tables, required=tuple(REQUIRED)).where("bad > 0").collect()}  # a row for each gate
    if faults:
        raise ValueError(f"feed not written: {faults}")
    members = {}
    for name in [*REQUIRED, *sorted(set(tables) - set(REQUIRED))]:
        df = tables[name]
        known = [c for c in FEED_FIELDS.get(name, []) if c in df.columns]
        fields = [*known, *sorted(set(df.columns) - set(known))]
        members[f"{name}.txt"] = csv_lines(df, fields, REQUIRED.get(name, fields[:1]))
    return write_zip(next(iter(tables.values())).sparkSession, members, path)


def feature_collection(df: DataFrame, path: str, geometry: str, order: list[str]) -> None:
    """One GeoJSON document: a feature for each row, its geometry a column of GeoJSON text (null: none), all other columns its properties, nulls kept; in the order of columns."""
    from wardlight.sources.archives import write_text

    properties = F.to_json(F.struct(*[c for c in df.columns if c != geometry]), {"ignoreNullFields": "false"})
    feature = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))
    write_text(df.sparkSession, df.orderBy(*order).select(feature.alias("value")), path, '{"type":"FeatureCollection","features":[', ",", "]}")

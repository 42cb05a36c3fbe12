"""Builders of transit feeds from sources that are none: end points, relations of a map, lists of stop names, sightings of vehicles, metro lines with a headway.

Each gives the tables of a feed, which transit.feed_gates and writers.feed take. A route needs two stops that differ from their neighbours; others are left out of all tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import geo

#: A service of every day, and how far its calendar reaches where nothing else is known.
SERVICE, FROM, TO = "daily", "20200101", "20301231"
STOP = "struct<stop_id:string,stop_name:string,x:double,y:double>"


def clock(seconds: Column) -> Column:
    """HH:MM:SS of seconds after midnight; hours may pass 23."""
    s = F.round(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def apart(stops: Column) -> Column:
    """Stops in order, equal neighbours once."""
    return F.aggregate(stops, F.array().cast(f"array<{STOP}>"), lambda kept, s: F.when((F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1)["stop_id"] == s["stop_id"]), kept).otherwise(F.concat(kept, F.array(s))))


def ride_times(stops: Column, metres_per_second: float, dwell: float, detour: float = 1.0) -> Column:
    """Seconds from the first stop to each: the great-circle way times a detour at a pace, and a stay at each stop between."""
    start = F.struct(F.array(F.lit(0.0)).alias("at"), F.lit(0.0).alias("now"))
    pairs = F.zip_with(F.slice(stops, F.lit(1), F.greatest(F.size(stops) - 1, F.lit(0))), F.slice(stops, F.lit(2), F.greatest(F.size(stops) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def add(s: Column, p: Column) -> Column:
        ride = geo.haversine(p["a"]["y"], p["a"]["x"], p["b"]["y"], p["b"]["x"]) * (detour / metres_per_second)
        now = s["now"] + F.when(F.size(s["at"]) > 1, dwell).otherwise(0.0) + ride
        return F.struct(F.concat(s["at"], F.array(now)).alias("at"), now.alias("now"))

    return F.aggregate(pairs, start, add, lambda s: s["at"])


def tables(trips: DataFrame, agency: str) -> dict[str, DataFrame]:
    """A feed of (trip_id, route_id, route_name, route_type, direction, start, stops, at): start and at are seconds, stops an array of STOP. Trips of fewer than two stops are left out; a stop id's first name and place by order count."""
    kept = trips.where(F.size("stops") >= 2)
    each = kept.select("trip_id", "start", F.posexplode(F.arrays_zip("stops", "at")).alias("stop_sequence", "s"))
    times = each.select("trip_id", "stop_sequence", F.col("s.stops.stop_id").alias("stop_id"), clock(F.col("start") + F.col("s.at")).alias("time"))
    return _feed(kept, times, each.select("s.stops.stop_id", "s.stops.stop_name", "s.stops.x", "s.stops.y"), agency)


def _feed(kept: DataFrame, times: DataFrame, places: DataFrame, agency: str) -> dict[str, DataFrame]:
    """A feed of trips (trip_id, route_id, route_name, route_type, direction), their times (trip_id, stop_sequence, stop_id, time) and stops (stop_id, stop_name, x, y)."""
    spark = kept.sparkSession
    stops = places.groupBy("stop_id").agg(F.min(F.struct("stop_name", "x", "y")).alias("_s"))
    return {
        "agency": spark.range(1).select(F.lit(agency).alias("agency_id"), F.lit(agency).alias("agency_name"), F.lit("https://example.org").alias("agency_url"), F.lit("Asia/Kolkata").alias("agency_timezone")),
        "calendar": spark.range(1).select(F.lit(SERVICE).alias("service_id"), *[F.lit(1).alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")], F.lit(FROM).alias("start_date"), F.lit(TO).alias("end_date")),
        "routes": kept.groupBy("route_id").agg(F.min("route_name").alias("route_long_name"), F.min("route_type").alias("route_type")).withColumn("agency_id", F.lit(agency)),
        "trips": kept.select("trip_id", "route_id", F.lit(SERVICE).alias("service_id"), F.col("direction").alias("direction_id")),
        "stop_times": times.select("trip_id", "stop_sequence", "stop_id", F.col("time").alias("arrival_time"), F.col("time").alias("departure_time")),
        "stops": stops.select("stop_id", "_s.stop_name", F.col("_s.y").alias("stop_lat"), F.col("_s.x").alias("stop_lon")),
    }


def _both_ways(lines: DataFrame, start: int, pace: float, dwell: float, detour: float = 1.0, route_type: int = 3) -> DataFrame:
    """A trip along each line and one back, from (route_id, route_name, stops)."""
    ways = F.array(F.struct(F.lit(0).alias("direction"), F.col("stops").alias("stops")), F.struct(F.lit(1).alias("direction"), F.reverse("stops").alias("stops")))
    each = lines.select("route_id", "route_name", F.explode(ways).alias("w")).select("route_id", "route_name", "w.direction", "w.stops")
    return each.select(F.concat_ws("_", F.col("route_id").cast("string"), F.col("direction").cast("string")).alias("trip_id"), "route_id", "route_name", F.lit(route_type).alias("route_type"), "direction", F.lit(start).alias("start"), "stops", ride_times(F.col("stops"), pace, dwell, detour).alias("at"))


def from_ends(routes: DataFrame, agency: str = "ends", start: int = 21600, pace: float = 5.0, detour: float = 1.3) -> dict[str, DataFrame]:
    """Routes known by their two ends (route_id, route_name, origin, destination: STOP): a trip each way, as long as the detour between them takes. Ends without a coordinate, or that are one stop, make no route."""
    ends = routes.where("origin.x is not null and origin.y is not null and destination.x is not null and destination.y is not null").select("route_id", "route_name", apart(F.array("origin", "destination")).alias("stops"))
    return tables(_both_ways(ends, start, pace, 0.0, detour), agency)


def from_relations(relations: DataFrame, nodes: DataFrame, agency: str = "map", start: int = 21600, pace: float = 6.0, dwell: float = 20.0) -> dict[str, DataFrame]:
    """Relations (route_id, route_name, members: array of structs (ref, role)) and nodes (ref, name, x, y): the members that are stops or platforms, in their order; nodes that aren't known are left out, a name that is blank is the reference."""
    member = relations.select("route_id", "route_name", F.posexplode("members").alias("at", "m")).where(F.col("m.role").rlike("^(stop|platform)"))
    stop = F.struct(F.col("ref").cast("string").alias("stop_id"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("ref").cast("string")).alias("stop_name"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    met = member.withColumn("ref", F.col("m.ref")).join(nodes.where("x is not null and y is not null"), "ref")
    lines = met.groupBy("route_id", "route_name").agg(F.array_sort(F.collect_list(F.struct("at", stop.alias("s")))).alias("_l"))  # the stops of a line
    return tables(_both_ways(lines.select("route_id", "route_name", apart(F.transform("_l", lambda x: x["s"])).alias("stops")), start, pace, dwell), agency)


def from_stop_lists(lists: DataFrame, stops: DataFrame, agency: str = "lists", start: int = 21600, pace: float = 5.0, dwell: float = 15.0) -> dict[str, DataFrame]:
    """Routes as lists of names (route_id, route_name, names) and stops (stop_id, stop_name, x, y): a name means the first stop, by id, that is called so without regard to case, blanks and signs; unknown ones are left out."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")
    known = stops.where("x is not null and y is not null").groupBy(key(F.col("stop_name")).alias("_k")).agg(F.min(F.struct(F.col("stop_id").cast("string").alias("stop_id"), "stop_name", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("_s")).where("_k <> ''")
    named = lists.select("route_id", "route_name", F.posexplode("names").alias("at", "n")).withColumn("_k", key(F.col("n"))).join(known, "_k")
    lines = named.groupBy("route_id", "route_name").agg(F.array_sort(F.collect_list(F.struct("at", "_s"))).alias("_l"))
    return tables(_both_ways(lines.select("route_id", "route_name", apart(F.transform("_l", lambda x: x["_s"])).alias("stops")), start, pace, dwell), agency)


def from_sightings(seen: DataFrame, stops: DataFrame, agency: str = "seen") -> dict[str, DataFrame]:
    """Vehicles seen at stops (trip_id, route_id, route_name, stop_id, second: of the day): each trip's stops by time, equal neighbours once at their first time, with the times as seen. Sightings without a time or a known stop are left out."""
    known = stops.where("x is not null and y is not null")
    at = seen.where("second is not null").join(known.select("stop_id"), "stop_id", "left_semi")
    trip = Window.partitionBy("trip_id")
    by_time = trip.orderBy("second", "stop_id")
    moved = at.withColumn("_before", F.lag("stop_id").over(by_time)).where(F.col("_before").isNull() | (F.col("_before") != F.col("stop_id")))
    # rows stay as narrow as a sighting: names and places are the stops' alone
    rows = moved.withColumn("stop_sequence", F.row_number().over(by_time) - 1).withColumn("_n", F.count(F.lit(1)).over(trip)).where("_n >= 2")
    name = F.col("trip_id").cast("string").alias("trip_id")
    trips = rows.groupBy("trip_id").agg(F.min("route_id").alias("route_id"), F.min("route_name").alias("route_name")).select(name, "route_id", "route_name", F.lit(3).alias("route_type"), F.lit(0).alias("direction"))
    times = rows.select(name, "stop_sequence", F.col("stop_id").cast("string").alias("stop_id"), clock(F.col("second")).alias("time"))
    places = known.join(rows.select("stop_id"), "stop_id", "left_semi").select(F.col("stop_id").cast("string").alias("stop_id"), F.col("stop_name").cast("string").alias("stop_name"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _feed(trips, times, places, agency)


def from_lines(stations: DataFrame, service: DataFrame, agency: str = "metro", pace: float = 9.0, dwell: float = 30.0) -> dict[str, DataFrame]:
    """Metro lines from their stations (line_id, line_name, position, stop_id, stop_name, x, y) and service (line_id, first, last, headway: seconds): a trip each way at every headway from the first departure to the last. A headway that isn't above 0 makes one trip each way."""
    stop = F.struct(F.col("stop_id").cast("string").alias("stop_id"), F.col("stop_name").cast("string").alias("stop_name"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    lines = stations.where("x is not null and y is not null").groupBy("line_id", "line_name").agg(F.array_sort(F.collect_list(F.struct("position", stop.alias("s")))).alias("_l"))
    both = _both_ways(lines.select(F.col("line_id").alias("route_id"), F.col("line_name").alias("route_name"), apart(F.transform("_l", lambda x: x["s"])).alias("stops")), 0, pace, dwell, route_type=1)
    starts = F.when(F.col("headway") > 0, F.sequence(F.col("first"), F.greatest("first", "last"), F.greatest("headway", F.lit(1)))).otherwise(F.array("first"))
    timed = both.drop("start").join(service.select(F.col("line_id").alias("route_id"), F.explode(starts).alias("start")), "route_id")
    return tables(timed.withColumn("trip_id", F.concat_ws("_", "trip_id", F.col("start").cast("string"))), agency)

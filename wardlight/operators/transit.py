"""Relational transforms of transit feeds: routes, trips, stop_times, stops, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import shapes as shapes_of


def stop_events_by_agency(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, agencies: list[str]) -> DataFrame:
    """(stop_id, a column for each agency, other): events of stops, '?' and unlisted agencies together."""
    chain = stop_times.join(trips.select("trip_id", "route_id"), "trip_id", "left").join(routes.select("route_id", "agency_id"), "route_id", "left")
    agency = F.coalesce("agency_id", F.lit("?"))
    cols = [F.count_if(agency == a).alias(a.lower()) for a in agencies]
    return chain.groupBy("stop_id").agg(*cols, F.count_if(~agency.isin(*agencies)).alias("other"))


def filter_routes(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, keep: Column) -> dict[str, DataFrame]:
    """The feed of the routes that `keep` holds for, by semi-joins down the chain."""
    r = routes.where(keep)
    t = trips.join(r, "route_id", "left_semi")
    st = stop_times.join(t, "trip_id", "left_semi")
    return {"routes": r, "trips": t, "stop_times": st, "stops": stops.join(st, "stop_id", "left_semi")}


def in_box(x0: float, y0: float, x1: float, y1: float) -> Column:
    return F.col("x").between(x0, x1) & F.col("y").between(y0, y1)


def filter_box(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, box: Column, least_hits: int = 2) -> dict[str, DataFrame]:
    """The feed of the trips that stop at least so often in a box; repeated visits count."""
    inside = stops.where(box)
    hits = stop_times.join(inside, "stop_id", "left_semi").groupBy("trip_id").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least_hits)
    t = trips.join(hits, "trip_id", "left_semi")
    return {"routes": routes.join(t, "route_id", "left_semi"), "trips": t, "stop_times": stop_times.join(t, "trip_id", "left_semi").join(inside, "stop_id", "left_semi"), "stops": inside}


def first_trip(trips: DataFrame, order: str) -> DataFrame:
    """(route_id, trip_id): a route's first trip."""
    return trips.groupBy("route_id").agg(F.min_by("trip_id", order).alias("trip_id"))


def longest_trip(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(route_id, trip_id, n_stops): the trip of each route with the most stops, the smallest id of several."""
    n = stop_times.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_stops"))
    both = trips.join(n, "trip_id")
    best = both.groupBy("route_id").agg(F.max_by(F.struct("trip_id", "n_stops"), F.struct("n_stops", -F.col("trip_id"))).alias("b"))
    return best.select("route_id", "b.trip_id", "b.n_stops")


def paths(stop_times: DataFrame, least: int = 2) -> DataFrame:
    """(trip_id, stops): stop ids in their order, equal neighbours once; trips of fewer stops are left out."""
    by_trip = Window.partitionBy("trip_id").orderBy("stop_sequence", "stop_id")
    kept = stop_times.withColumn("_before", F.lag("stop_id").over(by_trip)).where(F.col("_before").isNull() | (F.col("_before") != F.col("stop_id")))
    ordered = kept.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("s"))
    return ordered.where(F.size("s") >= least).select("trip_id", F.transform("s", lambda p: p["stop_id"]).alias("stops"))


def quality(stop_times: DataFrame) -> DataFrame:
    """One row: trips, trips with two or more distinct stops, the most distinct stops of a trip."""
    d = stop_times.groupBy("trip_id").agg(F.count_distinct("stop_id").alias("d"))
    return d.agg(F.count(F.lit(1)).alias("trips"), F.count_if(F.col("d") >= 2).alias("trips_with_two"), F.max("d").alias("most_stops"))


def token_match(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name_id, score): the best name for each query, from (query_id, words) and (name_id, ordinal, words), words being distinct words in an array.

    Equal word lists score 2. Otherwise the score is shared words over the longer list, and must be 0.67, or 0.5 with two shared words; the first name wins ties.
    """
    # Half of the longer list must be shared, so of each list the rarest words, all but half of them and one more, hold a shared one if there is a match: only these are joined.
    rarity = names.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("often"))

    def rare(df: DataFrame, id_: str) -> DataFrame:
        each = df.select(id_, F.size("words").alias("n"), F.explode("words").alias("w")).join(rarity, "w")
        ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(id_).orderBy("often", "w")))
        return ranked.withColumn("unknown", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy(id_))).where(F.col("r") + F.col("unknown") <= F.col("n") - F.ceil(F.col("n") / 2) + 1).select(id_, "w")

    pairs = rare(queries, "query_id").join(rare(names, "name_id"), "w").select("query_id", "name_id").distinct()
    both = pairs.join(queries.select("query_id", F.col("words").alias("qw")), "query_id").join(names.select("name_id", "ordinal", F.col("words").alias("nw")), "name_id")
    both = both.withColumn("shared", F.size(F.array_intersect("qw", "nw")))
    score = F.when(F.array_sort("qw") == F.array_sort("nw"), 2.0).otherwise(F.col("shared") / F.greatest(F.size("qw"), F.size("nw")))
    scored = both.withColumn("score", score).where((F.col("score") >= 0.67) | ((F.col("shared") >= 2) & (F.col("score") >= 0.5)))
    best = scored.groupBy("query_id").agg(F.min_by(F.struct("name_id", "score"), F.struct(-F.col("score"), "ordinal")).alias("b"))
    return best.select("query_id", "b.name_id", "b.score")


#: The tables that hold a feed together.
CHAIN = ("routes", "trips", "stop_times", "stops")


def feed_gates(feed: dict[str, DataFrame], least_stops: int = 2, required: tuple[str, ...] = CHAIN) -> DataFrame:
    """(gate, bad): how many faults each gate of a feed finds: a required table that is missing or empty counts one, then trips of too few stops, and stop times, trips without their stop, trip or route; trips of an
    unknown service and routes of an unknown agency where the feed has a calendar, an agency table and the columns that name them."""
    spark = next(iter(feed.values())).sparkSession
    gates = [
        feed[name].limit(1).agg(F.lit(f"has_{name}").alias("gate"), (1 - F.count(F.lit(1))).alias("bad")) if name in feed else spark.range(1).select(F.lit(f"has_{name}").alias("gate"), F.lit(1).cast("long").alias("bad"))
        for name in required
    ]
    if all(name in feed for name in CHAIN):
        n = feed["stop_times"].groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
        short = feed["trips"].join(n, "trip_id", "left").where(F.coalesce("n", F.lit(0)) < least_stops)
        lost = {"stop_times_without_stop": ("stop_times", "stops", "stop_id"), "stop_times_without_trip": ("stop_times", "trips", "trip_id"), "trips_without_route": ("trips", "routes", "route_id")}
        more = {"trips_without_service": ("trips", "calendar", "service_id"), "routes_without_agency": ("routes", "agency", "agency_id")}
        lost |= {gate: (a, b, key) for gate, (a, b, key) in more.items() if b in feed and key in feed[a].columns and key in feed[b].columns}
        count = lambda df, gate: df.agg(F.lit(gate).alias("gate"), F.count(F.lit(1)).alias("bad"))
        gates += [count(short, "short_trips"), *[count(feed[a].join(feed[b], key, "left_anti"), gate) for gate, (a, b, key) in lost.items()]]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def ward_stops(stops: DataFrame, wards: DataFrame, buffer_m: float, lat: float) -> DataFrame:
    """(point_id, poly_id, strict): the first ward that holds a stop, else the one whose vertex lies nearest within the buffer; other stops are left out."""
    from wardlight.operators import spatial

    inside = spatial.first_containing(stops, wards)
    near = spatial.nearest_vertex(stops.join(inside, "point_id", "left_anti"), wards, buffer_m, lat)
    return inside.withColumn("strict", F.lit(True)).unionByName(near.withColumn("strict", F.lit(False)))


def both_directions(paths_: DataFrame, first_minute: int = 360, minutes: int = 5) -> DataFrame:
    """(trip, direction, stop_sequence, stop_id, arrival): a trip along each path and one back, with times at a fixed pace; from (trip_id, stops)."""
    there = F.struct(F.lit(0).alias("direction"), F.col("stops"))
    back = F.struct(F.lit(1).alias("direction"), F.reverse("stops").alias("stops"))
    each = paths_.select("trip_id", F.explode(F.array(there, back)).alias("d")).select("trip_id", "d.direction", F.posexplode("d.stops").alias("stop_sequence", "stop_id"))
    at = F.col("stop_sequence") * minutes + first_minute
    arrival = F.format_string("%02d:%02d:00", F.floor(at / 60).cast("int"), (at % 60).cast("int"))
    return each.select(F.format_string("%d_%d", F.col("trip_id"), F.col("direction")).alias("trip"), "direction", "stop_sequence", "stop_id", arrival.alias("arrival"))


def assembled_line(members: Column) -> Column:
    """The nodes of a line from its ways in order, an array of (a, b) ends: each is turned so that it begins where the one before ends; one that touches nothing stands as it is."""

    def add(line: Column, way: Column) -> Column:
        end = F.element_at(line, -1)
        return F.when(F.size(line) == 0, F.array(way["a"], way["b"])).when(end == way["a"], F.concat(line, F.array(way["b"]))).when(end == way["b"], F.concat(line, F.array(way["a"]))).otherwise(F.concat(line, F.array(way["a"], way["b"])))

    return F.aggregate(members, F.array().cast("array<long>"), add)


def code_or_name(rows: DataFrame, stations: DataFrame, strict: bool = False) -> DataFrame:
    """(id, station, by) for rows (id, code, name): the station (station, code, name, position) of that code, else the first by position whose name is, holds or lies in the row's name.

    by is 'code' or 'name'. A row without either has nulls, or with strict ends the query. Blank names match nothing; names are compared as they are, so normalise them first.
    Containment is an equality of one name with a piece of the other: a name of n characters has n * (n + 1) / 2 pieces, so names should be names. Distinct names are matched, then joined back.
    """
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(i, F.length(c)), lambda j: F.substring(c, i, j - i + 1)))))
    rows = rows.select("id", F.upper(F.trim("code")).alias("code"), "name")
    by_code = stations.where("trim(code) <> ''").groupBy(F.upper(F.trim("code")).alias("code")).agg(F.min_by("station", "position").alias("_coded"))
    wanted = rows.where("trim(name) <> ''").select("name").distinct()
    known = stations.where("trim(name) <> ''").groupBy(F.col("name").alias("other")).agg(F.min(F.struct("position", "station")).alias("_place"))
    inside = wanted.withColumn("piece", F.explode(pieces(F.col("name")))).join(known.withColumnRenamed("other", "piece"), "piece")
    around = known.withColumn("name", F.explode(pieces(F.col("other")))).join(wanted, "name")
    named = inside.select("name", "_place").unionByName(around.select("name", "_place")).groupBy("name").agg(F.min("_place")["station"].alias("_named"))
    found = rows.join(by_code, "code", "left").join(named, "name", "left")
    station = F.coalesce("_coded", "_named")
    if strict:
        station = F.coalesce(station, F.raise_error(F.concat(F.lit("no station for "), F.coalesce("name", F.lit("")))).cast(stations.schema["station"].dataType))
    return found.select("id", station.alias("station"), F.when(F.col("_coded").isNotNull(), "code").when(F.col("_named").isNotNull(), "name").alias("by"))


def shape_paths(shapes: DataFrame) -> DataFrame:
    """(shape_id, path): the points of each shape in order, from (shape_id, sequence, x, y); shapes of fewer than two points are left out."""
    gathered = shapes.where("x is not null and y is not null").groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("_p"))
    return gathered.where(F.size("_p") >= 2).select("shape_id", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))


def longest_shape(trips: DataFrame, shaped: DataFrame) -> DataFrame:
    """(route_id, trip_id, metres, path): the trip of each route whose shape is longest along itself, the first trip of equals (lengths to the millimetre); trips are (trip_id, route_id, shape_id), shaped is shape_paths()."""
    measured = shaped.withColumn("metres", F.round(shapes_of.haversine_length(F.col("path")), 3))
    # the choice is made on ids and lengths, the path comes after it
    best = trips.join(measured.select("shape_id", "metres"), "shape_id").groupBy("route_id").agg(F.min_by(F.struct("trip_id", "shape_id", "metres"), F.struct(-F.col("metres"), "trip_id")).alias("_b"))
    return best.select("route_id", "_b.*").join(shaped, "shape_id").select("route_id", "trip_id", "metres", "path")


def city_lines(feed: dict[str, DataFrame], shaped: DataFrame, box: tuple[float, float, float, float], keywords: list[str], name: str = "route_name", least_hits: int = 2) -> DataFrame:
    """(route_id, trip_id, hits, line, pieces): for each route with a keyword in its name (any route without keywords), its first trip by id that stops at least so often in the box and has a line there.

    line: the points of the trip's shape inside the box, or of its stops there where it has no shape; it has two points at least. pieces: the shape clipped where it crosses the box, a path for each stay. Feed: routes,
    trips (trip_id, route_id, shape_id), stop_times and stops (stop_id, x, y).
    """
    x0, y0, x1, y1 = box
    wanted = F.lit(True) if not keywords else F.coalesce(F.lower(name).rlike("|".join(k.lower() for k in keywords)), F.lit(False))
    kept = feed["trips"].join(feed["routes"].where(wanted).select("route_id"), "route_id", "left_semi")
    inside = feed["stops"].where(in_box(*box)).select("stop_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    stops = feed["stop_times"].join(inside, "stop_id").groupBy("trip_id").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list(F.struct("stop_sequence", "x", "y"))).alias("_stops")).where(F.col("hits") >= least_hits)
    xy = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    held = F.filter("path", lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))
    line = F.when(F.col("path").isNotNull(), held).otherwise(F.transform("_stops", xy))
    lined = kept.join(stops, "trip_id").join(shaped, "shape_id", "left").withColumn("line", line).where(F.size("line") >= 2)
    pieces = F.coalesce(shapes_of.clipped(F.col("path"), *box), F.array("line"))
    first = lined.groupBy("route_id").agg(F.min("trip_id").alias("trip_id"))
    return lined.join(first, ["route_id", "trip_id"]).select("route_id", "trip_id", "hits", "line", pieces.alias("pieces"))

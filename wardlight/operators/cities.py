"""A city's layers and tables put together: wards with their rosters, audits of what is disclosed, headline figures filled, sample layers of loose rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import coerce, geo


def first_text(*columns: Column) -> Column:
    """The first of some cells that has a character, trimmed; null without one."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def first_number(*columns: Column, low: float = float("-inf"), high: float = float("inf")) -> Column:
    """The first of some cells that is a finite number within bounds."""
    numbers = [F.trim(c.cast("string")).try_cast("double") for c in columns]
    return F.coalesce(*[F.when(~F.isnan(n) & n.between(low, high) & (F.abs(n) < float("inf")), n) for n in numbers])


def named_wards(wards: DataFrame, roster: DataFrame, number_keys: list[str], zone_keys: list[str]) -> DataFrame:
    """wards with number, Name and councillor_count, councillors, parties, phones: the number is the first filled of its columns, a missing name is 'Ward n' with the zone, and the roster (number, name, party, phone) joins by the
    digits and letters of the number without leading zeros. A ward the roster hasn't keeps nulls; of several people for a ward all count, in order of name."""
    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]", ""), "^0+(?=.)", "")
    number, zone = F.coalesce(first_text(*[F.col(c) for c in number_keys]), F.lit("")), first_text(*[F.col(c) for c in zone_keys])
    default = F.concat(F.lit("Ward "), number, F.coalesce(F.concat(F.lit(" · "), zone), F.lit("")))
    people = roster.where("trim(name) <> ''").groupBy(key(F.col("number")).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("name", "party", "phone"))).alias("_p"))  # the seats of a ward
    out = wards.withColumn("number", number).withColumn("Name", F.coalesce(F.col("Name") if "Name" in wards.columns else F.lit(None).cast("string"), default)).withColumn("_k", key(F.col("number")))
    joined = lambda f: F.nullif(F.array_join(F.transform("_p", lambda p: F.coalesce(p[f], F.lit(""))), "; "), F.lit("")).alias
    done = out.join(people.where("_k <> ''"), "_k", "left")
    return done.select(*[c for c in out.columns if c != "_k"], F.coalesce(F.size("_p"), F.lit(0)).alias("councillor_count"), joined("name")("councillors"), joined("party")("parties"), joined("phone")("phones"))


def city_summary(wards: DataFrame, officers: DataFrame, layers: DataFrame) -> DataFrame:
    """One row: bbox and centre of the wards' rings (4 places), the metric projection, wards, wards with councillors, layers with a feature, and the commissioner: the first officer by order whose role says municipal commissioner, else
    commissioner; '?' without one. officers: (role, name, position); layers: (layer, n)."""
    low = lambda k: F.min(F.array_min(F.transform("ring", lambda p: p[k])))
    high = lambda k: F.max(F.array_max(F.transform("ring", lambda p: p[k])))
    box = wards.agg(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"), F.count(F.lit(1)).alias("wards"), F.count_if(F.col("councillor_count") > 0).alias("staffed"))
    role = F.lower(F.coalesce("role", F.lit("")))
    rank = F.when(F.contains(role, F.lit("municipal commissioner")), 0).when(F.contains(role, F.lit("commissioner")), 1)
    who = officers.withColumn("_r", rank).where("_r is not null").agg(F.min_by("name", F.struct("_r", "position")).alias("commissioner"))
    shown = layers.agg(F.count_if(F.col("n") > 0).alias("layers"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    r4 = lambda c: F.round(c, 4)
    one = box.join(who).join(shown)  # one row each
    return one.select(F.array(*[r4(F.col(c)) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"), F.array(r4(cx), r4(cy)).alias("centre"), F.concat(F.lit("EPSG:"), geo.utm_epsg(cx).cast("string")).alias("crs"), "wards", "staffed", "layers", F.coalesce("commissioner", F.lit("?")).alias("commissioner"))


def disclosure_audit(metrics: DataFrame, systems: DataFrame, values: DataFrame, partial: DataFrame) -> DataFrame:
    """(system, metric, label, status, value, year, priority) for every system and metric: available with the latest value, partial where (system, metric) is listed as such, missing without a value, with what to do about it.

    metrics: (metric, label); systems: (system), few of each; values: (system, metric, year, value), blanks don't count.
    """
    latest = values.where(first_text(F.col("value")).isNotNull()).groupBy("system", "metric").agg(F.max(F.struct("year", "value")).alias("_v"))
    every = systems.select("system").distinct().crossJoin(metrics.select("metric", "label").distinct())
    out = every.join(latest, ["system", "metric"], "left").join(partial.select("system", "metric", F.lit(True).alias("_p")).distinct(), ["system", "metric"], "left")
    status = F.when(F.col("_v").isNull(), "missing").when(F.col("_p"), "partial").otherwise("available")
    todo = F.when(status == "missing", "request").when(status == "partial", "clarify").otherwise("")
    return out.select("system", "metric", "label", status.alias("status"), F.coalesce(F.trim("_v.value"), F.lit("")).alias("value"), F.col("_v.year").alias("year"), todo.alias("priority"))


def detail_audit(locations: DataFrame, system: str, fields: list[str]) -> DataFrame:
    """(system, field, filled, total, status): how many of a system's locations have a value in each field, in one pass; 'complete', 'partial' or 'missing'."""
    n = locations.groupBy(system).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(first_text(F.col(f)).isNotNull()).alias(f"_n_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_n_{f}").alias("filled")) for f in fields])
    each = n.select(F.col(system).alias("system"), "total", F.explode(rows).alias("r"))
    return each.select("system", "r.field", "r.filled", "total", F.when(F.col("r.filled") == 0, "missing").when(F.col("r.filled") < F.col("total"), "partial").otherwise("complete").alias("status"))


def filled_headlines(headlines: DataFrame, lines: DataFrame, heads: dict[str, str], ranks: dict[str, int], year: str = "year") -> DataFrame:
    """(year, a column for each head, filled): headlines' rows, and years that only lines have, where a null column takes the best line of its head: (year, head, basis, amount) by the rank of its basis, then the larger amount; filled names the
    columns that were. heads: column to head; ranks: basis to rank, others come last."""
    rank = F.lit(len(ranks))
    for basis, r in ranks.items():
        rank = F.when(F.col("basis") == basis, r).otherwise(rank)
    own = lines.where(F.col("amount").isNotNull() & F.col("head").isin(list(heads.values()))).withColumn("_r", rank)
    best = own.groupBy(F.col(year)).agg(*[F.min_by(F.when(F.col("head") == head, F.col("amount")), F.when(F.col("head") == head, F.struct("_r", (-F.col("amount")).alias("a")))).alias(f"_b_{c}") for c, head in heads.items()])
    both = headlines.select(year, *heads).join(best, year, "full")
    took = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"_b_{c}").isNotNull(), F.lit(c)) for c in heads]))
    return both.select(year, *[F.coalesce(c, f"_b_{c}").alias(c) for c in heads], took.alias("filled"))


def sample_layers(stops: DataFrame, routes: DataFrame, stop_id: list[str], stop_name: list[str], lon: list[str], lat: list[str], route_id: list[str], route_name: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """(stop features, route features) of loose rows: ids and names are the first filled of some columns, coordinates the first numbers on the globe; a stop without an id or a coordinate, or a second one of its id, is left out; so is a route whose
    path, an array of [lon, lat] texts, has fewer than two points on the globe."""
    of = lambda names: [F.col(c) for c in names]
    rows = stops.select(first_text(*of(stop_id)).alias("id"), first_text(*of(stop_name)).alias("name"), first_number(*of(lon), low=-180, high=180).alias("lon"), first_number(*of(lat), low=-90, high=90).alias("lat"))
    points = rows.where("id is not null and lon is not null and lat is not null").groupBy("id").agg(F.min(F.struct("name", "lon", "lat")).alias("_s")).select("id", F.coalesce("_s.name", "id").alias("name"), "_s.lon", "_s.lat")
    pair = lambda p: F.struct(first_number(F.get(p, F.lit(0)), low=-180, high=180).alias("x"), first_number(F.get(p, F.lit(1)), low=-90, high=90).alias("y"))
    line = F.filter(F.transform(path, pair), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    lines = routes.select(first_text(*of(route_id)).alias("id"), first_text(*of(route_name)).alias("name"), line.alias("line")).where((F.size("line") >= 2) & F.col("id").isNotNull())
    return points, lines.select("id", F.coalesce("name", "id").alias("name"), "line")


def station_inventory(stations: DataFrame) -> DataFrame:
    """(code, name, line, connections) of stations (code, name, line, connection, order): one row a code, the first row's name and line, and its connections each once in the order of their first rows. Blank codes and connections are left out."""
    named = stations.where("trim(code) <> ''").withColumn("code", F.upper(F.trim("code")))
    first = named.groupBy("code").agg(F.min(F.struct("order", "name", "line")).alias("_f"))
    links = named.where("trim(connection) <> ''").groupBy("code", F.trim("connection").alias("connection")).agg(F.min("order").alias("order"))
    joined = links.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("order", "connection"))).alias("_c"))
    none = F.array().cast("array<string>")
    return first.join(joined, "code", "left").select("code", "_f.name", "_f.line", F.coalesce(F.transform("_c", lambda c: c["connection"]), none).alias("connections"))


def line_by_distance(points: DataFrame, by: str, start: str = "position") -> DataFrame:
    """(by, path): points (x, y, metres along the line) of each line in order of their distance; equal places count once, points without a distance are left out."""
    rows = points.where("metres is not null and x is not null and y is not null").groupBy(by, "x", "y").agg(F.min("metres").alias("metres"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("metres", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("_p")).select(by, F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))


def geocode_queue(places: DataFrame, known: DataFrame, key: str, address: str) -> DataFrame:
    """(key, query, rows): addresses that no coordinate is known for, each once: of places without lat and lon whose key no row of known has; the query is the address with blanks and commas as one, rows how many places wait for it."""
    asked = places.where("lat is null or lon is null").join(known.select(key).distinct(), key, "left_anti")
    query = F.trim(F.regexp_replace(F.col(address), "[\\s,]+", " "))
    return asked.where(first_text(F.col(address)).isNotNull()).groupBy(query.alias("query")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("rows")).select(key, "query", "rows")


def partial_layer(wards: DataFrame, heat: DataFrame, areas: Column, population: str, suspect_density: float = 200_000.0) -> DataFrame:
    """wards with area_km2 (3 places), density (whole people a km2), heat (2 places, by ward), suspect (a density beyond belief) and vulnerable (in the upper third both of density and of heat, among wards that have them and aren't suspect)."""
    from wardlight.functions import stats

    out = wards.withColumn("area_km2", F.round(areas, 3)).join(heat, "ward", "left").withColumn("heat", F.round("heat", 2))
    density = F.round(coerce.ratio(F.col(population).cast("double"), F.col("area_km2")), 0).cast("long")
    out = out.withColumn("density", density).withColumn("suspect", F.coalesce(F.col("density") > suspect_density, F.lit(False)))
    sound = ~F.col("suspect")
    cuts = [F.percentile(F.when(sound, F.col(c)), 2 / 3).alias(f"_cut_{c}") for c in ("density", "heat")]
    cut = stats.with_totals(out, *cuts)
    high = (F.col("density") >= F.col("_cut_density")) & (F.col("heat") >= F.col("_cut_heat")) & sound
    return cut.withColumn("vulnerable", F.coalesce(high, F.lit(False))).drop("_cut_density", "_cut_heat")

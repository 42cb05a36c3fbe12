"""Queries of the feed builders: the stop times that each makes of the given tables; registered beside those of plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators import feeds
from wardlight.plans.queries import query
from wardlight.plans.views import Views

ARC = "2*6371000e0*atan2(sqrt(a),sqrt(1-a))"
HALF = "pow(sin(radians({b}.y-{a}.y)/2),2)+cos(radians({a}.y))*cos(radians({b}.y))*pow(sin(radians({b}.x-{a}.x)/2),2)"
CLOCK = "printf('%02d:%02d:%02d', ({s})//3600, ({s})%3600//60, ({s})%60)"
#: From q (route, i, stop, x, y) in both directions: seconds at each stop, a stay of {dwell} at those between.
RIDE = f"""n as (select *, lag(stop) over w b from q window w as (partition by route order by i)), k as (select route, row_number() over (partition by route order by i)-1 i, stop, x, y from n where b is null or b<>stop), m as (select route, max(i) m from k group by 1 having count(*)>=2),
    d as (select route, 0 dir, i, stop, x, y from k semi join m using (route) union all select route, 1, m-i, stop, x, y from k join m using (route)),
    h as (select b.route, b.dir, b.i, b.stop, {HALF.format(a="a", b="b")} a from d b left join d a on a.route=b.route and a.dir=b.dir and a.i=b.i-1),
    t as (select route, dir, i, stop, round(sum(coalesce({ARC}*{{detour}}/{{pace}},0)+case when i>1 then {{dwell}} else 0 end) over (partition by route, dir order by i))::bigint s from h)"""
OUT = f"select route||'_'||dir trip_id, i::int stop_sequence, stop::varchar stop_id, {CLOCK.format(s='21600+s')} arrival_time from t"


def _times(feed: dict[str, DataFrame]) -> DataFrame:
    return feed["stop_times"].select("trip_id", "stop_sequence", "stop_id", "arrival_time")


def _stop(v: Views, key: str, name: str) -> DataFrame:
    """(key, name: STOP) of all stops."""
    return v.stops().select(F.col("stop_id").alias(key), F.struct(F.col("stop_id").cast("string").alias("stop_id"), "stop_name", "x", "y").alias(name))


@query("T15_feed_from_ends", "routes stops", f"""
    with e as (select route_id route, route_id%(select count(*) from stops) o, (route_id*7+1)%(select count(*) from stops) z from routes), q as (select route, 0 i, stop_id stop, x, y from e join stops on stop_id=o where z in (select stop_id from stops) union all select route, 1, stop_id, x, y from e join stops on stop_id=z where o in (select stop_id from stops)),
    {RIDE.format(detour="1.3e0", pace="5e0", dwell="0")} {OUT}""")
def _(v):
    n = v.stops().agg(F.count(F.lit(1)).alias("n"))
    ends = v.routes().join(F.broadcast(n)).select("route_id", "route_name", (F.col("route_id") % F.col("n")).alias("o"), ((F.col("route_id") * 7 + 1) % F.col("n")).alias("z"))
    return _times(feeds.from_ends(ends.join(_stop(v, "o", "origin"), "o").join(_stop(v, "z", "destination"), "z").select("route_id", "route_name", "origin", "destination")))


LISTED = "select l_orderkey route, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) i, l_suppkey stop, x, y from lineitem join stops on stop_id=l_suppkey"


@query("T15_feed_from_relations", "stops", f"with q as ({LISTED} where l_linenumber%4<>0), {RIDE.format(detour='1e0', pace='6e0', dwell='20e0')} {OUT}")
def _(v):
    role = F.when(F.col("l_linenumber") % 4 == 0, "").when(F.col("l_linenumber") % 4 == 1, "stop_entry_only").otherwise("platform")
    members = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", role.alias("role"))))
    relations = v.table("lineitem").groupBy(F.col("l_orderkey").alias("route_id")).agg(members.alias("m")).select("route_id", F.lit("line").alias("route_name"), F.transform("m", lambda m: F.struct(m["l_suppkey"].alias("ref"), m["role"].alias("role"))).alias("members"))
    return _times(feeds.from_relations(relations, v.stops().select(F.col("stop_id").alias("ref"), F.col("stop_name").alias("name"), "x", "y")))


@query("T15_feed_from_stop_lists", "stops", f"with q as ({LISTED}), {RIDE.format(detour='1e0', pace='5e0', dwell='15e0')} {OUT}")
def _(v):
    name = F.concat(F.lit(" "), F.upper("stop_name"), F.lit("."))
    rows = v.table("lineitem").join(v.stops().select(F.col("stop_id").alias("l_suppkey"), name.alias("name")), "l_suppkey")
    lists = rows.groupBy(F.col("l_orderkey").alias("route_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "name"))).alias("m"))
    return _times(feeds.from_stop_lists(lists.select("route_id", F.lit("list").alias("route_name"), F.concat(F.array(F.lit("nowhere"), F.lit(None).cast("string")), F.transform("m", lambda m: m["name"])).alias("names")), v.stops()))


@query("T15_feed_from_sightings", "trips stop_times stops", f"""
    with s as (select trip_id, stop_id, stop_sequence*97 sec from stop_times join stops using (stop_id)), n as (select *, lag(stop_id) over (partition by trip_id order by sec, stop_id) b from s), k as (select *, row_number() over (partition by trip_id order by sec, stop_id)-1 i, count(*) over (partition by trip_id) c from n where b is null or b<>stop_id)
    select trip_id::varchar trip_id, i::int stop_sequence, stop_id::varchar stop_id, {CLOCK.format(s='sec::bigint')} arrival_time from k where c>=2""")
def _(v):
    seen = v.stop_times().join(v.trips(), "trip_id").select("trip_id", "route_id", F.lit("seen").alias("route_name"), "stop_id", (F.col("stop_sequence") * 97).alias("second"))
    return _times(feeds.from_sightings(seen, v.stops()))


@query("T15_feed_from_lines", "stops", f"""
    with q as (select s_nationkey route, s_suppkey i, s_suppkey stop, x, y from supplier join stops on stop_id=s_suppkey), {RIDE.format(detour="1e0", pace="9e0", dwell="30e0")}, g as (select n_nationkey route, unnest(range(18000+n_nationkey*60, 18000+n_nationkey*60+7200+1, 1800)) f from nation)
    select route||'_'||dir||'_'||f trip_id, i::int stop_sequence, stop::varchar stop_id, {CLOCK.format(s='f+s')} arrival_time from t join g using (route)""")
def _(v):
    stations = v.table("supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_nationkey").alias("line_id")).join(v.stops(), "stop_id").select("line_id", F.lit("line").alias("line_name"), F.col("stop_id").alias("position"), "stop_id", "stop_name", "x", "y")
    first = 18000 + F.col("n_nationkey") * 60
    service = v.table("nation").select(F.col("n_nationkey").alias("line_id"), first.alias("first"), (first + 7200).alias("last"), F.lit(1800).cast("long").alias("headway"))
    return _times(feeds.from_lines(stations, service))

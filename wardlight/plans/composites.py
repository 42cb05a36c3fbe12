"""Further queries: composites of several operators, feed building and gates, text columns; registered beside those of plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions import coerce, geo, stats
from wardlight.operators import finance, spatial, tables, transit
from wardlight.plans.queries import IN_WARD, query


@query("S6_flag_first", "", "select p_partkey from part order by p_size>25 desc, p_retailprice desc, p_partkey limit 20")
def _(v):
    return v.table("part").orderBy(F.desc(F.col("p_size") > 25), F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey")


@query("X4_exclusion_summary", "", """
    with s as (select s_suppkey, s_nationkey nat, s_acctbal dep, s_suppkey%17 km from supplier), n as (select *, (dep-min(dep) over ())/(max(dep) over ()-min(dep) over ()) nd, (km-min(km) over ())/cast(max(km) over ()-min(km) over () as double) nk from s),
    m as (select median(dep) md, median(km) mk from s), g as (select nat, round(avg(0.5*nd+0.5*nk),6) exclusion, count(*) filter (where dep>=md and km>=mk) locked, count(*) n from n cross join m group by 1)
    select n_name ward, exclusion, coalesce(locked,0) locked, round(locked*100e0/n,4) locked_pct from nation left join g on n_nationkey=nat""")
def _(v):
    s = v.table("supplier").select("s_nationkey", F.col("s_acctbal").alias("dep"), F.pmod("s_suppkey", F.lit(17)).cast("double").alias("km"))
    n = stats.with_totals(stats.min_max(stats.min_max(s, "dep", "nd"), "km", "nk"), F.median("dep").alias("md"), F.median("km").alias("mk"))
    locked = F.count_if((F.col("dep") >= F.col("md")) & (F.col("km") >= F.col("mk")))
    g = n.groupBy("s_nationkey").agg(F.round(F.avg(0.5 * F.col("nd") + 0.5 * F.col("nk")), 6).alias("exclusion"), locked.alias("locked"), F.round(locked * 100.0 / F.count(F.lit(1)), 4).alias("locked_pct"))
    wards = v.table("nation").select(F.col("n_name").alias("ward"), F.col("n_nationkey").alias("s_nationkey"))
    return wards.join(g, "s_nationkey", "left").select("ward", "exclusion", F.coalesce("locked", F.lit(0)).alias("locked"), "locked_pct")


@query("X7_hierarchy_rows", "stops", """
    select c_custkey, x, y, x is not null located, coalesce(nullif(case when c_custkey%4=0 then '' else c_mktsegment end,''),'unlisted') service,
    case when c_acctbal>=5000 then 'central' when c_acctbal>=1000 then 'branch' else 'unit' end as tier, case when c_acctbal>=5000 then 1 when c_acctbal>=1000 then 2 else 3 end as rank from customer left join stops on stop_id=c_custkey""")
def _(v):
    c = v.table("customer").join(v.stops().select(F.col("stop_id").alias("c_custkey"), "x", "y"), "c_custkey", "left")
    b = F.col("c_acctbal")
    service = coerce.first_filled(F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("unlisted"))
    tier = F.when(b >= 5000, "central").when(b >= 1000, "branch").otherwise("unit")
    return c.select("c_custkey", "x", "y", F.col("x").isNotNull().alias("located"), service.alias("service"), tier.alias("tier"), F.when(b >= 5000, 1).when(b >= 1000, 2).otherwise(3).alias("rank"))


@query("X10_metric_comparison", "", """
    with m as (select n_regionkey r, count(*)::double customers, avg(c_acctbal) balance, max(c_acctbal) richest from customer join nation on c_nationkey=n_nationkey group by 1),
    u as (unpivot m on customers, balance, richest into name metric value val)
    select metric, round(max(val) filter (where r=0),4) own, round(max(val) filter (where r=1),4) other, round(max(val) filter (where r=0)/nullif(max(val) filter (where r=1),0),6) ratio from u group by 1""")
def _(v):
    j = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = j.groupBy(F.col("n_regionkey").alias("r")).agg(F.count(F.lit(1)).cast("double").alias("customers"), F.avg("c_acctbal").alias("balance"), F.max("c_acctbal").alias("richest"))
    by_metric = m.unpivot("r", ["customers", "balance", "richest"], "metric", "val").groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("r", "val"))).alias("of"))  # an entry for each region
    own, other = F.try_element_at("of", F.lit(0)), F.try_element_at("of", F.lit(1))
    return by_metric.select("metric", F.round(own, 4).alias("own"), F.round(other, 4).alias("other"), F.round(F.try_divide(own, other), 6).alias("ratio"))


@query("X11_derived_ratios", "budget", """
    with a as (select fy_start, sum(amount) amount, count(distinct ward) wards from budget group by 1), o as (select (year(o_orderdate)-case when month(o_orderdate)<4 then 1 else 0 end)::int fy_start, count(*) n from orders group by 1)
    select fy_start, round(amount/n,4) per_order, round(wards/25e0,4) coverage from a join o using (fy_start)""")
def _(v):
    a = v.budget().groupBy("fy_start").agg(F.sum("amount").alias("amount"), F.count_distinct("ward").alias("wards"))
    o = v.table("orders").groupBy(coerce.fiscal_start(F.to_date("o_orderdate")).alias("fy_start")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(o, "fy_start").select("fy_start", F.round(F.col("amount") / F.col("n"), 4).alias("per_order"), F.round(F.col("wards") / 25.0, 4).alias("coverage"))


@query("X13_resource_jobs", "", """
    with w as (select p_partkey, unnest(string_split(p_name,' ')) f, generate_subscripts(string_split(p_name,' '),1) i from part), k as (select *, row_number() over (partition by p_partkey order by i) r from w where f in ('ring','gear','widget','red'))
    select p_partkey, f as format, p_partkey||'_'||r||'.'||f file from k where r<=2 union all select p_partkey, null, p_partkey||'_package' from part where p_partkey not in (select p_partkey from k)""")
def _(v):
    words = v.table("part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "format")).where(F.col("format").isin("ring", "gear", "widget", "red"))
    jobs = stats.top_per_group(words.withColumn("r", F.row_number().over(stats.Window.partitionBy("p_partkey").orderBy("i"))), ["p_partkey"], [F.col("i")], 2)
    jobs = jobs.select("p_partkey", "format", F.concat(F.col("p_partkey").cast("string"), F.lit("_"), F.col("r").cast("string"), F.lit("."), F.col("format")).alias("file"))
    lacking = tables.missing(v.table("part").select("p_partkey"), words, "p_partkey")
    return jobs.unionByName(lacking.select("p_partkey", F.lit(None).cast("string").alias("format"), F.concat(F.col("p_partkey").cast("string"), F.lit("_package")).alias("file")))


@query("X16_route_classes", "routes trips", """
    select case route_type when 0 then 'tram' when 1 then 'metro' when 2 then 'rail' else 'bus' end as class, count(*) routes, count(t.n) served from routes left join (select route_id, count(*) n from trips group by 1) t using (route_id) group by 1""")
def _(v):
    n = v.trips().groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("route_type")
    kind = F.when(k == 0, "tram").when(k == 1, "metro").when(k == 2, "rail").otherwise("bus")
    return v.routes().join(n, "route_id", "left").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("routes"), F.count("n").alias("served"))


@query("X22_geocode_queue", "stops", "select c_custkey, c_name from customer where c_custkey not in (select stop_id from stops where stop_id%4<>0)")
def _(v):
    located = v.stops().where(F.pmod("stop_id", F.lit(4)) != 0).select(F.col("stop_id").alias("c_custkey"))
    return tables.missing(v.table("customer").select("c_custkey", "c_name"), located, "c_custkey")


@query("X24_district_counts", "people wards", f"""
    with c as (select w.poly_id, count(p.point_id) n from wards w left join people p on {IN_WARD} group by 1),
    a as (select region, poly_id, (x1-x0)*(y1-y0)*pow(6371000e0*radians(1e0),2)*cos(radians((y0+y0+y1+y1+y0)/5))/1e6 km2 from wards)
    select region, count(*) wards, sum(n)::bigint points, round(sum(km2),4) km2, round(sum(n)/sum(km2),6) density from a join c using (poly_id) group by 1""")
def _(v):
    n = spatial.count_per_polygon(v.people(), v.wards())
    both = v.wards().select("poly_id", "region", (geo.ring_area_m2(F.col("ring")) / 1e6).alias("km2")).join(n, "poly_id")
    return both.groupBy("region").agg(F.count(F.lit(1)).alias("wards"), F.sum("n").alias("points"), F.round(F.sum("km2"), 4).alias("km2"), F.round(F.sum("n") / F.sum("km2"), 6).alias("density"))


@query("X25_canonical_names", "", "select p_partkey, coalesce(nullif(trim(case when p_size%3=0 then '  ' else p_brand end),''), nullif(case when p_size%2=0 then '' else p_type end,''), 'Unnamed '||p_partkey) as name from part")
def _(v):
    first = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.trim("p_brand"))
    second = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))
    return v.table("part").select("p_partkey", coerce.first_filled(first, second, F.concat(F.lit("Unnamed "), F.col("p_partkey").cast("string"))).alias("name"))


@query("X29_real_multiple", "budget", """
    with t as (select ward, fy_start, sum(amount) a from budget group by 1,2), r as (select *, a*(100+5*(2001-1990))/(100e0+5*(fy_start-1990)) as real from t)
    select ward, round(arg_max(a,fy_start)/arg_min(a,fy_start),6) nominal, round(arg_max(real,fy_start)/arg_min(real,fy_start),6) as real from r group by 1""")
def _(v):
    t = v.budget().groupBy("ward", "fy_start").agg(F.sum("amount").alias("amount"))
    index = v.spark.range(1980, 2030).select(F.col("id").cast("int").alias("fy_start"), (100.0 + 5 * (F.col("id") - 1990)).alias("index_value"))
    over = lambda c: F.round(F.max_by(c, "fy_start") / F.min_by(c, "fy_start"), 6)
    return finance.deflate(t, index, 2001).groupBy("ward").agg(over("amount").alias("nominal"), over("real").alias("real"))


@query("X30_stop_sequences", "", """
    with l as (select l_orderkey trip, l_linenumber i, p_partkey k, p_name as name, case when p_partkey%3<>0 then p_partkey end id from lineitem join part on l_partkey=p_partkey), f as (select trip, name, min(i) i, arg_min({'v': id}, (i, k)).v id from l group by 1,2)
    select trip, coalesce(list(id order by i, name) filter (where id is not null),[]) stops, coalesce(list(name order by i, name) filter (where id is null),[]) unmatched from f group by 1""")
def _(v):
    known = v.table("part").where(F.pmod("p_partkey", F.lit(3)) != 0).select("p_partkey", F.col("p_partkey").alias("id"))
    named = v.table("lineitem").join(v.table("part").select(F.col("p_partkey"), F.col("p_name").alias("name")), F.col("l_partkey") == F.col("p_partkey")).join(known, "p_partkey", "left")
    first = named.groupBy(F.col("l_orderkey").alias("trip"), "name").agg(F.min("l_linenumber").alias("i"), F.min_by(F.struct("id"), F.struct("l_linenumber", "p_partkey")).alias("s"))
    ordered = first.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("i", "name", F.col("s.id").alias("id")))).alias("o"))  # the stops of a trip
    pick = lambda matched, c: F.transform(F.filter("o", lambda x: x["id"].isNotNull() if matched else x["id"].isNull()), lambda x: x[c])
    return ordered.select("trip", pick(True, "id").alias("stops"), pick(False, "name").alias("unmatched"))


@query("X31_feed_status", "routes trips stop_times", """
    with s as (select route_id, count(distinct t.trip_id) trips, count(st.trip_id) events from routes r left join trips t using (route_id) left join stop_times st on st.trip_id=t.trip_id group by 1)
    select agency_id, case when trips=0 then 'missing' when events<20 then 'gated' else 'available' end status, count(*) n from routes join s using (route_id) group by 1,2""")
def _(v):
    e = v.stop_times().groupBy("trip_id").agg(F.count(F.lit(1)).alias("e"))
    s = v.trips().join(e, "trip_id", "left").groupBy("route_id").agg(F.count(F.lit(1)).alias("trips"), F.sum(F.coalesce("e", F.lit(0))).alias("events"))
    status = F.when(F.coalesce("trips", F.lit(0)) == 0, "missing").when(F.col("events") < 20, "gated").otherwise("available")
    return v.routes().join(s, "route_id", "left").groupBy("agency_id", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("X32_longest_runs", "", """
    with l as (select conv_id, turn, regexp_extract_all(text,'[A-Za-z]+(?: [A-Za-z]+)*') r from conversations where not contains(lower(text),'total')), u as (select conv_id, turn, unnest(r) t, generate_subscripts(r,1) i from l)
    select conv_id, turn, arg_max(t,(length(t),-i)) run from u group by 1,2""")
def _(v):
    runs = F.regexp_extract_all("text", F.lit(r"[A-Za-z]+(?: [A-Za-z]+)*"), F.lit(0))
    lines = v.table("conversations").where(~F.contains(F.lower("text"), F.lit("total"))).withColumn("r", runs).where(F.size("r") > 0)
    longest = F.array_max(F.transform("r", lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))
    return lines.select("conv_id", "turn", longest["t"].alias("run"))


EVEN = "e as (select * from wards where poly_id%2=0)"


@query("X34_ward_frequency", "stops stop_times wards", f"""
    with {EVEN}, i as (select p.stop_id, min(w.poly_id) poly_id from stops p join e w on {IN_WARD} group by 1),
    c as (select poly_id, unnest([x0,x1,x1,x0]) vx, unnest([y0,y0,y1,y1]) vy from e),
    d as (select stop_id, poly_id, pow((x-vx)*cos(radians(23.5e0))*111000e0,2)+pow((y-vy)*111000e0,2) d2 from stops join c on abs(x-vx)<0.06 and abs(y-vy)<0.06 where stop_id not in (select stop_id from i)),
    n as (select stop_id, arg_min(poly_id,(round(d2,3),poly_id)) poly_id from d where d2<=2500e0*2500e0 group by 1), a as (select *, true strict from i union all select *, false from n),
    s as (select poly_id, count(*) stops, count(*) filter (where strict) strict_stops, coalesce(sum(k.n),0)::bigint events from a left join (select stop_id, count(*) n from stop_times group by 1) k using (stop_id) group by 1),
    f as (select e.poly_id, coalesce(stops,0) stops, coalesce(strict_stops,0) strict_stops, coalesce(events,0) events from e left join s using (poly_id))
    select *, (least(3,(row_number() over (order by events, poly_id)-1)//greatest(1,count(*) over ()//4))+1)::int quartile from f""")
def _(v):
    """Stop events of wards, stops outside of all wards given to the nearest one within 2,500 m, and the wards' quartiles by events."""
    wards = v.wards().where(F.pmod("poly_id", F.lit(2)) == 0)
    at = transit.ward_stops(v.stops().withColumnRenamed("stop_id", "point_id"), wards, 2500.0, 23.5)
    n = v.stop_times().groupBy(F.col("stop_id").alias("point_id")).agg(F.count(F.lit(1)).alias("n"))
    s = at.join(n, "point_id", "left").groupBy("poly_id").agg(F.count(F.lit(1)).alias("stops"), F.count_if("strict").alias("strict_stops"), F.sum(F.coalesce("n", F.lit(0))).alias("events"))
    full = wards.select("poly_id").join(s, "poly_id", "left").na.fill(0)
    return stats.chunk_quartiles(full, "events", "poly_id").select("poly_id", "stops", "strict_stops", "events", "quartile")


@query("X35_access_rollup", "people libraries stops wards", f"""
    with p as (select w.poly_id, count(p.point_id) people from wards w left join people p on {IN_WARD} group by 1), l as (select w.poly_id, count(p.target_id) libraries from wards w left join libraries p on {IN_WARD} and p.target_id%2=0 group by 1),
    s as (select w.poly_id, count(p.stop_id) stops from wards w left join stops p on {IN_WARD} group by 1),
    n as (select w.poly_id, region, people, coalesce((libraries-min(libraries) over ())/nullif(max(libraries) over ()-min(libraries) over (),0),0) a, coalesce((stops-min(stops) over ())/nullif(max(stops) over ()-min(stops) over (),0),0) b from wards w join p using (poly_id) join l using (poly_id) join s using (poly_id))
    select region, count(*) wards, round(sum((a+b)/2*people)/nullif(sum(people),0),6) access, arg_max(poly_id,(round((a+b)/2,9),-poly_id)) best from n group by 1""")
def _(v):
    """Access of wards as the mean of their scaled libraries and stops, rolled up to regions by people."""
    wards = v.wards()
    libraries = v.libraries().where(F.pmod("target_id", F.lit(2)) == 0).withColumnRenamed("target_id", "point_id")
    n = wards.select("poly_id", "region").join(spatial.count_per_polygon(v.people(), wards, "people"), "poly_id").join(spatial.count_per_polygon(libraries, wards, "libraries"), "poly_id")
    n = n.join(spatial.count_per_polygon(v.stops().withColumnRenamed("stop_id", "point_id"), wards, "stops"), "poly_id")
    n = stats.min_max(stats.min_max(n, "libraries", "a"), "stops", "b").withColumn("access", (F.col("a") + F.col("b")) / 2)
    rolled = F.try_divide(F.sum(F.col("access") * F.col("people")), F.sum("people").cast("double"))
    return n.groupBy("region").agg(F.count(F.lit(1)).alias("wards"), F.round(rolled, 6).alias("access"), F.max_by("poly_id", F.struct(F.round("access", 9), -F.col("poly_id"))).alias("best"))


@query("G9_readiness", "routes trips stop_times", """
    with d as (select trip_id, count(distinct stop_id) d from stop_times group by 1), a as (select agency_id, count(t.trip_id) trips, count(*) filter (where d>=2) usable from routes left join trips t using (route_id) left join d using (trip_id) group by 1)
    select agency_id, trips, usable, case when trips=0 then 'no trips' when usable>=0.9e0*trips then 'ready' when usable>=0.5e0*trips then 'partial' else 'blocked' end readiness from a""")
def _(v):
    d = v.stop_times().groupBy("trip_id").agg(F.count_distinct("stop_id").alias("d"))
    a = v.routes().join(v.trips(), "route_id", "left").join(d, "trip_id", "left").groupBy("agency_id").agg(F.count("trip_id").alias("trips"), F.count_if(F.col("d") >= 2).alias("usable"))
    usable = lambda share: F.col("usable") >= share * F.col("trips")
    return a.withColumn("readiness", F.when(F.col("trips") == 0, "no trips").when(usable(0.9), "ready").when(usable(0.5), "partial").otherwise("blocked"))


@query("SNK5_feed_gates", "routes trips stop_times stops", """
    with r as (select * from routes where route_type<>3), s as (select * from stops where stop_id%5<>0), n as (select trip_id, count(*) n from stop_times group by 1)
    select 'has_routes' gate, (case when exists (select 1 from r) then 0 else 1 end)::bigint bad union all select 'has_trips', (case when exists (select 1 from trips) then 0 else 1 end) union all select 'has_stop_times', (case when exists (select 1 from stop_times) then 0 else 1 end)
    union all select 'has_stops', (case when exists (select 1 from s) then 0 else 1 end) union all select 'short_trips', count(*) from trips left join n using (trip_id) where coalesce(n,0)<2
    union all select 'stop_times_without_stop', count(*) from stop_times where stop_id not in (select stop_id from s) union all select 'stop_times_without_trip', count(*) from stop_times where trip_id not in (select trip_id from trips)
    union all select 'trips_without_route', count(*) from trips where route_id not in (select route_id from r)""")
def _(v):
    return transit.feed_gates({"routes": v.routes().where("route_type <> 3"), "trips": v.trips(), "stop_times": v.stop_times(), "stops": v.stops().where(F.pmod("stop_id", F.lit(5)) != 0)})


@query("J29_assembled_lines", "", """
    with m as (select l_orderkey line, list([l_partkey%10, l_suppkey%10] order by l_linenumber, l_partkey%10, l_suppkey%10) w from lineitem group by 1)
    select line, list_reduce(w, lambda a, x: case when a[-1]=x[1] then list_append(a,x[2]) when a[-1]=x[2] then list_append(a,x[1]) else list_concat(a,x) end) nodes from m""")
def _(v):
    way = F.struct("l_linenumber", F.pmod("l_partkey", F.lit(10)).cast("long").alias("a"), F.pmod("l_suppkey", F.lit(10)).cast("long").alias("b"))
    lines = v.table("lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(F.array_sort(F.collect_list(way)).alias("w"))  # the ways of a line
    return lines.select("line", transit.assembled_line(F.col("w")).alias("nodes"))


@query("T7_labelled_cells", "budget", """
    select section label, round(sum(amount) filter (where fy_start=1995),2) y1995, round(sum(amount) filter (where fy_start=1996),2) y1996, round(sum(amount) filter (where fy_start=1997),2) y1997 from budget where section in ('Brand#11','Brand#12','Brand#55') group by 1""")
def _(v):
    cells = v.budget().where(F.col("section").isin("Brand#11", "Brand#12", "Brand#55"))
    wide = cells.groupBy(F.col("section").alias("label")).pivot("fy_start", [1995, 1996, 1997]).agg(F.round(F.sum("amount"), 2))
    return wide.select("label", *[F.col(str(y)).alias(f"y{y}") for y in (1995, 1996, 1997)])


@query("T12_word_columns", "", """
    with w as (select conv_id, turn, unnest(string_split(text,' ')) w, generate_subscripts(string_split(text,' '),1)-1 i from conversations),
    s as (select conv_id, turn start, lead(turn) over (partition by conv_id order by turn) next_start from conversations where role='user'),
    j as (select w.conv_id, start, turn, i, w, case when i<3 then 'name' when i<6 then 'place' else 'note' end band from w join s on w.conv_id=s.conv_id and turn>=start and (next_start is null or turn<next_start))
    select conv_id, start, string_agg(w,' ' order by turn,i) filter (where band='name') as name, string_agg(w,' ' order by turn,i) filter (where band='place') place, string_agg(w,' ' order by turn,i) filter (where band='note') note from j group by 1,2""")
def _(v):
    """Words by their place on a page: a row begins at each user's turn, and its columns are bands of places in a line."""
    rows = tables.carry_forward(v.table("conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "start").where("start is not null")
    words = rows.select("conv_id", "start", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    band = lambda low, high: F.array_sort(F.collect_list(F.when(F.col("i").between(low, high), F.struct("turn", "i", "w"))))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["w"]), " "))
    grouped = words.groupBy("conv_id", "start").agg(band(0, 2).alias("a"), band(3, 5).alias("b"), band(6, 1 << 30).alias("c"))  # the words of a row
    return grouped.select("conv_id", "start", joined("a").alias("name"), joined("b").alias("place"), joined("c").alias("note"))


@query("T15_feed_builder", "stop_times", """
    with k as (select *, lag(stop_id) over (partition by trip_id order by stop_sequence, stop_id) b from stop_times), q as (select * from k where b is null or b<>stop_id),
    p as (select trip_id, list(stop_id order by stop_sequence, stop_id) s from q group by 1 having count(*)>=2), d as (select trip_id, 0 direction, s from p union all select trip_id, 1, list_reverse(s) from p),
    e as (select trip_id||'_'||direction trip, direction, (generate_subscripts(s,1)-1)::int stop_sequence, unnest(s) stop_id from d)
    select *, printf('%02d:%02d:00', (360+5*stop_sequence)//60, (360+5*stop_sequence)%60) arrival from e""")
def _(v):
    return transit.both_directions(transit.paths(v.stop_times()))

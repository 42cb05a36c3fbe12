"""Queries that put a city's layers, audits and figures together; registered beside those of plans.queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.functions import geo
from wardlight.operators import cities, documents
from wardlight.plans.queries import IN_WARD, query


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


WARDED = """w as (select poly_id, case when poly_id%3=0 then '' else '0'||poly_id end no_a, poly_id||'' no_b, case when poly_id%4=0 then null else 'Zone '||region end zone, case when poly_id%5=0 then 'Own '||name end given, x0, y0, x1, y1 from wards),
    n as (select *, case when no_a<>'' then no_a else no_b end number, ltrim(case when no_a<>'' then no_a else no_b end,'0') k from w), r as (select s_nationkey::varchar num, s_name nm, 'P'||s_suppkey%3 party, s_suppkey%4=0 nophone, s_suppkey from supplier),
    p as (select case when num='0' then '' else num end k, count(*) c, string_agg(nm,'; ' order by nm) names, string_agg(party,'; ' order by nm) parties from r group by 1)"""


def _wards(v):
    k = F.col("poly_id")
    zone = F.when(k % 4 != 0, F.concat(F.lit("Zone "), _text("region")))
    wards = v.wards().select(k, "ring", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("0"), _text(k))).alias("no_a"), _text(k).alias("no_b"), zone.alias("zone"), F.when(k % 5 == 0, F.concat(F.lit("Own "), "name")).alias("Name"))
    s = v.table("supplier")
    roster = s.select(_text("s_nationkey").alias("number"), F.col("s_name").alias("name"), F.concat(F.lit("P"), _text(F.col("s_suppkey") % 3)).alias("party"), F.when(F.col("s_suppkey") % 4 != 0, _text("s_suppkey")).alias("phone"))
    return cities.named_wards(wards, roster.where("number <> '0'"), ["no_a", "no_b"], ["zone"])


@query("X33_named_wards", "wards", f"""with {WARDED} select poly_id, number, coalesce(given, 'Ward '||number||coalesce(' · '||zone,'')) "Name", coalesce(c,0)::int councillor_count, names councillors, parties from n left join p on n.k=p.k and p.k<>''""")
def _(v):
    return _wards(v).select("poly_id", "number", "Name", "councillor_count", "councillors", "parties")


@query("X33_city_summary", "wards", f"""
    with {WARDED}, b as (select min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, count(*) n, count(*) filter (where p.k is not null) s from n left join p on n.k=p.k and p.k<>'')
    select [round(x0,4), round(y0,4), round(x1,4), round(y1,4)] bbox, [round((x0+x1)/2,4), round((y0+y1)/2,4)] centre, 'EPSG:'||(32601+floor(((x0+x1)/2+180)/6)::int) crs, n wards, s staffed, (select count(distinct n_regionkey) from nation join supplier on s_nationkey=n_nationkey) layers,
    (select arg_min(c_name, (case when c_nationkey=7 then 0 else 1 end, c_custkey)) from customer where c_nationkey in (7,8)) commissioner from b""")
def _(v):
    role = F.when(F.col("c_nationkey") == 7, "Municipal Commissioner (acting)").when(F.col("c_nationkey") == 8, "commissioner of police").otherwise(F.lit(None))
    officers = v.table("customer").select(role.alias("role"), F.col("c_name").alias("name"), F.col("c_custkey").alias("position"))
    layers = v.table("nation").join(v.table("supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(_text("n_regionkey").alias("layer")).agg(F.count("s_suppkey").alias("n"))
    return cities.city_summary(_wards(v), officers, layers)


@query("X21_finance_links", "", """
    with c as (select c_custkey//4 id, c_custkey k, c_custkey%4 s, c_nationkey n, 2001+c_custkey//4%20 y from customer)
    select id, printf('%d-%02d', y, (y+1)%100) as year, case s when 0 then 'Budget '||printf('%d-%02d', y, (y+1)%100)||' book' when 1 then 'budget '||printf('%d-%02d', y, (y+1)%100) else 'accounts, budget' end as label,
    case s when 0 then 'https://city.example/docs/b'||k||'.pdf' when 1 then 'https://city.example/viewfile?budget='||printf('%d-%02d', y, (y+1)%100) else 'https://other.example/'||printf('%d-%02d', y, (y+1)%100)||'.PDF' end url from c where s<3""")
def _(v):
    k = F.col("c_custkey")
    y = 2001 + F.floor(k / 4) % 20
    year = F.format_string("%d-%02d", y, (y + 1) % 100)
    link = (
        F.when(k % 4 == 0, F.concat(F.lit('<a href="docs/b'), _text(k), F.lit('.pdf">Budget <b>'), year, F.lit("</b> book</a>")))
        .when(k % 4 == 1, F.concat(F.lit("<p><a href='/viewfile?budget="), year, F.lit("'></a><a href='/viewfile?budget="), year, F.lit("'>again</a>")))
        .when(k % 4 == 2, F.concat(F.lit("<a href='https://other.example/"), year, F.lit(".PDF'>accounts, budget</a>"))).otherwise(F.concat(F.lit("<a href='c.pdf'>Budget of no year</a><a href='x.html'>budget "), year, F.lit("</a>")))
    )
    rows = v.table("customer").select(F.floor(k / 4).alias("page_id"), k.alias("k"), link.alias("link"))
    pages = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "link"))), lambda r: r["link"]), "\n").alias("html")).withColumn("url", F.lit("https://city.example/index.html?x=/1"))
    return documents.finance_links(pages, ["budget"], "budget").withColumnRenamed("page_id", "id")


@query("T19_disclosure_audit", "", """
    with v as (select c_nationkey%5 s, c_mktsegment m, c_custkey y, case when c_acctbal>9000 then round(c_acctbal,2)::varchar when c_custkey%2=0 then ' ' end as val from customer), l as (select s, m, max(y) y, arg_max(val, y) val from v where trim(coalesce(val,''))<>'' group by 1,2),
    e as (select s, m from (select distinct s from v) cross join (select distinct m from v))
    select 's'||e.s as system, e.m as metric, lower(e.m) as label, case when l.y is null then 'missing' when e.s=1 then 'partial' else 'available' end status, coalesce(val,'') as value, y as year, case when l.y is null then 'request' when e.s=1 then 'clarify' else '' end priority from e left join l using (s,m)""")
def _(v):
    c = v.table("customer").withColumn("system", F.concat(F.lit("s"), _text(F.col("c_nationkey") % 5)))
    value = F.when(F.col("c_acctbal") > 9000, F.format_string("%.2f", "c_acctbal").try_cast("double").cast("string")).when(F.col("c_custkey") % 2 == 0, " ")
    values = c.select("system", F.col("c_mktsegment").alias("metric"), F.col("c_custkey").alias("year"), value.alias("value"))
    metrics = c.select(F.col("c_mktsegment").alias("metric"), F.lower("c_mktsegment").alias("label"))
    return cities.disclosure_audit(metrics, c.select("system"), values, metrics.where("true").select(F.lit("s1").alias("system"), "metric"))


@query("T19_detail_audit", "", """
    with l as (select s_nationkey s, case when s_acctbal>0 then s_name end as opening, case when s_suppkey%2=0 then ' ' end as seats, s_suppkey size from supplier), n as (select s, count(*) total, count(opening) opening, 0::bigint seats, count(size) size from l group by 1)
    select s as system, f as field, x as filled, total, case when x=0 then 'missing' when x<total then 'partial' else 'complete' end status from (unpivot n on opening, seats, size into name f value x)""")
def _(v):
    rows = v.table("supplier").select("s_nationkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("opening"), F.when(F.col("s_suppkey") % 2 == 0, " ").alias("seats"), F.col("s_suppkey").alias("size"))
    return cities.detail_audit(rows, "s_nationkey", ["opening", "seats", "size"])


@query("X6_filled_headlines", "budget", """
    with t as (select fy_start y, section h, basis b, round(sum(amount),2) a from budget where section in ('Brand#11','Brand#12') group by 1,2,3), o as (select distinct fy_start y, case when fy_start%2=0 then 1e0 end works from budget where fy_start%3<>0),
    r as (select *, row_number() over (partition by y, h order by case b when 'A' then 0 when 'R' then 1 else 2 end, -a) r from t), p as (select y, max(a) filter (where h='Brand#11') w, max(a) filter (where h='Brand#12') g from r where r=1 group by 1)
    select coalesce(o.y,p.y) as year, coalesce(works,w) works, g grants, list_concat(case when works is null and w is not null then ['works'] else [] end, case when g is not null then ['grants'] else [] end) filled from o full join p using (y)""")
def _(v):
    lines = v.budget().where("section in ('Brand#11', 'Brand#12')").groupBy(F.col("fy_start").alias("year"), F.col("section").alias("head"), "basis").agg(F.round(F.sum("amount"), 2).alias("amount"))
    own = v.budget().where("fy_start % 3 <> 0").select(F.col("fy_start").alias("year")).distinct().select("year", F.when(F.col("year") % 2 == 0, 1.0).alias("works"), F.lit(None).cast("double").alias("grants"))
    return cities.filled_headlines(own, lines, {"works": "Brand#11", "grants": "Brand#12"}, {"A": 0, "R": 1})


@query("X36_sample_stops", "stops", """
    with s as (select stop_id%(select count(*)*3//4+1 from stops) k, stop_id, case when stop_id%3=0 then ' ' else stop_name end nm, case when stop_id%5=0 then null else x end lon, y lat from stops),
    u as (select k, nm, lon, lat, row_number() over (partition by k order by nullif(trim(nm),'') nulls first, lon, lat) r from (select k, nm, coalesce(lon, case when stop_id%10=0 then 500e0 else x2 end) lon, lat, stop_id from (select *, 70+stop_id%9/10e0 x2 from s)) where lon between -180 and 180)
    select k::varchar id, coalesce(nullif(trim(nm),''), k::varchar) as name, round(lon,6) lon, round(lat,6) lat from u where r=1""")
def _(v):
    n = v.stops().agg((F.floor(F.count(F.lit(1)) * 3 / 4) + 1).alias("n"))
    k = F.col("stop_id")
    rows = v.stops().join(F.broadcast(n)).select(F.lit(" ").alias("code"), _text(k % F.col("n")).alias("id"), F.when(k % 3 == 0, " ").otherwise(F.col("stop_name")).alias("name"), F.when(k % 5 != 0, _text("x")).otherwise("n/a").alias("lon"), F.when(k % 10 == 0, "500").otherwise(_text(70 + k % 9 / 10.0)).alias("longitude"), _text("y").alias("lat"))
    stops, _ = cities.sample_layers(rows, v.routes().select(_text("route_id").alias("id"), F.lit(None).cast("array<array<string>>").alias("path")), ["code", "id"], ["name"], ["lon", "longitude"], ["lat"], ["id"], ["id"], "path")
    return stops.select("id", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("X17_station_inventory", "", """
    with s as (select 'P'||l_partkey%300 code, case when l_suppkey%4=0 then ' ' else 'L'||l_suppkey%6 end c, l_orderkey*10+l_linenumber o, l_returnflag ln from lineitem), f as (select code, min(o) o from s group by 1), g as (select code, c, min(o) o from s where trim(c)<>'' group by 1,2),
    m as (select s.code, min(ln) ln from s join f on s.code=f.code and s.o=f.o group by 1) select m.code, m.ln line, coalesce((select list(c order by o, c) from g where g.code=m.code),[]) connections from m""")
def _(v):
    rows = v.table("lineitem").select(F.concat(F.lit(" p"), _text(F.col("l_partkey") % 300)).alias("code"), F.lit("x").alias("name"), F.col("l_returnflag").alias("line"), F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(F.concat(F.lit("L"), _text(F.col("l_suppkey") % 6))).alias("connection"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order"))
    return cities.station_inventory(rows).select("code", "line", "connections")


@query("X22_geocode_queries", "stops", """
    with p as (select c_custkey k, c_nationkey n, c_name||' ,  '||case when c_nationkey%2=0 then 'North' else 'South' end a, x from customer left join stops on stop_id=c_custkey), q as (select n::varchar n, 'Place '||(k%200)||' '||case when n%2=0 then 'North' else 'South' end q from p where x is null and n%5<>0)
    select min(n) as key, q as query, count(*) as rows from q group by q""")
def _(v):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    address = F.concat(F.lit(" Place "), _text(k % 200), F.lit(" ,  "), F.when(n % 2 == 0, "North").otherwise("South"))
    places = v.table("customer").join(v.stops().select(F.col("stop_id").alias("c_custkey"), F.col("x").alias("lon"), F.col("y").alias("lat")), "c_custkey", "left").select(_text("c_nationkey").alias("key"), address.alias("address"), "lat", "lon")
    known = v.table("nation").where("n_nationkey % 5 = 0").select(_text("n_nationkey").alias("key"))
    return cities.geocode_queue(places, known, "key", "address")


@query("X12_partial_layer_analysis", "people wards", f"""
    with n as (select w.poly_id ward, count(p.point_id)*1000 people, round(0.2e0*0.2e0*pow(6371e0*radians(1e0),2)*cos(radians((y0+y0+y1+y1+y0)/5)),3) km2 from wards w left join people p on {IN_WARD} group by 1, y0, y1),
    h as (select s_nationkey ward, round(30+avg(s_acctbal)/1000,2) heat from supplier where s_nationkey%6<>0 group by 1), d as (select n.ward, km2 area_km2, round(people/km2)::bigint density, heat, round(people/km2)>400 suspect from n left join h using (ward)),
    c as (select quantile_cont(density,2/3e0) filter (where not suspect) a, quantile_cont(heat,2/3e0) filter (where not suspect) b from d) select ward, area_km2, density, heat, suspect, coalesce(density>=a and heat>=b and not suspect,false) vulnerable from d cross join c""")
def _(v):
    from wardlight.operators import spatial

    wards = v.wards()
    people = spatial.count_per_polygon(v.people(), wards, "n").select("poly_id", (F.col("n") * 1000).alias("people"))
    own = wards.join(people, "poly_id").select(F.col("poly_id").alias("ward"), "ring", "people")
    heat = v.table("supplier").where("s_nationkey % 6 <> 0").groupBy(F.col("s_nationkey").alias("ward")).agg((30 + F.avg("s_acctbal") / 1000).alias("heat"))
    found = cities.partial_layer(own, heat, geo.ring_area_m2(F.col("ring")) / 1e6, "people", 400.0)
    return found.select("ward", "area_km2", "density", "heat", "suspect", "vulnerable")

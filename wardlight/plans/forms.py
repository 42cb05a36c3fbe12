"""Queries of the operators that read cells in several forms; registered beside those of plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions import coerce, forms, geo
from wardlight.operators import transit
from wardlight.plans.queries import query


@query("F15_year_forms", "", """
    with t as (select p_partkey, p_partkey%6 k, 2005+p_size%20 y from part),
    l as (select *, printf('%d-%02d', y, (y+1)%100) fy, printf('%d-%02d', y+1, (y+2)%100) later from t)
    select p_partkey, case k when 0 then fy when 1 then fy when 2 then '2031-03' when 3 then fy end in_file_name,
    case k when 0 then fy when 1 then fy when 2 then fy when 3 then fy when 4 then printf('%d-20', y) end in_link,
    case k when 0 then fy when 3 then later else '' end estimate, case k when 0 then fy when 3 then fy when 4 then fy when 5 then fy end written_out,
    case k when 0 then fy when 1 then case when y>=2010 then fy end when 3 then fy end earliest from l""")
def _(v):
    k, y = F.pmod("p_partkey", F.lit(6)), F.lit(2005) + F.pmod("p_size", F.lit(20))
    two = lambda n: F.format_string("%02d", F.pmod(y + n, F.lit(100)))
    four = lambda n: (y + n).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Book "), four(0), F.lit("-"), two(1), F.lit(" final"))).when(k == 1, F.concat(F.lit("Book "), two(0), F.lit("-"), two(1)))
        .when(k == 2, F.concat(F.lit("Balance 31-03-"), four(1))).when(k == 3, F.concat(F.lit("RBE_"), four(0), F.lit("-"), two(1), F.lit(" BE_"), two(1), F.lit("-"), two(2)))
        .when(k == 4, F.concat(F.lit("Report "), four(0), F.lit(" - "), four(1))).otherwise(F.concat(F.lit("Set "), four(0), two(1), F.lit(" x")))
    )
    t = v.table("part").select("p_partkey", text.alias("text"))
    return t.select(
        "p_partkey", forms.year_of_file_name(F.col("text")).alias("in_file_name"), forms.year_of_link(F.col("text")).alias("in_link"), forms.year_of_estimate(F.col("text")).alias("estimate"),
        forms.year_written_out(F.col("text")).alias("written_out"), forms.earliest_year(F.col("text")).alias("earliest"),
    )


@query("F20_name_forms", "", r"""
    with t as (select p_partkey, replace(replace(p_name,'e','é'),'a','Ā')||case when p_partkey%3=0 then ' Rd Stn' when p_partkey%3=1 then ' & Railway Halt' else ' Jn' end s, '0'||p_size||' '||p_brand||case when p_partkey%2=0 then ' Ward' else '' end w from part)
    select p_partkey, trim(regexp_replace(regexp_replace(lower(strip_accents(s)),'\b(railway|station|halt|junction|jn|road|rd)\b',' ','g'),'[^a-z0-9]+',' ','g')) plain,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(s),'&',' and '),'\bstn\b','station','g'),'\brd\b','road','g'),'\bjn\b','junction','g'),'[^a-z0-9]+',' ','g')) expanded,
    regexp_extract(w,'^0*(\d+) ',1) number, regexp_replace(regexp_replace(lower(w),' ward$',''),'[^a-z]','','g') as key from t""")
def _(v):
    p = F.col("p_partkey")
    end = F.when(p % 3 == 0, " Rd Stn").when(p % 3 == 1, " & Railway Halt").otherwise(" Jn")
    s = F.concat(F.regexp_replace(F.regexp_replace("p_name", "e", "é"), "a", "Ā"), end)
    w = F.concat(F.lit("0"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand"), F.when(p % 2 == 0, " Ward").otherwise(""))
    n = forms.numbered_name(w)
    return v.table("part").select("p_partkey", forms.key_without(s).alias("plain"), forms.key_expanded(s).alias("expanded"), n["number"].alias("number"), n["key"].alias("key"))


@query("F25_feed_fields", "", r"""
    with t as (select o_orderkey, o_orderkey%5 k, strftime(o_orderdate::date,'%Y%m%d') d, (o_orderkey%30)||':'||printf('%02d',(o_orderkey%70)::int)||':00' c, o_custkey/10e0-150 lon, o_custkey/10e0-60 lat from orders)
    select o_orderkey, try_strptime(case k when 0 then left(d,6)||'32' when 1 then left(d,4)||'-'||right(d,2) else d end,'%Y%m%d') is not null and k<>1 day_ok, o_orderkey%70<60 clock_ok,
    o_orderkey%30 between 1 and 12 route_type_ok, lon between -180 and 180 lon_ok, k<>3 and lon between -180 and 180 and lat between -90 and 90 points_ok from t""")
def _(v):
    k, key = F.pmod("o_orderkey", F.lit(5)), F.col("o_orderkey")
    d = F.date_format("o_orderdate", "yyyyMMdd")
    day = F.when(k == 0, F.concat(F.substring(d, 1, 6), F.lit("32"))).when(k == 1, F.concat(F.substring(d, 1, 4), F.lit("-"), F.right(d, F.lit(2)))).otherwise(d)
    clock = F.concat((key % 30).cast("string"), F.lit(":"), F.format_string("%02d", key % 70), F.lit(":00"))
    lon, lat = F.col("o_custkey") / 10.0 - 150, F.col("o_custkey") / 10.0 - 60
    points = F.when(k == 3, F.array().cast("array<array<double>>")).otherwise(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(lon, lat)))
    return v.table("orders").select(
        "o_orderkey", forms.is_day(day).alias("day_ok"), forms.is_clock(clock).alias("clock_ok"), forms.is_whole((key % 30).cast("string"), 1, 12).alias("route_type_ok"),
        forms.is_number(lon.cast("string"), -180, 180).alias("lon_ok"), forms.are_points(points).alias("points_ok"),
    )


@query("F12_heat_colours", "", """
    with t as (select p_partkey, case when p_size%10=0 then null else 20+p_partkey%71/2e0 end v from part), s as (select * from (values (30,0,80,30),(33,120,180,40),(36,240,230,40),(39,245,150,30),(42,225,50,30),(45,150,15,20),(48,90,0,25)) s(x,r,g,b)),
    c as (select p_partkey, v, greatest(30,least(48,coalesce(v,30))) x from t), e as (select a.x x0, b.x x1, a.r r0, b.r r1, a.g g0, b.g g1, a.b b0, b.b b1 from s a join s b on b.x=a.x+3)
    select p_partkey, floor(r0+(c.x-x0)*(r1-r0)/3e0+1e-9)::int red, floor(g0+(c.x-x0)*(g1-g0)/3e0+1e-9)::int green, floor(b0+(c.x-x0)*(b1-b0)/3e0+1e-9)::int blue, case when v is null then 0 else 220 end alpha
    from c join e on (c.x>x0 or c.x=30 and x0=30) and c.x<=x1""")
def _(v):
    value = F.when(F.col("p_size") % 10 != 0, 20 + F.col("p_partkey") % 71 / 2.0)
    return v.table("part").select("p_partkey", forms.colour(value).alias("c")).select("p_partkey", "c.*")


@query("F2_areas_with_holes", "wards", """
    with a as (select poly_id, pow(6371000e0*radians(1e0),2)/1e6 u, (x1-x0)*(y1-y0)*cos(radians((y0+y0+y1+y1+y0)/5)) whole, 0.01e0*cos(radians(y0+0.09e0)) hole from wards)
    select poly_id, round(u*(whole-hole),6) km2 from a""")
def _(v):
    a = F.get(F.col("ring"), F.lit(0))
    hole = geo.rectangle(a["x"] + 0.05, a["y"] + 0.05, a["x"] + 0.15, a["y"] + 0.15)
    return v.wards().select("poly_id", F.round(geo.polygon_area_m2(F.array("ring", hole)) / 1e6, 6).alias("km2"))


@query("P6_keyword_classes", "", """
    with t as (select p_partkey, lower(p_name||' '||p_type||' '||p_brand) s from part)
    select p_partkey, case when contains(s,'ring') or contains(s,'gear') then 'moving' when contains(s,'widget') then 'fixed' when contains(s,'small') or contains(s,'mini') then 'small' else 'other' end as class from t""")
def _(v):
    classes = {"moving": "ring|gear", "fixed": "widget", "small": "small|mini"}
    return v.table("part").select("p_partkey", forms.first_class(F.concat_ws(" ", "p_name", "p_type", "p_brand"), classes, "other").alias("class"))


@query("F8_rates_of_year", "", """
    with r as (select n_nationkey, y::int y, 10+n_nationkey+(y-1990)*0.5e0 rate from nation, range(1990,2005) t(y) where n_nationkey%4<>1),
    c as (select n_nationkey, count(*) people from nation join customer on c_nationkey=n_nationkey group by 1),
    s as (select c_nationkey n_nationkey, year(o_orderdate)::int y, sum(o_totalprice) spent from orders join customer on o_custkey=c_custkey group by 1,2)
    select n_nationkey nation, y as year, round(spent/rate,4) converted, round(spent/rate/people,6) per_person from s left join r using (n_nationkey,y) left join c using (n_nationkey)""")
def _(v):
    years = v.spark.range(1990, 2005).select(F.col("id").cast("int").alias("year"))  # fifteen rows
    nations = v.table("nation").select(F.col("n_nationkey").alias("nation"))
    rates = nations.where("nation % 4 <> 1").crossJoin(years).select("nation", "year", (10 + F.col("nation") + (F.col("year") - 1990) * 0.5).alias("rate"))
    customers = v.table("customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    people = customers.groupBy("nation").agg(F.count(F.lit(1)).alias("people"))
    spent = v.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("spent"))
    converted = coerce.ratio(F.col("spent"), F.col("rate"))
    return spent.join(rates, ["nation", "year"], "left").join(people, "nation", "left").select("nation", "year", F.round(converted, 4).alias("converted"), F.round(coerce.ratio(converted, F.col("people")), 6).alias("per_person"))


@query("J6_code_or_contained_name", "", """
    with q as (select s_suppkey id, case when s_suppkey%3=0 then ' n'||s_nationkey||' ' end code, case s_suppkey%4 when 0 then 'old '||lower(n_name)||' north' when 1 then lower(left(n_name,7+s_nationkey%2)) when 2 then lower(n_name) else 'elsewhere' end nm from supplier join nation on s_nationkey=n_nationkey),
    s as (select n_nationkey station, case when n_nationkey%2=0 then 'N'||n_nationkey end code, lower(n_name) nm from nation)
    select id, coalesce(any_value(c.station), min(s.station)) station, case when any_value(c.station) is not null then 'code' when min(s.station) is not null then 'name' end as by
    from q left join s c on c.code=upper(trim(q.code)) left join s on contains(q.nm,s.nm) or contains(s.nm,q.nm) group by 1""")
def _(v):
    nations = v.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("known"))
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey")
    name = F.when(k == 0, F.concat(F.lit("old "), F.col("known"), F.lit(" north"))).when(k == 1, F.left("known", 7 + n % 2)).when(k == 2, F.col("known")).otherwise("elsewhere")
    code = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" n"), n.cast("string"), F.lit(" ")))
    rows = v.table("supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("id"), code.alias("code"), name.alias("name"))
    stations = nations.select(F.col("s_nationkey").alias("station"), F.when(n % 2 == 0, F.concat(F.lit("N"), n.cast("string"))).alias("code"), F.col("known").alias("name"), F.col("s_nationkey").alias("position"))
    return transit.code_or_name(rows, stations)

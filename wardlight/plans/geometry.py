"""Queries on general polygons and paths; registered beside those of plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions import geo, shapes
from wardlight.operators import polygons, transit
from wardlight.plans.queries import query
from wardlight.plans.views import Views

#: Suppliers' lots: by turns a square, an L (a square without its upper right corner) and a frame (a square with a hole); as boxes that count or are taken off.
LOTS = """lots as (select s_suppkey id, s_nationkey nation, s_suppkey%3 kind, 72+(s_suppkey*7919%900)/1000e0 x0, 23+(s_suppkey*104729%900)/1000e0 y0 from supplier),
    lot_parts as (select id, 1e0 s, x0, y0, x0+0.09e0 x1, y0+0.09e0 y1 from lots union all select id, -1e0, x0+0.04e0, y0+0.04e0, x0+0.09e0, y0+0.09e0 from lots where kind=1
    union all select id, -1e0, x0+0.03e0, y0+0.03e0, x0+0.06e0, y0+0.06e0 from lots where kind=2)"""
#: Lots and yards that share no more only touch.
TOUCH = 1e-10
#: Wards, those of odd number with a hole.
YARDS = """yard_parts as (select poly_id id, 1e0 s, x0, y0, x1, y1 from wards union all select poly_id, -1e0, x0+0.05e0, y0+0.05e0, x0+0.12e0, y0+0.12e0 from wards where poly_id%2=1)"""
SHARED = f"""{LOTS}, {YARDS}, o as (select a.id a_id, b.id b_id, sum(a.s*b.s*greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0))) ov from lot_parts a join yard_parts b on a.x0<b.x1 and b.x0<a.x1 group by 1,2),
    sizes as (select id, sum(s*(x1-x0)*(y1-y0)) size from lot_parts group by 1)"""


def lots(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = 72 + F.pmod(k * 7919, F.lit(900)) / 1000.0, 23 + F.pmod(k * 104729, F.lit(900)) / 1000.0
    ring = lambda *at: F.array(*[shapes.point(x + dx, y + dy) for dx, dy in (*at, at[0])])
    square = ring((0.0, 0.0), (0.09, 0.0), (0.09, 0.09), (0.0, 0.09))
    corner = ring((0.0, 0.0), (0.09, 0.0), (0.09, 0.04), (0.04, 0.04), (0.04, 0.09), (0.0, 0.09))
    hole = ring((0.03, 0.03), (0.06, 0.03), (0.06, 0.06), (0.03, 0.06))
    rings = F.when(k % 3 == 0, F.array(square)).when(k % 3 == 1, F.array(corner)).otherwise(F.array(square, hole))
    return v.table("supplier").select(k.alias("id"), F.col("s_nationkey").alias("nation"), rings.alias("rings"))


def yards(v: Views) -> DataFrame:
    a = F.get("ring", F.lit(0))
    hole = geo.rectangle(a["x"] + 0.05, a["y"] + 0.05, a["x"] + 0.12, a["y"] + 0.12)
    return v.wards().select(F.col("poly_id").alias("id"), "ordinal", "name", F.when(F.col("poly_id") % 2 == 1, F.array("ring", hole)).otherwise(F.array("ring")).alias("rings"))


@query("J19_polygon_overlaps", "wards", f"with {SHARED} select a_id, b_id, round(ov,9) overlap, round(ov/size,6) share_of_a from o join sizes on id=a_id where ov>1e-10 and not (ov<0.0001e0 and round(ov/size,6)<0.01)")
def _(v):
    o = polygons.overlaps(lots(v), yards(v), least_area=TOUCH).withColumn("share_of_a", F.round("share_of_a", 6))
    return polygons.above_threshold(o, 0.0001, 0.01).select("a_id", "b_id", F.round("overlap", 9).alias("overlap"), "share_of_a")


@query("J20_polygon_overlay", "wards", f"with {SHARED}, w as (select a_id, sum(ov*b_id)/sum(ov) mean, max(b_id) most from o where ov>1e-10 group by 1) select id, round(mean,5) mean, most from lots left join w on id=a_id")
def _(v):
    valued = yards(v).withColumn("value", F.col("id"))
    return polygons.overlay_weighted(lots(v), valued, "value", TOUCH).select("id", F.round("mean", 5).alias("mean"), "most")


@query("J21_best_overlap_or_fallback", "wards", f"""with {SHARED}, b as (select a_id, arg_min(b_id, (-round(ov,9), b_id)) b_id from o where ov>1e-10 group by 1)
    select l.id, case when b_id is null or b_id%4=2 then 'lot '||l.id else n_name end as name from lots l left join b on l.id=a_id left join nation on n_nationkey=b_id""")
def _(v):
    named = yards(v).withColumn("name", F.when(F.col("id") % 4 == 2, "  ").otherwise(F.col("name")))
    own = lots(v).withColumn("fallback", F.concat(F.lit("lot "), F.col("id").cast("string")))
    return polygons.best_overlap(own, named, "name", "fallback", places=9, least_area=TOUCH)


@query("J22_parents_of_named_siblings", "", """
    with p as (select s_suppkey id, s_nationkey g, s_suppkey%3=2 frame, case when s_suppkey%10=0 then 0.3e0 else 0.06e0 end w, 72+(s_suppkey*7919%900)/1000e0 x, 23+(s_suppkey*104729%900)/1000e0 y, 'a'||s_suppkey%50 nm from supplier)
    select a.id, count(*) n from p a join p b on a.g=b.g and a.nm<>b.nm and b.x+b.w/2-a.x>=0 and b.x+b.w/2-a.x<a.w and b.y+b.w/2-a.y>=0 and b.y+b.w/2-a.y<a.w
    and not (a.frame and b.x+b.w/2-a.x>=a.w/3 and b.x+b.w/2-a.x<a.w*2/3 and b.y+b.w/2-a.y>=a.w/3 and b.y+b.w/2-a.y<a.w*2/3) group by 1 having count(*)>=2""")
def _(v):
    k = F.col("s_suppkey")
    x, y, w = 72 + F.pmod(k * 7919, F.lit(900)) / 1000.0, 23 + F.pmod(k * 104729, F.lit(900)) / 1000.0, F.when(k % 10 == 0, 0.3).otherwise(0.06)
    outline, hole = geo.rectangle(F.lit(0.0), F.lit(0.0), w, w), geo.rectangle(w / 3, w / 3, w * 2 / 3, w * 2 / 3)
    own = v.table("supplier").select(k.alias("id"), F.col("s_nationkey").alias("nation"), F.concat(F.lit("a"), (k % 50).cast("string")).alias("name"), F.when(k % 3 == 2, F.array(outline, hole)).otherwise(F.array(outline)).alias("rings"), shapes.point(x, y).alias("corner"))
    return polygons.holding_siblings(own, "nation", "name", origin="corner")


@query("A37_dissolved_nations", "", """
    with c as (select c_custkey//64 r, c_custkey%64 c, c_nationkey%3 k from customer), n as (select k, count(*) n from c group by 1),
    p as (select a.k, count(*) p from c a join c b on a.k=b.k and (a.r=b.r and b.c=a.c+1 or a.c=b.c and b.r=a.r+1) group by 1)
    select n.k as nation, n::double area, (4*n-2*coalesce(p,0))::double perimeter from n left join p using (k)""")
def _(v):
    k = F.col("c_custkey")
    x, y = F.pmod(k, F.lit(64)), F.floor(k / 64)
    cells = v.table("customer").select((F.col("c_nationkey") % 3).alias("nation"), F.array(geo.rectangle(x, y, x + 1, y + 1)).alias("rings"))
    rings = polygons.dissolve(cells, "nation")
    sizes = rings.select("nation", geo.signed_area(F.col("ring")).alias("a"), shapes.length(F.col("ring")).alias("l"))
    return sizes.groupBy("nation").agg(F.sum("a").alias("area"), F.sum("l").alias("perimeter"))


@query("A38_disc_cover")
def _(v):
    points = v.libraries().select("x", "y")
    return polygons.disc_cover(points, 0.03, yards(v)).select("id", F.round("area", 9).alias("area"), F.round("covered", 9).alias("covered"), F.round("share", 7).alias("share"))


#: A trip's shape is the way through its stops.
SHAPED = "sp as (select trip_id, stop_sequence, x, y, lead(x) over w x2, lead(y) over w y2, row_number() over w n from stop_times join stops using (stop_id) window w as (partition by trip_id order by stop_sequence, x, y))"


def feed(v: Views) -> tuple[dict[str, DataFrame], DataFrame]:
    points = v.stop_times().join(v.stops().select("stop_id", "x", "y"), "stop_id").select(F.col("trip_id").alias("shape_id"), F.col("stop_sequence").alias("sequence"), "x", "y")
    trips = v.trips().withColumn("shape_id", F.col("trip_id"))
    return {"routes": v.routes(), "trips": trips, "stop_times": v.stop_times(), "stops": v.stops()}, transit.shape_paths(points)


@query("W11_T16_longest_shapes", "routes trips stop_times stops", f"""
    with {SHAPED}, h as (select trip_id, pow(sin(radians(y2-y)/2),2)+cos(radians(y))*cos(radians(y2))*pow(sin(radians(x2-x)/2),2) a from sp where x2 is not null),
    l as (select trip_id, round(sum(2*6371000e0*atan2(sqrt(a),sqrt(1-a))),3) m from h group by 1), r as (select route_id, trip_id, m, row_number() over (partition by route_id order by m desc, trip_id) r from trips join l using (trip_id)),
    c as (select trip_id, count(*) n from stop_times join stops using (stop_id) group by 1)
    select route_id, agency_id, trip_id, round(m,1) metres, n::int points from r join c using (trip_id) join routes using (route_id) where r=1""")
def _(v):
    tables, shaped = feed(v)
    best = transit.longest_shape(tables["trips"], shaped)
    return best.join(tables["routes"].select("route_id", "agency_id"), "route_id").select("route_id", "agency_id", "trip_id", F.round("metres", 1).alias("metres"), F.size("path").alias("points"))


@query("X18_city_lines", "routes trips stop_times stops", f"""
    with {SHAPED}, d as (select *, x2-x dx, y2-y dy from sp), t as (select *, greatest(0,coalesce(least((72.1-x)/nullif(dx,0),(72.6-x)/nullif(dx,0)),0),coalesce(least((23.1-y)/nullif(dy,0),(23.6-y)/nullif(dy,0)),0)) t0,
    least(1,coalesce(greatest((72.1-x)/nullif(dx,0),(72.6-x)/nullif(dx,0)),1),coalesce(greatest((23.1-y)/nullif(dy,0),(23.6-y)/nullif(dy,0)),1)) t1, dx=0 and (x<72.1 or x>72.6) or dy=0 and (y<23.1 or y>23.6) as out from d where x2 is not null and (dx<>0 or dy<>0)),
    u as (select *, t0<t1 and not out as within, lag(t0<t1 and not out and t1=1) over (partition by trip_id order by n) joined from t),
    g as (select trip_id, count(*) filter (where within and not (coalesce(joined,false) and t0=0)) pieces, sum(case when within then (t1-t0)*sqrt(dx*dx+dy*dy) else 0 end) len from u group by 1),
    i as (select trip_id, count(*) filter (where x between 72.1 and 72.6 and y between 23.1 and 23.6) hits, count(*) c from sp group by 1),
    k as (select route_id, min(trip_id) trip_id from trips join i using (trip_id) join routes using (route_id) where hits>=2 and (contains(agency_id,'BUILD') or contains(agency_id,'MACH')) group by 1)
    select route_id, trip_id, hits, hits::int points, coalesce(pieces,0)::int pieces, round(coalesce(len,0),6) length from k join i using (trip_id) left join g using (trip_id)""")
def _(v):
    tables, shaped = feed(v)
    lines = transit.city_lines(tables, shaped, (72.1, 23.1, 72.6, 23.6), ["build", "mach"], name="agency_id")
    total = F.aggregate("pieces", F.lit(0.0), lambda s, p: s + shapes.length(p))
    return lines.select("route_id", "trip_id", "hits", F.size("line").alias("points"), F.size("pieces").alias("pieces"), F.round(total, 6).alias("length"))


@query("F31_simplified_shapes", "trips stop_times stops", f"""
    with recursive {SHAPED}, p as (select trip_id, n, x, y, count(*) over (partition by trip_id) c from sp),
    s as (select distinct trip_id, 1::bigint lo, c::bigint hi from p where c>=3 union all select trip_id, unnest([lo, mid]), unnest([mid, hi]) from (
    select s.trip_id, s.lo, s.hi, arg_max(m.n, (dist, -m.n)) as mid, max(dist) d from s join p m on m.trip_id=s.trip_id and m.n>s.lo and m.n<s.hi join p a on a.trip_id=s.trip_id and a.n=s.lo join p b on b.trip_id=s.trip_id and b.n=s.hi,
    lateral (select case when a.x=b.x and a.y=b.y then 0e0 else greatest(0e0,least(1e0,((m.x-a.x)*(b.x-a.x)+(m.y-a.y)*(b.y-a.y))/(pow(b.x-a.x,2)+pow(b.y-a.y,2)))) end f) q, lateral (select sqrt(pow(m.x-a.x-f*(b.x-a.x),2)+pow(m.y-a.y-f*(b.y-a.y),2)) dist) e group by 1,2,3) where d>0.25),
    kept as (select distinct trip_id, k from (select trip_id, lo k from s union all select trip_id, hi from s) union select trip_id, n from p where c=2)
    select trip_id, count(*)::int points, round(sum(x),6) x from kept join p on p.trip_id=kept.trip_id and p.n=kept.k group by 1""".replace("select trip_id, count(*)::int", "select kept.trip_id, count(*)::int"))
def _(v):
    _, shaped = feed(v)
    kept = shapes.simplified(F.col("path"), 0.25)
    return shaped.select(F.col("shape_id").alias("trip_id"), kept.alias("k")).select("trip_id", F.size("k").alias("points"), F.round(F.aggregate("k", F.lit(0.0), lambda s, p: s + p["x"]), 6).alias("x"))


@query("F31_inside_points", "", f"with {LOTS} select id, round(x0+case kind when 0 then 0.045e0 when 1 then 0.02e0 else 0.015e0 end,6) x, round(y0+case kind when 1 then 0.065e0 else 0.045e0 end,6) y from lots")
def _(v):
    return lots(v).select("id", shapes.inside_point(F.col("rings")).alias("p")).select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))

"""Queries of gates and of budget lines from several sources, on rows written from the given tables; registered beside those of plans.queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.functions import forms, geo, stats
from wardlight.operators import budget, gates, spatial, transit
from wardlight.plans.queries import IN_WARD, query


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("G4_evidence_faults", "", """
    with f as (select 'f'||o_orderkey id, o_orderpriority confidence, case when o_orderstatus='F' then 'found' when o_orderstatus='O' then 'not_found' else 'other' end status, case when o_orderkey%7<>0 then 1 end as value,
    case when o_orderkey%10=0 then ' ' else 'IN' end country, case when o_orderkey%13=0 then 'PdfReader' when o_orderkey%13=1 then 'a fetcher' else 'text' end extractor from orders),
    c as (select 'c'||c_custkey id, case when c_custkey%9=0 then '' else c_name end as text, case when c_custkey%8=0 then []::varchar[] else ['f'||c_custkey, 'f'||(c_custkey*11), 'f'||(c_custkey*11)] end facts, case when c_custkey%6=0 then '' else '/' end||c_mktsegment route from customer)
    select id, 'confidence' as rule, confidence detail from f where confidence not in ('1-URGENT','2-HIGH','3-MEDIUM') union all select id, 'status', status from f where status='other' union all select id, 'null when not found', value::varchar from f where status='not_found' and value is not null
    union all select id, 'value when found', status from f where status='found' and value is null union all select id, 'country required', country from f where trim(country)='' union all select id, 'extractor', extractor from f where extractor<>'text'
    union all select id, 'text required', text from c where text='' union all select id, 'facts required', null from c where len(facts)=0 union all select id, 'absolute route', route from c where route not like '/%'
    union all select id, 'unknown fact', x from (select distinct id, unnest(facts) x from c) where x not in (select id from f)""")
def _(v):
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "found").when(F.col("o_orderstatus") == "O", "not_found").otherwise("other")
    facts = v.table("orders").select(
        F.concat(F.lit("f"), _text(k)).alias("id"), F.col("o_orderpriority").alias("confidence"), status.alias("status"), F.when(k % 7 != 0, 1).alias("value"), F.when(k % 10 == 0, " ").otherwise("IN").alias("country"),
        F.when(k % 13 == 0, "PdfReader").when(k % 13 == 1, "a fetcher").otherwise("text").alias("extractor"),
    )
    ids = F.array(*[F.concat(F.lit("f"), _text(x)) for x in (n, n * 11, n * 11)])
    claims = v.table("customer").select(
        F.concat(F.lit("c"), _text(n)).alias("id"), F.when(n % 9 == 0, "").otherwise(F.col("c_name")).alias("text"), F.when(n % 8 == 0, F.array().cast("array<string>")).otherwise(ids).alias("fact_ids"),
        F.concat(F.when(n % 6 == 0, "").otherwise("/"), "c_mktsegment").alias("route"), F.lit("roads").alias("function"),
    )
    return gates.evidence_faults(facts, claims, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["found", "not_found"])


@query("G5_source_faults", "", """
    with s as (select 's'||s_suppkey%97 id, case when s_suppkey%13=0 then ' ' else 'feed' end kind, case when s_suppkey%11=0 then null else s_name end as label, case s_suppkey%5 when 1 then 'ftp://x' when 2 then null when 3 then '' else 'https://x/'||s_suppkey end url from supplier)
    select id, 'kind required' as rule, kind detail from s where trim(kind)='' union all select id, 'label required', label from s where label is null union all select id, 'web address', url from s where url is not null and not regexp_matches(url,'^https?://')
    union all select id, 'duplicate id', (count(*)-1)::varchar from s group by 1 having count(*)>1""")
def _(v):
    k = F.col("s_suppkey")
    url = F.when(k % 5 == 1, "ftp://x").when(k % 5 == 2, F.lit(None)).when(k % 5 == 3, "").otherwise(F.concat(F.lit("https://x/"), _text(k)))
    return gates.source_faults(v.table("supplier").select(
        F.concat(F.lit("s"), _text(k % 97)).alias("id"), F.when(k % 13 == 0, " ").otherwise("feed").alias("kind"), F.when(k % 11 != 0, F.col("s_name")).alias("label"), url.alias("url"), k.alias("position"),
    ))


@query("G7_manifest_faults", "", """
    with l as (select 'l'||p_partkey//2 id, case when p_type='PROMO' then 'image' else lower(p_type) end kind, p_partkey||'.json' file, case when p_type='PROMO' and p_size%3<>0 then p_partkey*3||'.json' end bounds from part), f as (select distinct l_partkey||'.json' file from lineitem where l_quantity>45)
    select id, 'kind' as rule, kind detail from l where kind not in ('image','economy','standard') union all select id, 'image bounds', null from l where kind='image' and bounds is null
    union all select id, 'missing file', file from l where file not in (select file from f) union all select id, 'missing bounds', bounds from l where bounds is not null and bounds not in (select file from f)
    union all select id, 'duplicate id', (count(*)-1)::varchar from l group by 1 having count(*)>1""")
def _(v):
    k, image = F.col("p_partkey"), F.col("p_type") == "PROMO"
    name = lambda c: F.concat(_text(c), F.lit(".json"))
    layers = v.table("part").select(F.concat(F.lit("l"), _text(F.floor(k / 2))).alias("id"), F.when(image, "image").otherwise(F.lower("p_type")).alias("kind"), name(k).alias("file"), F.when(image & (F.col("p_size") % 3 != 0), name(k * 3)).alias("bounds_file"))
    files = v.table("lineitem").where("l_quantity > 45").select(name(F.col("l_partkey")).alias("file")).distinct()
    return gates.manifest_faults(layers, files, ["image", "economy", "standard"])


@query("G8_preflight", "routes trips stop_times stops", """
    with r as (select *, case when route_id%9=0 then '' else 'R'||route_id end nm from routes), e as (select min(stop_id::varchar)<max(stop_id::varchar) two from stop_times group by trip_id)
    select 'missing_input' gate, 'calendar' as input, null field, 1::bigint n union all select 'missing_field', 'stops', 'stop_lat', null union all select 'missing_field', 'routes', 'nm', count(*) from r where nm='' having count(*)>0
    union all select 'invalid_value', 'routes', 'route_type', count(*) from r where not (route_type between 1 and 12) having count(*)>0 union all select 'empty_input', 'transfers', null, 1
    union all select 'stop_sequence', 'stop_times', null, 1 from e having count(*) filter (where two)=0""")
def _(v):
    routes = v.routes().withColumn("nm", F.when(F.col("route_id") % 9 == 0, "").otherwise(F.concat(F.lit("R"), _text("route_id"))))
    inputs = {"routes": routes, "trips": v.trips(), "stop_times": v.stop_times(), "stops": v.stops(), "transfers": v.stops().where("false")}
    fields = {"routes": ["route_id", "nm"], "trips": ["trip_id", "route_id"], "stop_times": ["trip_id", "stop_id", "stop_sequence"], "stops": ["stop_id", "stop_lat"], "calendar": ["service_id"], "transfers": []}
    valid = {"routes": {"route_type": forms.is_whole(F.col("route_type"), 1, 12)}, "stops": {"x": forms.is_number(F.col("x"), -180, 180)}}
    return gates.preflight(inputs, fields, valid)


PROBES = """p as (select c_mktsegment grp, c_custkey%7 k, case c_custkey%7 when 0 then 'ok' when 1 then 'gated' when 2 then 'gated' when 3 then 'denied' when 4 then 'denied' else 'error' end status from customer where c_mktsegment<>'MACHINERY' or c_custkey%7 in (0,5,6))"""


def _probes(v):
    k = F.col("c_custkey") % 7
    body = (
        F.when(k == 0, '{"results": {"accessToken": "t"}, "detail": "No policy exist"}').when(k == 1, '{"detail": "sorry, No policy exist for it"}').when(k == 2, '{"title": "APD evaluation failed: x"}').when(k == 5, '{"results": {"accessToken": ""}}')
        .when(k == 6, "no json").otherwise('{"title": "", "detail": "closed"}')
    )
    rows = v.table("customer").where((F.col("c_mktsegment") != "MACHINERY") | k.isin(0, 5, 6)).select(F.col("c_mktsegment").alias("group"), F.when(k == 3, 401).when(k == 4, 403).otherwise(200).alias("http_status"), body.alias("payload"))
    return gates.probe_groups(gates.probe_status(rows))


@query("G9_probe_groups", "", f"""with {PROBES} select grp as group, count(*) resources, count(*) filter (where status='ok') ok, count(*) filter (where status='gated') gated, count(*) filter (where status='denied') denied, count(*) filter (where status='error') error,
    count(*) filter (where status in ('gated','denied'))>0 blocked from p group by 1""")
def _(v):
    return _probes(v)


FIELDS = """e as (select distinct n_regionkey r, c_mktsegment f from nation, (select distinct c_mktsegment from customer)), g as (select distinct n_regionkey r, c_mktsegment f from customer join nation on c_nationkey=n_nationkey where c_acctbal>9700 union select distinct n_regionkey, n_name from nation where n_nationkey%12=0),
    cov as (select e.r, count(*) n, count(g.f) p, list(e.f order by e.f) filter (where g.f is null) m from e left join g using (r,f) group by 1), x as (select g.r, list(g.f order by g.f) m from g anti join e using (r,f) group by 1)"""


def _coverage(v):
    """Fields that resources should have, each segment for each region, and have: those of its richest customers, and some names nobody asked for."""
    nation, customer = v.table("nation"), v.table("customer")
    segments = customer.select(F.col("c_mktsegment").alias("field")).distinct()
    expected = nation.select(_text("n_regionkey").alias("resource")).distinct().crossJoin(segments)
    rich = customer.where("c_acctbal > 9700").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(_text("n_regionkey").alias("resource"), F.col("c_mktsegment").alias("field"))
    odd = nation.where("n_nationkey % 12 = 0").select(_text("n_regionkey").alias("resource"), F.col("n_name").alias("field"))
    return gates.field_coverage(expected, rich.unionByName(odd))


@query("G10_field_coverage_of_tables", "", f"with {FIELDS} select cov.r::varchar resource, n::int expected, p::int present, coalesce(cov.m,[]) missing, coalesce(x.m,[]) extra from cov left join x using (r)")
def _(v):
    return _coverage(v)


@query("G9_build_readiness", "", f"""
    with {PROBES}, {FIELDS}, b as (select grp, count(*) filter (where status in ('gated','denied'))>0 blocked from p group by 1)
    select n_regionkey::varchar build, bool_or(b.blocked) access_gated, any_value(coalesce(len(cov.m),0)=0) inputs_ready, any_value(coalesce(cov.m,[])) missing, list_concat(case when bool_or(b.blocked) then ['policy_access'] else [] end, case when any_value(coalesce(len(cov.m),0)>0) then ['missing_fields'] else [] end) gates,
    case when (select bool_or(blocked) from b) or exists (select 1 from orders where o_orderstatus='P') then 'request_policy' else 'build_layers' end next_action
    from (select distinct n_regionkey, (select list(distinct c_mktsegment) from customer where c_mktsegment='MACHINERY' or n_regionkey%2=0 and c_mktsegment='BUILDING') gs from nation) q left join b on list_contains(gs, grp) left join cov on cov.r=n_regionkey group by 1""")
def _(v):
    region = v.table("nation").select("n_regionkey").distinct()
    segments = v.table("customer").select("c_mktsegment").distinct()
    pairs = region.crossJoin(segments).where("c_mktsegment = 'MACHINERY' or n_regionkey % 2 = 0 and c_mktsegment = 'BUILDING'")  # regions by segments
    builds = region.join(pairs.groupBy("n_regionkey").agg(F.collect_list("c_mktsegment").alias("groups")), "n_regionkey", "left").select(_text("n_regionkey").alias("build"), "groups")
    feeds = v.table("orders").select(_text("o_orderkey").alias("feed"), F.when(F.col("o_orderstatus") == "P", "gated").otherwise("open").alias("status"))
    return gates.readiness(builds, _probes(v), _coverage(v), feeds)


@query("T11_four_loaders", "budget", """
    with t as (select section, fy_start y, basis, round(sum(amount)/1e5,4) a from budget group by 1,2,3), m as (select distinct section from t where right(section,1) in ('1','2')),
    l1 as (select 1 loader, y||'-x' fy, case basis when 'A' then 'actual' when 'R' then 'RE' else 'BE' end basis, coalesce(case when m.section is not null then 'Head '||t.section end, t.section) head, case when m.section is not null then 'E1' else '' end entity, a from t left join m using (section) where basis<>'N' or y%2=0),
    h as (select head hd, fy_start y, round(sum(amount)/1e5,4) a from budget where confidence='low' group by 1,2),
    l2 as (select 2, y||'-x', 'BE', 'Income: '||lower(hd), 'BUS', a from h union all select 2, y||'-x', 'BE', 'Total income', 'BUS', round(sum(a),4) from h group by y),
    l3 as (select 3, y||'-x', 'BE', 'Brand#11', '', round(sum(a) filter (where section='Brand#11' and basis='N'),4) from t group by y having sum(a) filter (where section='Brand#11' and basis='N') is not null union all select 3, y||'-x', 'BE', 'Total', '', round(sum(a),4) from t group by y),
    l4 as (select 4, y||'-x', 'BE', 'Grant to '||w, '', a from (select ward w, fy_start y, floor(sum(amount)/1e4) a from budget group by 1,2) where a<=100000),
    u as (select * from l1 union all select * from l2 union all select * from l3 union all select * from l4)
    select fy fiscal_year, basis, entity, head, arg_min(loader, loader)::int loader, round(arg_min(a, loader),2) amount from u group by 1,2,3,4""")
def _(v):
    b = v.budget()
    year = lambda c: F.concat(_text(c), F.lit("-x")).alias("fiscal_year")
    total = b.groupBy("section", "fy_start", "basis").agg(F.round(F.sum("amount") / 1e5, 4).alias("amount"))
    head = F.when(F.col("basis") == "A", "Actual spend").when(F.col("basis") == "R", "Revised estimate").otherwise("Budget")
    none = F.lit(None).cast("string")
    first = total.where((F.col("basis") != "N") | (F.col("fy_start") % 2 == 0)).select(
        year("fy_start"), F.col("section").alias("line"), head.alias("account_head"), "amount", none.alias("raw"), F.lit("book").alias("source"), none.alias("confidence"), F.xxhash64("section", "fy_start", "basis").alias("position")
    )
    line_map = b.select(F.col("section").alias("line")).distinct().where("right(line, 1) in ('1', '2')").select("line", F.lit("E1").alias("entity"), F.lit("works").alias("category"), F.concat(F.lit("Head "), "line").alias("head"), F.lit("capital").alias("section"), F.lit("expenditure").alias("flow"))
    heads = b.where("confidence = 'low'").groupBy("head", "fy_start").agg(F.round(F.sum("amount") / 1e5, 4).alias("a"))
    by_year = heads.groupBy("fy_start").agg(F.map_from_entries(F.collect_list(F.struct(F.replace(F.lower("head"), F.lit(" "), F.lit("_")), "a"))).alias("m"), F.round(F.sum("a"), 4).alias("t"))  # the kinds of heads of a year
    objects = by_year.select(F.to_json(F.struct(year("fy_start").alias("year"), F.lit("own").alias("source"), F.map_concat("m", F.create_map(F.lit("note"), F.lit(None).cast("double"))).alias("income"), F.col("t").alias("total"))).alias("json"), F.col("fy_start").alias("position"))
    wide = total.groupBy("fy_start").agg(F.round(F.sum(F.when((F.col("section") == "Brand#11") & (F.col("basis") == "N"), F.col("amount"))), 4).alias("own"), F.round(F.sum("amount"), 4).alias("all")).select(year("fy_start"), _text("own").alias("own"), _text("all").alias("all"), none.alias("confidence"), F.col("fy_start").alias("position"))
    grants = b.groupBy("ward", "fy_start").agg(F.floor(F.sum("amount") / 1e4).alias("a"))
    told = grants.groupBy("fy_start").agg(F.array_join(F.collect_list(F.concat(F.lit("A grant to "), "ward", F.lit(" of Rs. "), F.format_number("a", 0), F.lit(" crore."))), " ").alias("text")).select(year("fy_start"), "text", F.lit("pdf").alias("source"), F.col("fy_start").alias("position"))  # a sentence a ward
    rows = budget.first_loader_wins(
        budget.verified_lines(first, line_map), budget.json_components(objects, "BUS", {"income": ("Income: ", "non_tax_revenue", "income")}, {"total": ("Total income", "non_tax_revenue", "income", "revenue")}),
        budget.wide_lines(wide, {"own": ("Brand#11", None, "works", None, "capital"), "all": ("Total", None, "total", None, "revenue")}), budget.told_grants(told),
    )
    return rows.select("fiscal_year", "basis", "entity", "head", "loader", F.round("amount", 2).alias("amount"))


@query("T10_line_candidates", "", """
    with l as (select o_orderkey//20 doc, o_orderkey%20 i, o_orderkey k, case o_orderkey%4 when 0 then ' Total income' when 1 then 'Capital total ' else 'Note' end||case when o_orderkey%3=0 then '' else ' '||o_custkey||' and '||o_orderkey end t, o_custkey a from orders),
    b as (select *, unnest(case k%4 when 0 then ['income'] when 1 then ['capital'] else []::varchar[] end) as label from l where k%3<>0 and (a<>0 or k<>0)), r as (select *, row_number() over (partition by doc, label order by i) r from b)
    select doc, label, case when a=0 then '' else a||'|' end||k candidates, trim(t) raw from r where r=1""")
def _(v):
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 4 == 0, " Total income").when(k % 4 == 1, "Capital total ").otherwise("Note"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), _text("o_custkey"), F.lit(" and "), _text(k))))
    lines = v.table("orders").select(F.floor(k / 20).alias("doc"), (k % 20).alias("line_no"), text.alias("text"))
    return budget.labelled_candidates(lines, {"income": "(?i)total income", "capital": "^Capital"}, ["doc"])


@query("T6_rows_of_labels", "", """
    with s as (select s_nationkey n, min(s_suppkey) a, max(s_suppkey) b, count(*) c, round(sum(s_acctbal)) d from supplier group by 1) select n doc, unnest(['first','size']) as label, unnest([[a, b]::double[], [c, abs(d)]::double[]]) figures from s""")
def _(v):
    s = v.table("supplier").groupBy(F.col("s_nationkey").alias("doc")).agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b"), F.count(F.lit(1)).alias("c"), F.abs(F.round(F.sum("s_acctbal"))).cast("long").alias("d"))
    join = lambda *c: F.concat_ws(" ", *[_text(x) if x in ("a", "b", "c", "d") else F.lit(x) for x in c])
    lines = s.select("doc", F.posexplode(F.array(join("First part", "a"), join("  first part", "a", "b"), join("Size of it", "c", "d"), join("size of it", "b", "b"), join("Other", "a", "b"))).alias("line_no", "text"))
    labels = v.spark.createDataFrame([("first", "First part"), ("size", "Size of it")], "label string, begins string")
    return budget.rows_of_labels(lines, labels, ["doc"], 2)


@query("T7_titled_cells", "", """
    with s as (select n_regionkey r, n_nationkey n, n_name nm, row_number() over (partition by n_regionkey order by n_nationkey) i, (select count(*) from supplier where s_nationkey=n_nationkey) c, (select count(*) from customer where c_nationkey=n_nationkey) u from nation)
    select r doc, 1 as table, nm as label, c::double suppliers, case when n%4<>0 then u::double end customers from s""")
def _(v):
    n = v.table("nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"))
    counts = n.join(v.table("supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("c")), "n", "left").join(v.table("customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("u")), "n", "left").na.fill(0)
    cell = lambda row, column, text: F.struct(row.cast("int").alias("row"), F.lit(column).alias("column"), text.alias("text"))
    body = counts.select("doc", F.explode(F.array(cell(10 + F.col("n"), 1, F.col("name")), cell(10 + F.col("n"), 0, F.format_number("c", 0)), cell(10 + F.col("n"), 2, F.when(F.col("n") % 4 == 0, "n/a").otherwise(_text("u"))))).alias("_c"))
    fixed = n.select("doc").distinct().select("doc", F.explode(F.array(cell(F.lit(0), 0, F.lit("Table of  Suppliers by nation")), cell(F.lit(1), 0, F.lit(" Number")), cell(F.lit(1), 2, F.lit("CUSTOMERS")), cell(F.lit(1), 1, F.lit("Nation")))).alias("_c"))
    own = body.unionByName(fixed).select("doc", F.lit(1).alias("table"), "_c.*")
    other = fixed.where("_c.row = 1").select("doc", F.lit(2).alias("table"), "_c.*").unionByName(body.select("doc", F.lit(2).alias("table"), "_c.*"))  # a table without the title
    return budget.cells_by_title(own.unionByName(other), ["doc"], "suppliers by nation", 1, {"suppliers": "number", "customers": "customers"})


@query("T14_staffing", "", """
    with s as (select c_custkey k, c_custkey%5 s, c_custkey+50 a, c_custkey%40+1 x from customer)
    select k, case when s<4 then a end sanctioned, case when s<4 then a-x end filled, case when s<4 then x end vacant, case when s in (0,1) then a//2 when s=3 then a//3 end professional_sanctioned, case when s=0 then x//2 end professional_vacant,
    round(case when s<4 then x*100e0/a end,1) vacancy_rate, case s when 0 then 'observed_split' when 4 then 'not_found' else 'observed_total_only' end status from s""")
def _(v):
    k = F.col("c_custkey")
    a, x = k + 50, k % 40 + 1
    half = lambda n, d=2: F.floor(n / d)
    words = lambda *p: F.concat(*[F.lit(t) if isinstance(t, str) else _text(t) for t in p])
    table = words("Total Posts Sanctioned : ", a, "\nFilled up Post: ", a - x, "  Vacant  Post : ", x, ". ")
    text = (
        F.when(k % 5 == 0, F.concat(table, F.concat_ws(" ", F.lit("posts"), *[_text(t) for t in (half(a), a - half(a), half(a - x), F.lit(1), half(x), F.lit(2))])))
        .when(k % 5 == 1, F.concat(table, F.concat_ws(" and ", _text(half(a)), _text(a - half(a))))).when(k % 5 == 2, table)
        .when(k % 5 == 3, words("a sanctioned staff  strength of ", a, " comprising of ", half(a, 3), " professionals and ", a - half(a, 3), " Non-Professionals, out of which ", x, " posts are lying vacant")).otherwise("no posts")
    )
    found = budget.staffing(v.table("customer").select(k.alias("k"), text.alias("text")))
    return found.select("k", "sanctioned", "filled", "vacant", "professional_sanctioned", "professional_vacant", "vacancy_rate", "status")


@query("F27_address_cascade", "", """
    with m as (select l_suppkey k, min(l_partkey) pin from lineitem where l_quantity>30 group by 1), a as (select s_suppkey k, trim(regexp_replace(s_name||'  , '||coalesce(n_name,''),'[ ,]+',' ','g')) q, n_name from supplier left join nation on n_nationkey=s_nationkey)
    select a.k, q as query, case when s_acctbal>5000 then 'verified' when m.pin is not null then 'pin' when a.n_name is not null then 'map' else 'none' end origin, case when s_acctbal>5000 then a.k when m.pin is not null then m.pin when a.n_name is not null then s_nationkey end place from a join supplier on s_suppkey=a.k left join m on m.k=a.k""")
def _(v):
    """The first source that knows a place: checked ones, a pin of the lines, the nation; and the text to ask a map with."""
    s = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    pins = v.table("lineitem").where("l_quantity > 30").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_partkey").alias("pin"))
    asked = F.trim(F.regexp_replace(F.concat_ws("  , ", "s_name", "n_name"), "[ ,]+", " "))
    steps = {"verified": F.when(F.col("s_acctbal") > 5000, F.col("s_suppkey")), "pin": F.col("pin"), "map": F.when(F.col("n_name").isNotNull(), F.col("s_nationkey"))}
    origin = F.coalesce(*[F.when(place.isNotNull(), name) for name, place in steps.items()], F.lit("none"))
    return s.join(pins, "s_suppkey", "left").select(F.col("s_suppkey").alias("k"), asked.alias("query"), origin.alias("origin"), F.coalesce(*steps.values()).alias("place"))


@query("F29_session_ranges", "", """
    select distinct k, s::int as session from (select c_custkey k, unnest(range(c_custkey%5, c_custkey%5+c_nationkey%4+1)) s from customer union all select c_custkey, c_nationkey from customer)""")
def _(v):
    """Sessions of each customer from a text such as '3-5, 9'."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = F.concat(_text(k % 5), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("-"), _text(k % 5 + n % 4))), F.lit(" , "), _text(n))
    parts = v.table("customer").select(k.alias("k"), F.explode(F.split(text, ",")).alias("p"))
    ends = F.transform(F.split("p", "-"), lambda x: F.trim(x).cast("int"))
    return parts.select("k", F.explode(F.sequence(F.get(ends, F.lit(0)), F.element_at(ends, -1))).alias("session")).distinct()


@query("F30_box_tiles", "", """
    with b as (select s_nationkey n, min(72+(s_suppkey*7919%1000)/1000e0) x0, max(72+(s_suppkey*7919%1000)/1000e0) x1, min(23+(s_suppkey*104729%1000)/1000e0) y0, max(23+(s_suppkey*104729%1000)/1000e0) y1 from supplier group by 1)
    select n, i::int tx, j::int ty, round(x0+i*(x1-x0)/3,9) west, round(y0+j*(y1-y0)/2,9) south from b, range(0,3) t(i), range(0,2) u(j)""")
def _(v):
    """The box of each nation's libraries in three by two tiles, one query to a tile."""
    s = v.libraries().join(v.table("supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").alias("n")), "target_id")
    box = s.groupBy("n").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    tiles = box.withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(1))))
    step = lambda low, high, i, n: F.round(F.col(low) + F.col(i) * (F.col(high) - F.col(low)) / n, 9)
    return tiles.select("n", "tx", "ty", step("x0", "x1", "tx", 3).alias("west"), step("y0", "y1", "ty", 2).alias("south"))


INSET = "e as (select poly_id, x0+0.03e0 x0, x1-0.03e0 x1, y0+0.03e0 y0, y1-0.03e0 y1 from wards)"


@query("X34_stop_frequency_of_all_wards", "stops stop_times wards", f"""
    with {INSET}, i as (select p.stop_id, min(w.poly_id) poly_id from stops p join e w on {IN_WARD} group by 1), c as (select poly_id, unnest([x0,x1,x1,x0]) vx, unnest([y0,y0,y1,y1]) vy from e),
    d as (select stop_id, poly_id, pow((x-vx)*cos(radians(23.5e0))*111000e0,2)+pow((y-vy)*111000e0,2) d2 from stops join c on abs(x-vx)<0.1 and abs(y-vy)<0.1 where stop_id not in (select stop_id from i)),
    n as (select stop_id, arg_min(poly_id,(round(d2,3),poly_id)) poly_id from d where d2<=6000e0*6000e0 group by 1), a as (select *, true strict from i union all select *, false from n),
    s as (select poly_id, count(*) stops, count(*) filter (where strict) strict_stops, coalesce(sum(k.n),0)::bigint events from a left join (select stop_id, count(*) n from stop_times group by 1) k using (stop_id) group by 1),
    f as (select e.poly_id, coalesce(stops,0) stops, coalesce(strict_stops,0) strict_stops, coalesce(events,0) events from e left join s using (poly_id))
    select *, (least(3,(row_number() over (order by events, poly_id)-1)//greatest(1,count(*) over ()//4))+1)::int quartile from f""")
def _(v):
    """All wards, drawn without their streets: stops in the streets between go to the ward with the nearest corner within 6 km."""
    at = lambda i, k, by: F.get("ring", F.lit(i))[k] + by
    wards = v.wards().withColumn("ring", geo.rectangle(at(0, "x", 0.03), at(0, "y", 0.03), at(2, "x", -0.03), at(2, "y", -0.03)))
    found = transit.ward_stops(v.stops().withColumnRenamed("stop_id", "point_id"), wards, 6000.0, 23.5)
    n = v.stop_times().groupBy(F.col("stop_id").alias("point_id")).agg(F.count(F.lit(1)).alias("n"))
    s = found.join(n, "point_id", "left").groupBy("poly_id").agg(F.count(F.lit(1)).alias("stops"), F.count_if("strict").alias("strict_stops"), F.sum(F.coalesce("n", F.lit(0))).alias("events"))
    full = wards.select("poly_id").join(s, "poly_id", "left").na.fill(0)
    return stats.chunk_quartiles(full, "events", "poly_id").select("poly_id", "stops", "strict_stops", "events", "quartile")


@query("X35_access_of_all_libraries", "people libraries stops stop_times wards", f"""
    with p as (select w.poly_id, count(p.point_id) people from wards w left join people p on {IN_WARD} group by 1), l as (select w.poly_id, count(p.target_id) libraries from wards w left join libraries p on {IN_WARD} group by 1),
    s as (select w.poly_id, coalesce(sum(k.n),0) events from wards w left join (stops p join (select stop_id, count(*) n from stop_times group by 1) k using (stop_id)) on {IN_WARD} group by 1),
    n as (select w.poly_id, region, people, coalesce((libraries-min(libraries) over ())/nullif(max(libraries) over ()-min(libraries) over (),0),0) a, coalesce((events-min(events) over ())/nullif(max(events) over ()-min(events) over (),0),0) b from wards w join p using (poly_id) join l using (poly_id) join s using (poly_id))
    select region, count(*) wards, round(sum((a+b)/2*people)/nullif(sum(people),0),6) access, arg_max(poly_id,(round((a+b)/2,9),-poly_id)) best from n group by 1""")
def _(v):
    """Access of wards as the mean of their scaled libraries and stop events, rolled up to regions by people."""
    wards = v.wards()
    n = wards.select("poly_id", "region").join(spatial.count_per_polygon(v.people(), wards, "people"), "poly_id").join(spatial.count_per_polygon(v.libraries().withColumnRenamed("target_id", "point_id"), wards, "libraries"), "poly_id")
    events = v.stops().join(v.stop_times().groupBy("stop_id").agg(F.count(F.lit(1)).alias("n")), "stop_id").withColumnRenamed("stop_id", "point_id")
    n = n.join(spatial.containing(events, wards).groupBy("poly_id").agg(F.sum("n").alias("events")), "poly_id", "left").na.fill(0, ["events"])
    n = stats.min_max(stats.min_max(n, "libraries", "a"), "events", "b").withColumn("access", (F.col("a") + F.col("b")) / 2)
    rolled = F.try_divide(F.sum(F.col("access") * F.col("people")), F.sum("people").cast("double"))
    return n.groupBy("region").agg(F.count(F.lit(1)).alias("wards"), F.round(rolled, 6).alias("access"), F.max_by("poly_id", F.struct(F.round("access", 9), -F.col("poly_id"))).alias("best"))

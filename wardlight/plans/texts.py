"""Queries on report texts, nested catalogues and page tables, all written from the given tables; registered beside those of plans.queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.operators import documents, reports
from wardlight.plans.queries import query

ZONES, PARTIES = ["East Zone", "New West Zone", "West Zone"], {"L": "Lotus", "H": "Hand"}


def _text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _joined(rows: DataFrame, by: str, order: str, line: str, sep: str = "\n") -> Column:
    """The lines of a group in order; groups are small by their making."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), sep)


@query("W8_T13_rosters", "", """
    with c as (select c_custkey k, c_custkey//50 doc, c_custkey%50 i, (c_custkey%50)//2+1 s, c_custkey%7=0 bad, c_name nm, lower(c_mktsegment) seg, c_custkey%3 z from customer),
    f as (select doc, s, min(i) filter (where not bad) start from c group by all), g as (select *, count(*) filter (where start is null) over (partition by doc order by s) lost, row_number() over (partition by doc order by s) r from f),
    a as (select doc, s, start from g where lost=0 and r=s), b as (select c.*, last_value(a.s ignore nulls) over (partition by c.doc order by c.i) serial, a.s own from c left join a on a.doc=c.doc and a.start=c.i),
    p as (select doc, serial, string_agg('9'||lpad(k::varchar,9,'0'), '; ' order by i) phones, bool_or(k%4=0) lotus, bool_or(k%4=1) hand from b where serial is not null group by 1,2)
    select b.doc, b.serial::int serial, ((b.serial-1)//4+1)::int seat_ward, 'Ward '||seg ward, case z when 0 then 'East Zone' when 1 then 'West Zone' else 'New West Zone' end as zone, nm as member, case when lotus then 'L' when hand then 'H' else '' end party, phones
    from b join p on p.doc=b.doc and p.serial=b.serial where own is not null""")
def _(v):
    k = F.col("c_custkey")
    serial = F.floor(k % 50 / 2) + 1 + F.when(k % 7 == 0, 500).otherwise(0)
    zone = F.when(k % 3 == 0, "East Zone").when(k % 3 == 1, "West  Zone").otherwise("New West Zone")
    party = F.when(k % 4 == 0, "Lotus").when(k % 4 == 1, "Hand").otherwise("free")
    first = F.concat_ws(" ", F.lit(""), _text(serial), F.lit("Ward"), F.lower("c_mktsegment"), zone, F.col("c_name"))
    second = F.concat(F.lit("Road 1, "), party, F.lit(" 9"), F.lpad(_text(k), 9, "0"))
    lines = v.table("customer").select(F.floor(k / 50).alias("doc"), k.alias("at"), F.concat(first, F.lit("\n\n"), second).alias("line"))
    docs = lines.groupBy("doc").agg(_joined(lines, "doc", "at", "line").alias("text"))
    return reports.roster(reports.serial_blocks(docs), ZONES, PARTIES, ["Road"]).select("doc", "serial", "seat_ward", "ward", "zone", "member", "party", "phones")


@query("T13_roster_faults", "", """
    with c as (select c_custkey//50 doc, c_custkey%50+1 s from customer), g as (select doc, s, row_number() over (partition by doc order by s) r from c), a as (select doc, (s-1)//4+1 w, count(*) n from g where r=s group by 1,2),
    d as (select doc, sum(n)::bigint r, count(*) w from a group by 1) select doc, 'rows' fault, null::int ward, r n from d where r<>50 union all select doc, 'wards', null, w from d where w<>13 union all select doc, 'seats', w::int, n from a where n<>4""")
def _(v):
    k = F.col("c_custkey")
    lines = v.table("customer").select(F.floor(k / 50).alias("doc"), k.alias("at"), F.concat(_text(k % 50 + 1), F.lit(" "), F.col("c_name")).alias("line"))
    docs = lines.groupBy("doc").agg(_joined(lines, "doc", "at", "line").alias("text"))
    blocks = reports.serial_blocks(docs).withColumn("seat_ward", (F.floor((F.col("serial") - 1) / 4) + 1).cast("int"))
    return reports.roster_faults(blocks, "doc", 50, 13, 4)


@query("T3_annual_figures", "", """
    with o as (select o_orderkey k, o_orderkey%4 style, o_custkey a, o_orderkey%1000+1 b, o_custkey*3 d, o_orderkey%500+1 e, 2001+o_orderkey%20 y, o_orderkey%5=0 off, o_orderkey%5=0 and o_custkey>0 bad, o_orderkey%3<>0 fin, o_orderkey%9=1 wrong from orders)
    select k, y||'-'||printf('%02d',(y+1)%100) as year, case when style<3 then a end adult_members, case when style<3 then b end child_members, case when style<3 then a+b end total_members,
    case when style<2 and not bad then d end adult_issues, case when style<2 and not bad then e end child_issues, case when style<2 then d+e+off::int when style=2 then d+e end total_issues, 100000+k collection,
    case when fin then a end opening, case when fin then a+b+7+wrong::int end available, case when fin then not wrong end finance_adds_up, case when style<2 then 'high' else 'medium' end confidence,
    case when style<2 and bad then 'issues unreconciled' when style<2 then 'reconciled' when style=2 then 'summary' else 'no members' end status from o""")
def _(v):
    k, a, y = F.col("o_orderkey"), F.col("o_custkey"), 2001 + F.col("o_orderkey") % 20
    b, d, e, off = k % 1000 + 1, a * 3, k % 500 + 1, (k % 5 == 0).cast("long")
    row = F.concat_ws("  ", *[_text(x) for x in (a, b, a + b, d, e, d + e + off)])
    table = F.concat(F.lit("Statement showing membership\nBranch  1 2 3 4 5 6\n"), F.when(k % 4 == 0, "  Total ").otherwise("* TOTAL: 99999999 "), row, F.lit("\n"))
    told = F.concat(F.lit("Total Membership of all (Adult - "), _text(a), F.lit(", Children - "), _text(b), F.lit(") in the year : "), _text(a + b), F.lit("\nNo. of Books issued in all : "), _text(d + e), F.lit("\n"))
    money = F.concat(F.lit("Unspent balance etc.\nTOTAL "), F.concat_ws(" ", *[_text(x) for x in (a, b, F.lit(7), a + b + 7 + (k % 9 == 1).cast("long"), F.lit(0), a, b)]), F.lit("/-\n"))
    body = F.concat(F.when(k % 3 != 0, money).otherwise(""), F.lit("The book collection at the end was "), F.format_number(100000 + k, 0), F.lit(" volumes.\n"), F.when(k % 4 < 2, table).when(k % 4 == 2, told).otherwise(""))
    name = F.concat(F.lit("report "), _text(y), F.lit(" – "), _text(y + 1))
    found = reports.annual_figures(v.table("orders").select(k.alias("k"), name.alias("name"), body.alias("text")))
    return found.select("k", "year", "adult_members", "child_members", "total_members", "adult_issues", "child_issues", "total_issues", "collection", "opening", "available", "finance_adds_up", "confidence", "status")


@query("T18_nested_links", "", """
    with l as (select l_orderkey id, l_partkey p, l_suppkey s, l_linenumber n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey||'"', '/f/'||l_suppkey||'.pdf')-1 i from lineitem where l_suppkey%9<>0),
    f as (select id, '/f/'||s||'.pdf' url, 'part '||p title, case when n%2=0 then '$.menu.items['||i||']' else '$.menu.items['||i||'].box[0][0]' end as path, case when n%2=0 then 3 else 6 end as depth from l),
    r as (select *, row_number() over (partition by id, url order by depth, path, title) r from f) select id, path, depth::int as depth, title, url from r where r=1""")
def _(v):
    n = F.col("l_linenumber")
    leaf = F.struct(F.concat(F.lit(" part "), _text("l_partkey")).alias("label"), F.concat(F.lit("/f/"), _text("l_suppkey"), F.lit(".pdf")).alias("link"))
    item = F.when(n % 2 == 0, F.to_json(leaf)).otherwise(F.concat(F.lit('{"box": [['), F.to_json(leaf), F.lit("]]}")))
    lines = v.table("lineitem").where("l_suppkey % 9 <> 0").select(F.col("l_orderkey").alias("id"), n.alias("n"), item.alias("item"))
    docs = lines.groupBy("id").agg(_joined(lines, "id", "n", "item", ", ").alias("_items"))
    docs = docs.select("id", F.concat(F.lit('{"page": 1, "none": null, "menu": {"title": "all", "url": "index.html", "items": ['), "_items", F.lit("]}}")).alias("json"))
    return documents.nested_links(docs, "json")


@query("F18_page_cells", "", """
    with l as (select l_orderkey id, l_partkey p, l_quantity::int q, l_suppkey s, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey||'<', l_quantity::int::varchar)::int i, count(*) over (partition by l_orderkey) c from lineitem),
    o as (select id, max(c)::int c, max(p) filter (where i=1) first from l group by 1)
    select id, 0 as table, 0 as row, 0 as column, true as header, false spanned, 'Parts & all' as text, [] links from o union all select id, 0, 0, 1, true, true, 'Parts & all', [] from o union all select id, 0, 0, 2, true, false, 'n', [] from o
    union all select id, 0, i, 0, false, i>1, 'order '||id, [] from l union all select id, 0, i, 1, false, false, 'part '||p, ['/p/'||p] from l union all select id, 0, i, 2, false, false, q::varchar, [] from l""")
def _(v):
    cell = F.concat(F.lit("<td>part <b>"), _text("l_partkey"), F.lit("</b> <a href='/p/"), _text("l_partkey"), F.lit("'></a></td><TD>"), _text(F.col("l_quantity").cast("int")))
    lines = v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), cell.alias("cell"))
    docs = lines.groupBy("id").agg(_joined(lines, "id", "n", "cell", "<tr>").alias("_rows"), F.count(F.lit(1)).alias("_n"))
    head = F.lit("<p>x<table class=a><script>var a='<td>';</script><tr><th colspan=2>Parts &amp; all<th> n </th></tr>\n<tr><td rowspan='")
    docs = docs.select("id", F.concat(head, _text("_n"), F.lit("'>order "), _text("id"), F.lit("</td>"), "_rows", F.lit("</table>y")).alias("html"))
    return documents.table_cells(docs, "id", "html")


@query("T2_page_locations", "", """
    with c as (select c_custkey//5 id, c_custkey k, c_name a, c_nationkey n, row_number() over (partition by c_custkey//5 order by c_custkey) i from customer)
    select id, case when i=1 then '' else 'Place '||k end as name, a||' & co '||case when n%3=0 then 'map' else 'mail' end as address, case when n%3=0 then (20+n)||'.5' when i=1 then '12.25' end lat, case when n%3=0 then (70+n)||'' when i=1 then '77.5' end lon, case when n%3=0 then 'query' when i=1 then 'embed' end source from c""")
def _(v):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    link = F.when(n % 3 == 0, F.concat(F.lit("<a href='https://maps.example.org/?x=1&amp;q="), _text(20 + n), F.lit(".5,"), _text(70 + n), F.lit("'>map</a>"))).otherwise("<a href='/contact'>mail</a>")
    first = F.row_number().over(Window.partitionBy(F.floor(k / 5)).orderBy(k)) == 1
    title = F.when(first, "<tr><td>Opening Hours</td></tr>").otherwise(F.concat(F.lit("<tr><td colspan=2>Place "), _text(k), F.lit("</td></tr>")))
    row = F.concat(title, F.lit("<tr><td>Hours</td><td>9-5</td></tr><tr><td>Address:</td><td>"), F.col("c_name"), F.lit(" &amp; co"), link, F.lit("</td></tr>"))
    rows = v.table("customer").select(F.floor(k / 5).alias("id"), k.alias("k"), row.alias("row"))
    pages = rows.groupBy("id").agg(_joined(rows, "id", "k", "row", "").alias("_rows"))
    pages = pages.select("id", F.concat(F.lit("<iframe src='https://maps.example.org/embed?pb=!1m1!2d77.5!3d12.25'></iframe><table>"), "_rows", F.lit("</table>")).alias("html"))
    return documents.locations(pages, "id", "html")

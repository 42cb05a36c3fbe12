"""Rosters, annual reports, nested catalogues and page tables."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from wardlight.operators import documents, reports


def blocks_of(text):
    """Serial blocks, line by line."""
    out, expected = [], 1
    for line in re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", text or ""):
        line = " ".join(line.translate(str.maketrans(reports.GUJARATI_DIGITS, "0123456789")).split())
        if not line:
            continue
        m = re.match(r"(\d{1,3})(?: |$)", line)
        if m and int(m[1]) == expected:
            out.append([line])
            expected += 1
        elif out:
            out[-1].append(line)
    return out


def test_serial_blocks(spark):
    rnd = random.Random(3)
    texts = ["", None, "no number\n 2 first\n", "૧ એક\n૨  બે\r\n\n૩\n૨ again\n૪ ચાર", "1 a\n1 b\n3 c\n2 d\n1234 x\n3", "12\n1"]
    for _ in range(40):
        texts.append("\n".join(f"{rnd.choice(['', ' '])}{rnd.randint(1, 6)}{rnd.choice([' x', '', 'y', '. z'])}" for _ in range(rnd.randint(0, 40))))
    texts.append("\n".join(f"{i} line\nmore" for i in range(1, 400)))
    found = {}
    for r in reports.serial_blocks(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect():
        found.setdefault(r.id, []).append((r.serial, list(r.lines)))
    for i, text in enumerate(texts):
        assert [lines for _, lines in sorted(found.get(i, []))] == blocks_of(text)
        assert [s for s, _ in sorted(found.get(i, []))] == list(range(1, len(blocks_of(text)) + 1))


def test_roster_rows(spark):
    text = "1 Old Town East\nZone Asha Rao,\nRoad 5 9812345678\n2 Hill\nWest Zone\nB. Sen\nParty Hand\n+91 9812345678 9812345678\n3 No zone here\n4 East Zone\n5 River East Zones"
    rows = reports.roster(reports.serial_blocks(spark.createDataFrame([("d", text)], "doc string, text string")), ["East Zone", "West Zone"], {"H": "Hand"}, ["Road"], seats=2).orderBy("serial").collect()
    got = [(r.serial, r.seat_ward, r.ward, r.zone, r.member, r.party, r.phones) for r in rows]
    assert got == [
        (1, 1, "Old Town", "East Zone", "Asha Rao", "", "9812345678"), (2, 1, "Hill", "West Zone", "B. Sen", "H", "+91 9812345678; 9812345678"), (3, 2, "", "", "No zone here", "", ""), (4, 2, "", "East Zone", "", "", ""),
        (5, 3, "", "", "River East Zones", "", ""),
    ]
    table = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1)], "doc string, seat_ward int")
    assert sorted((r.doc, r.fault, r.ward, r.n) for r in reports.roster_faults(table, "doc", 2, 1, 2).collect()) == [("a", "rows", None, 3), ("a", "seats", 2, 1), ("a", "wards", None, 2)]


REPORTS = {
    "strict": ("report 2019-2020", "Details of Membership\nTotal 1 1 9 1 1 2\nTotal 10 5 15 1,000 200 1,200\nThe book collection of all was 1,23,456", {"year": "2019-20", "total_members": 15, "adult_issues": 1000, "total_issues": 1200, "collection": 123456, "status": "reconciled", "confidence": "high"}),
    "unreconciled table": ("x", "2018-19 details of membership\nTotal 10 5 16 1 1 2\nNet Book Stock : 20,00,010", {"year": "2018-19", "total_members": None, "collection": 2000010, "status": "no members"}),
    "loose": ("2001_02", "statement showing membership\nSum 1 2 3\n*Total* (7) 4 6 10 5 5 11 rest\n", {"year": "2001-02", "adult_members": 4, "child_members": 6, "total_members": 10, "adult_issues": None, "total_issues": 11, "status": "issues unreconciled"}),
    "summary": ("2001-02", "Total Membership (Adult - 4, Children - 6) now: 10\nNo. of Books issued : 99", {"adult_members": 4, "total_members": 10, "adult_issues": None, "total_issues": 99, "status": "summary", "confidence": "medium"}),
    "money": ("2001-02", "Unspent Balance\ntotal 1 2 3 6 0 5.00/- 1", {"opening": 1, "available": 6, "spent": 5, "finance_adds_up": True, "status": "no members"}),
    "stock table": ("2001-02", "Analysis of net book stock:\nTotal 5\nGrand total 200,001 300,002\n", {"collection": 300002}),
    "footnote": ("2001-02", "the book collection was 12345670", {"collection": 1234567}),
    "few readers": ("2001-02", "book collection was 5. Attendance of readers in Reading Rooms: - 900\nDuring the year under report 12,000 persons availed this facility", {"attendance": 12000}),
    "no year": ("x", "Details of Membership\nTotal 10 5 15 1 1 2", None),
    "nothing": ("2001-02", "no figures", None),
    "null": (None, None, None),
}


def test_annual_figures(spark):
    docs = spark.createDataFrame([(k, n, t) for k, (n, t, _) in REPORTS.items()], "id string, name string, text string")
    found = {r.id: r for r in reports.annual_figures(docs).collect()}
    assert set(found) == {k for k, (_, _, want) in REPORTS.items() if want}
    for k, (_, _, want) in REPORTS.items():
        for name, value in (want or {}).items():
            assert found[k][name] == value, (k, name)


def test_adds_up(spark):
    of = lambda n: spark.range(1).select(reports.adds_up(F.array(*[F.lit(x).cast("long") for x in n])).alias("c")).first()["c"]
    assert of([1, 2, 3, 0, 0, 0]) == [1, 2, 3, 0, 0, 0] and of([9, 1, 2, 3, 0, 0, 0]) == [1, 2, 3, 0, 0, 0] and of([1, 2, 4, 0, 0, 0]) is None and of([1, 2, 3]) is None


def walked(value, path="$", depth=0):
    if isinstance(value, dict | list):
        yield path, depth, value
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from walked(v, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", depth + 1)


def grown(rnd, depth):
    if depth == 0 or rnd.random() < 0.2:
        return rnd.choice([1, None, "x", True, {"title": f"t{rnd.randint(0, 9)}", "url": f"a{rnd.randint(0, 5)}.pdf"}, {"name": " ", "label": "l", "href": "b.PDF?x"}, {"title": "no link"}, {"url": "c.html", "title": "t"}])
    return [grown(rnd, depth - 1) for _ in range(rnd.randint(0, 3))] if rnd.random() < 0.5 else {f"k{i}": grown(rnd, depth - 1) for i in range(rnd.randint(0, 3))}


def test_nested_links(spark):
    rnd = random.Random(6)
    values = [grown(rnd, 6) for _ in range(30)]
    deep = {"title": "deep", "url": "deep.pdf"}
    for _ in range(12):
        deep = [deep]
    rows = [(i, json.dumps(v)) for i, v in enumerate([*values, deep])] + [(100, None), (101, "{broken"), (102, "3"), (103, "[]")]
    docs = spark.createDataFrame(rows, "id int, j string")
    assert sorted((r.id, r.path, r.depth) for r in documents.nodes(docs, "j").collect()) == sorted([(i, p, d) for i, v in enumerate([*values, deep]) for p, d, _ in walked(v)] + [(103, "$", 0)])
    want = {}
    for i, v in enumerate([*values, deep]):
        for path, depth, node in walked(v):
            if isinstance(node, dict):
                title = next((t.strip() for k in documents.TITLE_FIELDS if isinstance(t := node.get(k), str) and t.strip()), None)
                url = next((u for k in documents.URL_FIELDS if isinstance(u := node.get(k), str) and u.strip()), None)
                if title and url and re.search(r"(?i)\.pdf(?:[?#]|$)|download", url):
                    want[i, url] = min(want.get((i, url), (99,)), (depth, path, title))
    assert {(r.id, r.url): (r.depth, r.path, r.title) for r in documents.nested_links(docs, "j").collect()} == want
    assert documents.nested_links(docs.limit(0), "j").count() == 0


def test_nested_links_open_levels_together(spark, monkeypatch):
    written = []
    monkeypatch.setattr(documents, "cut_lineage", lambda df, cut=documents.cut_lineage: written.append(cut(df)) or written[-1])

    def boxed(depth):
        value = {"title": f"t{depth}", "url": f"{depth}.pdf"}
        for i in range(depth):
            value = {"k": value, "title": "no link"} if i % 2 else [0, value]
        return value

    def links(depths):
        written.clear()
        docs = spark.createDataFrame([(d, json.dumps(boxed(d))) for d in depths], "id int, j string")
        return sorted((r.id, r.depth, r.path.count("[1]") + r.path.count(".k"), r.title, r.url) for r in documents.nested_links(docs, "j").collect())

    assert links([0, 3, 6, 7]) == [(d, d, d, f"t{d}", f"{d}.pdf") for d in (0, 3, 6, 7)] and len(written) == 1
    assert links([8, 9, 15, 16, 17]) == [(d, d, d, f"t{d}", f"{d}.pdf") for d in (8, 9, 15, 16, 17)] and len(written) == 3


def test_nested_links_read_any_value(spark):
    cells = ["2024", "1.50", "1e3", "true", "null", '""', '"  "', '" a "', "[]", "{}", '{"x": "download"}', '["download", 1]', '"a.pdf"', '"é<\\u0041>.PDF#1"']
    texts = [f'{{"title": {a}, "name": "n", "url": {b}, "URL": "U.pdf", "in": {{"to": "to.pdf"}}}}' for a in cells for b in cells]
    texts += ['{"title": "t", "title": "u", "url": "a.pdf"}', '{"title": "t", "url": "a.pdf"} more', '{"title": "t", "url": "a.pdf"', '"a.pdf"', '["title", "url", "a.pdf"]', '{"Title": "t", "link": "a.pdf"}', "{}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    kinds, titles = r"(?i)\.pdf(?:[?#]|$)|download", ("title", "name")
    for urls in (("url",), ("URL",), ("url", "URL"), ("in.to", "url")):
        one = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("v", f"$.{f}", "string")), F.lit("")) for f in names])
        want = docs.withColumn("v", F.try_parse_json("j")).select("id", one(titles).alias("title"), one(urls).alias("url")).where(F.col("title").isNotNull() & F.col("url").rlike(kinds))
        got = documents.nested_links(docs, "j", url_fields=urls, title_fields=titles).where("depth = 0").select("id", "title", "url")
        assert sorted(got.collect()) == sorted(want.collect()) != []


PAGE = """<p data-claim-id="c1">x<p data-claim-id='c1'><i data-claim-id="${no}"></i><b data-claim-id="c2"></b><iframe src="/f?a=1&amp;b=2"></iframe>
<table><tr><td rowspan=2>A<td colspan="2">B &amp; <a href='/u'>l</a><br>c</tr><tr><th>D<td><table><tr><td>in</table> E</tr>
<script>document.write("<td>no</td>")</script><tr><td rowspan=x>F</table><td>out of a table</td>"""


def test_page_parts(spark):
    rows = {r.page_id: r for r in documents.page_parts(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<table><tr><td>open <b>cell")], "page_id int, html string")).collect()}
    assert rows[1].frames == ["/f?a=1&b=2"] and rows[1].claims == ["c1", "c2"]
    cells = {(c.table, c.row, c.column): (c.header, c.spanned, c.text, c.links) for c in rows[1].cells}
    assert cells == {
        (0, 0, 0): (False, False, "A", []), (0, 1, 0): (False, True, "A", []), (0, 0, 1): (False, False, "B & l c", ["/u"]), (0, 0, 2): (False, True, "B & l c", ["/u"]), (0, 1, 1): (True, False, "D", []),
        (0, 1, 2): (False, False, "E", []), (1, 0, 0): (False, False, "in", []), (0, 2, 0): (False, False, "F", []),
    }
    assert (rows[2].cells, rows[2].frames, rows[2].claims) == ([], [], []) == (rows[3].cells, rows[3].frames, rows[3].claims)
    assert [(c.text, c.row) for c in rows[4].cells] == [("open cell", 0)]


@pytest.mark.parametrize("address, want", [("x!2d77.1!3d28.5y", ("28.5", "77.1", "embed")), ("/@28.5,-77,15z", ("28.5", "-77", "place")), ("/m?q=1,2", ("1", "2", "query")), ("/m", None)])
def test_map_points(spark, address, want):
    found = spark.range(1).select(documents.map_point(F.lit(address)).alias("p")).first().p
    assert (found and tuple(found)) == want


ROWS = "".join(f"<tr><td class=c>part <b>{i}</b> <a href='/p/{i}'>l</a></td><TD>{i}<td rowspan=2 colspan=\"2\">&amp; x" for i in range(3))
PLAIN = f"<p data-claim-id='c'>x<table><script type=t>var a='<td>';</script><tr><th colspan=2>A &lt; B<th> n </th></tr>\n{ROWS}</table>y<A HREF=/q>"


def test_plain_markup_needs_no_parser(monkeypatch):
    want = documents._parts(documents._Tokens(PLAIN).tokens, dict, str, set())
    assert len(want[0]) == 21 and want[2] == ["c"] and len(want[3]) == 4
    monkeypatch.setattr(documents, "_Tokens", None)
    assert documents.parts_of(PLAIN.replace("=/q", "='/q'")) == want


def test_any_markup_as_by_the_parser(spark):
    rnd = random.Random(13)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "<TD >", "</td>", "<th colspan=2>", "<td rowspan='2'>", "<a href='/u'>", "</a>", "text ", "&amp; ", "<br>", "<script>if (a<b) x='<td>';</script>", "<td a=1 a=2 rowspan=2>", "<b class='x'>", "</b>"]
    odd = ["<td rowspan=0>", "&lt", "&#6", "<br/>", "<!-- c <td> -->", "<script>", "</script>", "<style", "</", " < ", "<3", ">", "</b >", "<iframe src=/g>", "<title>", "</title>", "<input disabled>", "<td a='1'b='2'>", "<?pi>", "<td\n rowspan=2\n>", "<td rowspan = 2>", "<a href='x&amp;y'>", "<td a='<'>", "<script>x</style>"]
    pages = ["".join(rnd.choice(bits if n % 2 or rnd.random() < 0.9 else odd) for _ in range(rnd.randint(0, 25))) for n in range(3000)]
    found = [documents.parts_of(p) for p in pages]
    assert found == [documents._parts(documents._Tokens(p).tokens, dict, str, set()) for p in pages]
    made = spark.createDataFrame(list(enumerate([*pages[:200], None])), "page_id int, html string")
    cells = [(r.page_id, r.table, r.row, r.column, r.header, r.spanned, r.text, tuple(r.links)) for r in documents.table_cells(made).collect()]
    assert sorted(cells) == sorted((i, *c[:6], tuple(c[6])) for i, f in enumerate(found[:200]) for c in f[0])

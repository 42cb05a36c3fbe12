"""Pages and nested catalogues as rows: links of JSON at any depth, table cells of HTML."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import forms
from wardlight.plans.session import cut_lineage

#: Fields that hold a link or its title, the first filled one counts.
URL_FIELDS, TITLE_FIELDS = ("url", "href", "link", "file", "path"), ("title", "name", "label", "menuName")


#: Levels of nesting that one stage opens.
_LEVELS = 8


def _met(docs: DataFrame, json_col: str, id_col: str, kept: Callable[[DataFrame], DataFrame], fields: str) -> DataFrame:
    """(id, fields): what `kept` makes of the values in a column of JSON texts, at any depth; it adds `_kept`, a struct of the fields or null, to rows of (path, depth, value).

    A row is a value with what was kept on the way to it, which goes on with the first value inside, so that several levels are opened in one stage. Then what was kept is written, with the containers still to be opened: depth
    costs a job for every eight levels, and neither rows nor nesting are bounded.
    """
    spark, none, out = docs.sparkSession, F.array().cast(f"array<struct<{fields}>>"), None
    rows = docs.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(json_col).alias("value"), none.alias("_all"))
    first = F.coalesce(F.col("c.pos") == 0, F.lit(True))
    step = F.when(F.col("c.key").isNull(), F.concat(F.lit("["), F.col("c.pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("c.key")))
    while True:
        for _ in range(_LEVELS):
            rows = kept(rows).withColumn("_all", F.when(F.col("_kept").isNull(), F.col("_all")).otherwise(F.concat("_all", F.array("_kept"))))
            kids = rows.alias("p").lateralJoin(spark.tvf.variant_explode_outer(F.col("p.value").outer()).alias("c"))
            rows = kids.select("p.id", F.concat("p.path", step).alias("path"), (F.col("p.depth") + 1).alias("depth"), "c.value", F.when(first, F.col("p._all")).otherwise(none).alias("_all")).where("value is not null or size(_all) > 0")
        rows = cut_lineage(rows.withColumn("value", F.when(_is_container("value"), F.col("value"))).where("value is not null or size(_all) > 0"))
        met = rows.select("id", F.inline("_all"))
        out = met if out is None else out.unionByName(met)
        rows = rows.where("value is not null").withColumn("_all", none)
        if rows.isEmpty():
            return out


def _is_container(value: str) -> Column:
    """Whether a VARIANT is an object or an array, without a look at what lies in it."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull() | F.try_variant_get(value, "$", "array<struct<>>").isNotNull()


def nodes(docs: DataFrame, json_col: str, id_col: str = "id") -> DataFrame:
    """(id, path, depth, value): every object and array in a column of JSON texts, at any depth, the whole one included; value is a VARIANT, path is `$` with `.key` and `[place]` steps. A text that is no JSON, or null, has no
    node; a lone value is none."""
    kept = lambda rows: rows.withColumn("_kept", F.when(_is_container("value"), F.struct("path", "depth", "value")))
    return _met(docs, json_col, id_col, kept, "path string, depth int, value variant")


def nested_links(docs: DataFrame, json_col: str, id_col: str = "id", url_fields: tuple[str, ...] = URL_FIELDS, title_fields: tuple[str, ...] = TITLE_FIELDS, kinds: str = r"(?i)\.pdf(?:[?#]|$)|download") -> DataFrame:
    """(id, path, depth, title, url): every object, however deep, with a link of the wanted kind and a title; a link that an id has twice is kept once, where it stands highest and first by path."""
    names = [f for f in dict.fromkeys((*title_fields, *url_fields)) if re.fullmatch(r"\w+", f)]
    names = [f for f in names if [g.lower() for g in names].count(f.lower()) == 1]  # read together; paths and names that differ by case alone are read one by one
    cell = lambda f: F.col(f"_object.{f}") if f in names else F.try_variant_get("value", f"$.{f}", "string")
    text = lambda fields: F.coalesce(*[F.nullif(F.trim(cell(f)), F.lit("")) for f in fields])

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_object", F.try_variant_get("value", "$", f"struct<{', '.join(f'`{f}` string' for f in names)}>"))
        rows = rows.withColumn("_link", F.when(F.col("_object").isNotNull(), F.struct("path", "depth", text(title_fields).alias("title"), text(url_fields).alias("url"))))
        return rows.withColumn("_kept", F.when(F.col("_link.title").isNotNull() & F.col("_link.url").rlike(kinds), F.col("_link")))

    # spread by what is grouped, since the least of structs is found by sorting: once, and not whatever a reader packs into a task
    found = _met(docs, json_col, id_col, kept, "path string, depth int, title string, url string").repartition("id", "url")
    return found.groupBy("id", "url").agg(F.min(F.struct("depth", "path", "title")).alias("_f")).select("id", "_f.path", "_f.depth", "_f.title", "url")


#: Plain markup is split by one pattern into tokens: text, then an end tag, a whole script or style, a start tag whose attributes all have values without references, or the end. A `<` that begins none of these is odd.
_ATTRIBUTE = re.compile(r"""[ \t\n\r\f]++([a-zA-Z][a-zA-Z0-9-]*+)=(?:'([^'<>&]*+)'|"([^"<>&]*+)"|([a-zA-Z0-9._%-]++))(?=[ \t\n\r\f>]|\Z)""")
_ATTRIBUTES = rf"((?:{re.sub(r'[(](?=[^?])', '(?:', _ATTRIBUTE.pattern)})*+)[ \t\n\r\f]*+"
_TOKEN = re.compile(rf"([^<]*+)(?:</([a-zA-Z][a-zA-Z0-9]*+)>|<((?i:script|style)){_ATTRIBUTES}>(?:[^<]++|<(?![/!sS]))*+</(?i:\3)>|<([a-zA-Z][a-zA-Z0-9]*+){_ATTRIBUTES}>|(<)|\Z)")
#: Elements without text, and those whose content is no markup to the parser.
_HIDDEN = {"script", "style"}
_RAW = {"plaintext", *_HIDDEN, *getattr(HTMLParser, "CDATA_CONTENT_ELEMENTS", ()), *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())}


def _given(attributes: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}


class _Tokens(HTMLParser):
    """The tokens of any page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tokens.append(("", "", "", "", tag, attrs, ""))

    def handle_endtag(self, tag: str) -> None:
        self.tokens.append(("", tag, "", "", "", "", ""))

    def handle_data(self, data: str) -> None:
        self.tokens.append((data, "", "", "", "", "", ""))


def _span(given: dict, name: str) -> int:
    return min(max(int(v), 1), 1000) if (v := given.get(name) or "").isdigit() else 1  # as browsers bound it


def _end_cell(cells: list, held: set, no: int, row: int, column: int, cell: tuple) -> int:
    """Adds a cell in each place that it spans; the column after it."""
    header, words, links, rows, columns = cell
    text = " ".join("".join(words).split())
    if rows == columns == 1:
        cells.append((no, row, column, header, False, text, links))
        return column + 1
    for r in range(rows):
        for c in range(columns):
            if r:  # its own row is past these places
                held.add((row + r, column + c))
            cells.append((no, row + r, column + c, header, r > 0 or c > 0, text, links))
    return column + columns


def _end_anchor(anchors: list, anchor: tuple | None) -> None:
    if anchor:
        anchors.append((anchor[0], " ".join("".join(anchor[1]).split())))


def _parts(tokens: list[tuple], given_of: Callable, decode: Callable, refused: set) -> tuple[list, list, list, list] | None:
    """Cells of a page as (table, row, column, header, spanned, text, links), frames, claims and anchors; None if a token is odd or refused. A cell that spans rows or columns stands in each place of the grid; a new cell, row or
    table closes what is open inside."""
    cells, frames, claims, anchors = [], [], [], []
    anchor = cell = no = None  # those open; the tables around the innermost are on the stack
    row = column = tables = hidden = 0
    held, stack, none = set(), [], {}
    for text, end, script, of_script, start, of_start, odd in tokens:
        if text and not hidden:
            if "&" in text:
                text = decode(text)
            if anchor:
                anchor[1].append(text)
            if cell:
                cell[1].append(text)
        if start or script:
            tag, of = (start.lower(), of_start) if start else (script, of_script)
            given = given_of(of) if of else none
            if given and (claim := given.get("data-claim-id")) and "${" not in claim and claim not in claims:
                claims.append(claim)
            if script:
                continue
            if tag == "td" or tag == "th":
                if no is not None:
                    if cell:
                        column = _end_cell(cells, held, no, row, column, cell)
                    if row < 0:
                        row = column = 0
                    while held and (row, column) in held:
                        column += 1
                    cell = (tag == "th", [], [], _span(given, "rowspan"), _span(given, "colspan")) if given else (tag == "th", [], [], 1, 1)
            elif tag == "tr":
                if no is not None:
                    if cell:
                        _end_cell(cells, held, no, row, column, cell)
                    cell, row, column = None, row + 1, 0
            elif tag == "table":
                stack.append((no, row, column, held, cell))
                no, row, column, held, cell = tables, -1, 0, set(), None
                tables += 1
            elif tag in refused:
                return None
            elif tag in _HIDDEN:
                hidden += 1
            elif tag == "iframe" and given.get("src"):
                frames.append(given["src"])
            else:
                if tag == "a":
                    _end_anchor(anchors, anchor)
                    anchor = (given["href"], []) if given.get("href") else None
                if cell:
                    if given.get("href"):
                        cell[2].append(given["href"])
                    cell[1].append(" ")
        elif end:
            tag = end.lower()
            if tag == "td" or tag == "th" or tag == "tr":
                if cell:
                    column, cell = _end_cell(cells, held, no, row, column, cell), None
            elif tag == "table":
                if no is not None:
                    if cell:
                        _end_cell(cells, held, no, row, column, cell)
                    no, row, column, held, cell = stack.pop()
            elif tag in _HIDDEN:
                hidden = max(0, hidden - 1)
            else:
                if tag == "a":
                    _end_anchor(anchors, anchor)
                    anchor = None
                if cell:
                    cell[1].append(" ")
        elif odd:
            return None
    _end_anchor(anchors, anchor)
    while no is not None:
        if cell:
            _end_cell(cells, held, no, row, column, cell)
        no, row, column, held, cell = stack.pop()
    return cells, frames, claims, anchors


def parts_of(html: str | None) -> tuple[list, list, list, list]:
    """Cells, frames, claims and anchors of a page. What isn't plain markup goes to the parser, with the same result in several times the time."""
    return _parts(_TOKEN.findall(html or ""), _given, unescape, _RAW) or _parts(_Tokens(html).tokens, dict, str, set())


CELL = pa.struct([("table", pa.int32()), ("row", pa.int32()), ("column", pa.int32()), ("header", pa.bool_()), ("spanned", pa.bool_()), ("text", pa.string()), ("links", pa.list_(pa.string()))])

#: Cells that a task holds before it passes them on.
CELLS_AT_ONCE = 20_000

ANCHOR = pa.struct([("href", pa.string()), ("label", pa.string())])


def page_parts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, cells, frames, claims, anchors) of each page: cells as structs (table, row, column, header, spanned, text, links) in the page's order, addresses of frames, ids of claims, each once, and anchors as structs
    (href, label). A null page has empty arrays."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, frames, claims, anchors = [], [], [], []
            for html in batch.column(1).to_pylist():
                of_cells, of_frames, of_claims, of_anchors = parts_of(html)
                cells.append([dict(zip(("table", "row", "column", "header", "spanned", "text", "links"), c, strict=True)) for c in of_cells])
                frames.append(of_frames)
                claims.append(of_claims)
                anchors.append([{"href": h, "label": label} for h, label in of_anchors])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(CELL)), pa.array(frames, pa.list_(pa.string())), pa.array(claims, pa.list_(pa.string())), pa.array(anchors, pa.list_(ANCHOR))], [id_col, "cells", "frames", "claims", "anchors"])

    kind = "array<struct<table:int,row:int,column:int,header:boolean,spanned:boolean,text:string,links:array<string>>>"
    return pages.select(id_col, html_col).mapInArrow(parsed, f"`{id_col}` {id_type}, cells {kind}, frames array<string>, claims array<string>, anchors array<struct<href:string,label:string>>")


def table_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each place of each table of each page, in no order of rows: id, table, row, column, header, spanned, text, links."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def rows(ids: pa.Array, at: list[int], cells: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, f.type) for f, values in zip(CELL, zip(*cells, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], [id_col, *[f.name for f in CELL]])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                found = parts_of(html)[0]
                at.extend([i] * len(found))
                cells.extend(found)
                if len(cells) >= CELLS_AT_ONCE:
                    yield rows(batch.column(0), at, cells)
                    at, cells = [], []
            if cells:
                yield rows(batch.column(0), at, cells)

    kind = "table int, row int, column int, header boolean, spanned boolean, text string, links array<string>"
    return pages.select(id_col, html_col).mapInArrow(parsed, f"`{id_col}` {id_type}, {kind}")


def map_point(address: Column) -> Column:
    """Struct (lat, lon, source) of a map's address: an embedded map, a place, a query; null without a point."""
    n = r"(-?[0-9]+(?:\.[0-9]+)?)"
    forms = (("embed", rf"!2d{n}!3d{n}", 2, 1), ("place", rf"@{n},{n}", 1, 2), ("query", rf"[?&]q={n},{n}", 1, 2))
    return F.coalesce(*[F.when(address.rlike(p), F.struct(F.regexp_extract(address, p, a).alias("lat"), F.regexp_extract(address, p, b).alias("lon"), F.lit(name).alias("source"))) for name, p, a, b in forms])


def locations(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, name, address, lat, lon, source): the addresses of a page's tables: rows whose first cell says 'address', under the last row of one cell, which names the place ('' before the first; notices of hours and branches name none).

    The point is that of the first map link of the address's cell, or, for the first address of a page, of its first frame with one.
    """
    parts = page_parts(pages, id_col, html_col)
    own = F.filter("cells", lambda c: ~c["spanned"])
    rows = F.array_distinct(F.transform(own, lambda c: F.struct(c["table"].alias("table"), c["row"].alias("row"))))
    shaped = F.transform(rows, lambda r: F.filter(own, lambda c: (c["table"] == r["table"]) & (c["row"] == r["row"])))
    start = F.struct(F.lit("").alias("name"), F.array().cast("array<struct<name:string,address:string,links:array<string>>>").alias("found"))

    def add(s: Column, row: Column) -> Column:
        first, second = F.get(row, F.lit(0)), F.get(row, F.lit(1))
        title = (F.size(row) == 1) & (first["text"] != "") & ~F.lower(first["text"]).rlike("opening hours|branches and")
        place = (F.size(row) > 1) & F.contains(F.lower(first["text"]), F.lit("address")) & (second["text"] != "")
        one = F.struct(s["name"].alias("name"), second["text"].alias("address"), second["links"].alias("links"))
        return F.struct(F.when(title, first["text"]).otherwise(s["name"]).alias("name"), F.when(place, F.concat(s["found"], F.array(one))).otherwise(s["found"]).alias("found"))

    found = parts.select(id_col, "frames", F.posexplode(F.aggregate(shaped, start, add, lambda s: s["found"])).alias("no", "_p"))
    link = F.get(F.filter("_p.links", lambda u: F.lower(u).rlike("map|goo[.]gl")), F.lit(0))
    framed = F.get(F.filter(F.transform("frames", map_point), lambda p: p.isNotNull()), F.lit(0))
    point = F.coalesce(map_point(link), F.when(F.col("no") == 0, framed))
    return found.select(id_col, F.col("_p.name").alias("name"), F.col("_p.address").alias("address"), point.alias("_at")).select(id_col, "name", "address", "_at.lat", "_at.lon", "_at.source")


def finance_links(pages: DataFrame, keywords: list[str], kind: str, id_col: str = "page_id", html_col: str = "html", base_col: str = "url") -> DataFrame:
    """(id, year, label, url): anchors with a keyword and a document's address, of a year that the label or else the address names (see forms.year_of_link); a year and address that a page has twice count once, the first of them.

    A blank label is the kind and the year; addresses are resolved against the page's.
    """
    anchors = page_parts(pages.select(id_col, html_col), id_col, html_col).select(id_col, F.posexplode("anchors").alias("at", "a"))
    told = F.lower(F.concat_ws(" ", "a.label", "a.href"))
    wanted = F.lit(False)
    for k in keywords:
        wanted = wanted | F.contains(told, F.lit(k.lower()))
    kept = anchors.where(wanted & told.rlike(r"\.pdf|viewfile")).withColumn("year", F.coalesce(forms.year_of_link(F.col("a.label")), forms.year_of_link(F.col("a.href")))).where("year is not null")
    based = kept.join(pages.select(id_col, F.col(base_col).alias("_base")), id_col)
    href, base = F.trim("a.href"), F.col("_base")
    host = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    url = F.when(href.rlike("^[a-z]+:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), href)).when(F.startswith(href, F.lit("/")), F.concat(host, href)).otherwise(F.concat(folder, href))
    first = based.withColumn("url", url).groupBy(id_col, "year", "url").agg(F.min_by("a.label", "at").alias("label"))
    return first.select(id_col, "year", F.when(F.col("label") == "", F.concat(F.lit(f"{kind} "), F.col("year"))).otherwise(F.col("label")).alias("label"), "url")

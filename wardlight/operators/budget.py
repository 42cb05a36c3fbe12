"""Budget lines from sources of several shapes, and figures read beside their labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import coerce, stats

LINE = ("fiscal_year", "basis", "section", "flow", "category", "head", "entity", "amount", "raw", "source", "confidence", "method")
#: A grant told in a text: who gets it, and the amount in crores.
GRANT = r"(?i)grant to ([^.;\n]{2,60}?) (?:of|is) Rs\.? ?([0-9][0-9,]*(?:\.[0-9]+)?) ?crores?"
#: Amounts beyond it are in other units.
MOST_CRORES = 100_000


def _lines(df: DataFrame, loader: int, order: Column, **columns: Column) -> DataFrame:
    """A loader's rows in the common columns; those it doesn't know are null."""
    of = lambda c: F.round(columns["amount"].cast("double"), 4) if c == "amount" else columns.get(c, F.lit(None)).cast("string")
    return df.select(F.lit(loader).alias("loader"), order.alias("position"), *[of(c).alias(c) for c in LINE])


def verified_lines(rows: DataFrame, line_map: DataFrame, order: str = "position") -> DataFrame:
    """Loader 1: checked lines (fiscal_year, line, account_head, amount, raw, source, confidence, position). line_map: (line, entity, category, head, section, flow); an unmapped line is its own head of other expenditure."""
    known = rows.join(line_map, "line", "left")
    head = F.lower(F.coalesce("account_head", F.lit("")))
    basis = F.when(head.rlike("actual|spend"), "actual").when(F.contains(head, F.lit("revised")), "RE").otherwise("BE")
    c = F.col
    return _lines(
        known, 1, c(order).cast("long"), fiscal_year=c("fiscal_year"), basis=basis, section=c("section"), flow=c("flow"), category=F.coalesce("category", F.lit("other_expenditure")), head=F.coalesce("head", "line"), entity=c("entity"),
        amount=c("amount"), raw=c("raw"), source=c("source"), confidence=F.coalesce("confidence", F.lit("high")), method=F.lit("manual_verified"),
    )


def json_components(docs: DataFrame, entity: str, parts: dict[str, tuple[str, str, str]], totals: dict[str, tuple[str, str, str, str]], json_col: str = "json", order: str = "position") -> DataFrame:
    """Loader 2: yearly JSON objects. parts: field of an object of components to (prefix of heads, category, flow); totals: field of a number to (head, category, flow, section). Values that aren't numbers are left out."""
    def part(head: Column, value: Column, category: str, flow: str, section: str) -> Column:
        return F.struct(head.alias("head"), value.alias("value"), F.lit(category).alias("category"), F.lit(flow).alias("flow"), F.lit(section).alias("section"))

    def components(field: str, prefix: str, category: str, flow: str) -> Column:
        entries = F.map_entries(F.from_json(F.get_json_object(json_col, f"$.{field}"), "map<string,string>"))
        return F.transform(entries, lambda e: part(F.concat(F.lit(prefix), F.replace(e["key"], F.lit("_"), F.lit(" "))), e["value"], category, flow, "revenue"))

    maps = [components(field, *named) for field, named in parts.items()]
    one = [part(F.lit(head), F.get_json_object(json_col, f"$.{field}"), category, flow, section) for field, (head, category, flow, section) in totals.items()]
    none = F.array().cast("array<struct<head:string,value:string,category:string,flow:string,section:string>>")
    every = F.concat(*[F.coalesce(m, none) for m in maps], F.array(*one) if one else none)
    rows = docs.select(F.get_json_object(json_col, "$.year").alias("fiscal_year"), F.get_json_object(json_col, "$.source").alias("source"), order, F.posexplode(every).alias("_i", "c"))
    rows = rows.where(F.col("c.value").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"))
    c = F.col
    return _lines(rows, 2, c(order).cast("long") * 10_000 + c("_i"), fiscal_year=c("fiscal_year"), basis=F.lit("BE"), section=c("c.section"), flow=c("c.flow"), category=c("c.category"), head=c("c.head"), entity=F.lit(entity), amount=c("c.value"), raw=c("c.value"), source=c("source"), confidence=F.lit("medium"), method=F.lit("text"))


def wide_lines(rows: DataFrame, columns: dict[str, tuple[str, str | None, str, str | None, str]], order: str = "position") -> DataFrame:
    """Loader 3: a table with a column for each headline (fiscal_year, the columns, confidence, position), blanks left out. columns: name to (head, entity, category, flow, section)."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(head).alias("head"), F.lit(entity).alias("entity"), F.lit(category).alias("category"), F.lit(flow).alias("flow"), F.lit(section).alias("section"), F.nullif(F.trim(F.col(name).cast("string")), F.lit("")).alias("value")) for i, (name, (head, entity, category, flow, section)) in enumerate(columns.items())])
    rows = rows.select("fiscal_year", "confidence", order, F.explode(each).alias("c")).where("c.value is not null")
    c = F.col
    return _lines(rows, 3, c(order).cast("long") * 1000 + c("c.i"), fiscal_year=c("fiscal_year"), basis=F.lit("BE"), section=c("c.section"), flow=c("c.flow"), category=c("c.category"), head=c("c.head"), entity=c("c.entity"), amount=c("c.value"), raw=c("c.value"), confidence=F.coalesce("confidence", F.lit("medium")), method=F.lit("manual_verified"))


def told_grants(docs: DataFrame, text_col: str = "text", order: str = "position") -> DataFrame:
    """Loader 4: grants told in the texts of (fiscal_year, text, source, position); amounts beyond MOST_CRORES are left out."""
    found = lambda k: F.regexp_extract_all(text_col, F.lit(GRANT), F.lit(k))
    rows = docs.select("fiscal_year", "source", order, F.posexplode(F.arrays_zip(found(0).alias("raw"), found(1).alias("name"), found(2).alias("amount"))).alias("_i", "g"))
    amount = F.replace("g.amount", F.lit(","), F.lit("")).cast("double")
    name = F.regexp_replace(F.regexp_replace("g.name", r"\s+", " "), r"^[ .,]+|[ .,]+$", "")
    c = F.col
    return _lines(rows.where(amount <= MOST_CRORES), 4, c(order).cast("long") * 10_000 + c("_i"), fiscal_year=c("fiscal_year"), basis=F.lit("BE"), section=F.lit("revenue"), flow=F.lit("expenditure"), category=F.lit("grant_contribution"), head=F.concat(F.lit("Grant to "), name), amount=amount, raw=c("g.raw"), source=c("source"), confidence=F.lit("low"), method=F.lit("text"))


def first_loader_wins(*loaders: DataFrame) -> DataFrame:
    """One row for each year, basis, entity and head of all loaders' rows: that of the first loader, then position; nulls of a key are alike."""
    rows = reduce(DataFrame.unionByName, loaders)
    return stats.first_wins(rows.withColumn("entity", F.coalesce("entity", F.lit(""))), ["fiscal_year", "basis", "entity", "head"], ["loader", "position", "raw", "amount"])


def labelled_candidates(lines: DataFrame, labels: dict[str, str], by: list[str], order: str = "line_no", text_col: str = "text") -> DataFrame:
    """(by, label, candidates, raw): for each label the first line of a document that its pattern is found in and that has a number other than 0; candidates joins the numbers by '|', raw is the line's first 180 characters."""
    tested = F.array(*[F.struct(F.lit(k).alias("label"), F.col(text_col).rlike(p).alias("fits")) for k, p in labels.items()])
    numbers = F.filter(coerce.numeric_tokens(F.col(text_col)), lambda n: n != 0)
    rows = lines.withColumn("_n", numbers).where(F.size("_n") > 0).select(*by, order, "_n", F.trim(text_col).alias("_raw"), F.explode(F.filter(tested, lambda t: t["fits"])).alias("t"))
    best = rows.groupBy(*by, F.col("t.label").alias("label")).agg(F.min(F.struct(order, "_n", "_raw")).alias("_b"))
    plain = lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return best.select(*by, "label", F.array_join(F.transform("_b._n", plain), "|").alias("candidates"), F.substring("_b._raw", 1, 180).alias("raw"))


def rows_of_labels(lines: DataFrame, labels: DataFrame, by: list[str], columns: int, order: str = "line_no", text_col: str = "text") -> DataFrame:
    """(by, label, figures): for each document and label the first line that begins with the label's text and has as many numbers after it as there are columns; labels: (label, begins). Raises where a document lacks one.

    Labels are few and broadcast if they are; a line is tested with each.
    """
    fits = F.startswith(F.lower(F.trim(text_col)), F.lower("begins"))
    after = F.substring(F.trim(text_col), F.length("begins") + 1, F.length(text_col))
    figures = F.transform(F.regexp_extract_all(after, F.lit(r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double"))
    found = lines.join(labels, fits).withColumn("_n", figures).where(F.size("_n") == columns)
    best = found.groupBy(*by, "label").agg(F.min_by("_n", order).alias("_n"))
    wanted = lines.select(*by).distinct().crossJoin(labels.select("label").distinct())  # a row for each document and label
    joined = wanted.join(best, [*by, "label"], "left")
    missing = F.raise_error(F.concat(F.lit("no line for "), F.col("label"), F.lit(" in "), F.concat_ws("/", *[F.col(c).cast("string") for c in by])))
    return joined.select(*by, "label", F.coalesce("_n", missing.cast("array<double>")).alias("figures"))


def cells_by_title(cells: DataFrame, by: list[str], title: str, label_column: int, heads: dict[str, str]) -> DataFrame:
    """(by, table, label, a column for each head): rows of those tables, of (by, table, row, column, text), one of whose cells holds the title, by their labels; heads: output name to the text of its column's header, which must be equal without regard to case and blanks. Figures are read as numbers."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    key = [*by, "table"]
    titled = cells.where(F.contains(plain(F.col("text")), F.lit(title.lower()))).select(*key).distinct()
    own = cells.join(titled, key, "left_semi")
    headers = own.groupBy(*key, F.col("column")).agg(*[F.min(F.when(plain(F.col("text")) == text.lower(), F.col("row"))).alias(name) for name, text in heads.items()])
    place = headers.groupBy(*key).agg(*[F.min(F.when(F.col(name).isNotNull(), F.col("column"))).alias(f"_{name}") for name in heads], F.min(F.greatest(*[F.coalesce(name, F.lit(-1)) for name in heads]) if len(heads) > 1 else F.coalesce(*heads, F.lit(-1))).alias("_low"), F.max(F.greatest(*[F.coalesce(name, F.lit(-1)) for name in heads]) if len(heads) > 1 else F.coalesce(*heads, F.lit(-1))).alias("_head_row"))
    body = own.join(place, key).where(F.col("row") > F.col("_head_row"))
    rows = body.groupBy(*key, "row").agg(F.max(F.when(F.col("column") == label_column, F.trim("text"))).alias("label"), *[F.max(F.when(F.col("column") == F.col(f"_{name}"), F.col("text"))).alias(name) for name in heads])
    number = lambda c: F.regexp_replace(c, "[, ]", "").try_cast("double")
    return rows.where(F.col("label") != "").select(*key, "label", *[number(F.col(name)).alias(name) for name in heads])


STAFF = ("sanctioned", "filled", "vacant", "professional_sanctioned", "ministerial_sanctioned", "professional_filled", "ministerial_filled", "professional_vacant", "ministerial_vacant")


def staffing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with STAFF, vacancy_rate and status: from the table of posts ('observed_split' with six figures after its totals, else 'observed_total_only'), else the sentence on staff strength, else 'not_found' and nulls."""
    text = F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), "[\\s ]+", " "))
    table = r"(?i)Total Posts Sanctioned\s*:\s*(\d+)\s+Filled\s*up(?:\s+Post)?\s*:\s*(\d+)\s+Vacant\s*Post\s*:\s*(\d+)(.{0,260})"
    told = r"(?i)sanctioned staff strength of\s+(\d+)\s+comprising of\s+(\d+)\s+professionals?\s+and\s+(\d+)\s+Non-Professionals?,\s+out of which\s+(\d+)\s+posts?\s+are\s+lying\s+vacant"
    n = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).try_cast("long")
    parts = docs.select("*", text.rlike(table).alias("_table"), text.rlike(told).alias("_told"), *[n(table, k).alias(f"_a{k}") for k in (1, 2, 3)], *[n(told, k).alias(f"_b{k}") for k in (1, 2, 3, 4)], F.regexp_extract_all(F.regexp_extract(text, table, 4), F.lit(r"\b(\d+)\b"), F.lit(1)).alias("_tail"))
    t, b = F.col("_table"), F.col("_told")
    tail, whole = lambda k: F.get("_tail", F.lit(k)).try_cast("long"), F.size("_tail") >= 6
    pair = F.size("_tail") >= 2
    values = [
        F.when(t, F.col("_a1")).when(b, F.col("_b1")), F.when(t, F.col("_a2")).when(b, F.col("_b1") - F.col("_b4")), F.when(t, F.col("_a3")).when(b, F.col("_b4")), F.when(t, F.when(pair, tail(0))).when(b, F.col("_b2")), F.when(t, F.when(pair, tail(1))).when(b, F.col("_b3")),
        *[F.when(t & whole, tail(k)) for k in (2, 3, 4, 5)],
    ]
    read = parts.select(*docs.columns, *[v.alias(name) for v, name in zip(values, STAFF, strict=True)], F.when(t & whole, "observed_split").when(t | b, "observed_total_only").otherwise("not_found").alias("status"))
    return read.withColumn("vacancy_rate", F.round(F.try_divide(F.col("vacant") * 100.0, F.col("sanctioned").cast("double")), 1))

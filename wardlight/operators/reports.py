"""Rows from the text of reports: rosters of numbered blocks, annual figures that must add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import geo

#: The digits of Gujarati script, in order.
GUJARATI_DIGITS = "૦૧૨૩૪૫૬૭૮૯"
#: A mobile number of ten digits, with or without the country's prefix.
PHONE = r"(?<![0-9])(?:\+?91[- ]?)?[6-9][0-9]{9}(?![0-9])"
#: Characters of a section that are read after its heading.
SECTION, FINANCE_SECTION, STOCK_SECTION = 3000, 2500, 5000


def lines_of(text: Column) -> Column:
    """The lines of a text that have a character, blanks inside as one, digits as 0 to 9."""
    plain = F.translate(F.coalesce(text, F.lit("")), GUJARATI_DIGITS, "0123456789")
    each = F.transform(F.split(plain, r"\r\n|[\n\r\x0b\x0c\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(each, lambda x: x != "")


def serial_of(line: Column) -> Column:
    """The number of up to three digits that begins a line and stands alone there, else null."""
    return F.nullif(F.regexp_extract(line, r"^([0-9]{1,3})(?: |$)", 1), F.lit("")).cast("int")


def serial_blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with serial and lines, a row for each block of a document: from a line that begins with the number that comes next, 1 at first, to the line before the next such one.

    Whether a line begins a block depends on whether the number before it was found, so the lines are folded with the number expected; the fold keeps the places of the starts alone (999 at most). Numbers out of
    turn, skipped or repeated ones, are lines like others. Lines before the first block are left out; a document without one has no row.
    """
    lined = docs.withColumn("_lines", lines_of(F.col(text_col)))
    starts = F.aggregate(
        F.transform("_lines", lambda x, i: F.struct(serial_of(x).alias("serial"), i.alias("at"))), F.array().cast("array<int>"),
        lambda found, x: F.when(x["serial"] == F.size(found) + 1, F.concat(found, F.array(x["at"]))).otherwise(found),
    )
    each = lined.withColumn("_starts", starts).select("*", F.posexplode("_starts").alias("_k", "_at"))
    upto = F.coalesce(F.get("_starts", F.col("_k") + 1), F.size("_lines"))
    return each.select(*docs.columns, (F.col("_k") + 1).alias("serial"), F.slice("_lines", F.col("_at") + 1, upto - F.col("_at")).alias("lines"))


def roster(blocks: DataFrame, zones: list[str], parties: dict[str, str], address_words: list[str], seats: int = 4) -> DataFrame:
    """blocks (with serial and lines) with seat_ward, ward, zone, member, party, phones.

    A block is its ward, one of the zones, and the member, who ends at the first line with a digit, a comma, an address word or a party. Without a zone the first line is the member. The ward's number follows from the
    serial, so many seats a ward. party: the first whose pattern is found in the block; phones: each once.
    """
    rest = F.concat(F.array(F.regexp_replace(F.get("lines", F.lit(0)), "^[0-9]{1,3} ?", "")), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))))
    payload = F.array_join(F.filter(rest, lambda x: x != ""), "\n")
    zone = f"(?s)^(.*?)((?:{'|'.join(z.replace(' ', chr(92) + 's+') for z in zones)}))(?!\\p{{L}})(.*)$"
    found = payload.rlike(zone)
    part = lambda k: F.trim(F.regexp_replace(F.regexp_extract(payload, zone, k), r"\s+", " "))
    after = F.split(F.regexp_replace(F.regexp_extract(payload, zone, 3), r"^ ", ""), "\n")
    stop = "|".join([r"[0-9,]", *address_words, *parties.values()])
    # the rest of the zone's line belongs to the member, later lines until one that can't
    ends = F.filter(F.transform(after, lambda x, i: F.when((i > 0) & x.rlike(stop), i)), lambda i: i.isNotNull())
    member = F.array_join(F.slice(after, F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.size(after))), " ")
    member = F.when(found, member).otherwise(F.coalesce(F.get(F.split(payload, "\n"), F.lit(0)), F.lit("")))
    whole = F.array_join("lines", "\n")
    party = F.coalesce(*[F.when(whole.rlike(p), name) for name, p in parties.items()], F.lit(""))
    return blocks.select(
        "*", (F.floor((F.col("serial") - 1) / seats) + 1).cast("int").alias("seat_ward"), F.when(found, part(1)).otherwise("").alias("ward"), F.when(found, part(2)).otherwise("").alias("zone"),
        F.regexp_replace(F.trim(F.regexp_replace(member, r"\s+", " ")), "[ ,]+$", "").alias("member"), party.alias("party"), F.array_join(F.array_distinct(F.regexp_extract_all(whole, F.lit(f"({PHONE})"), F.lit(1))), "; ").alias("phones"),
    )


def roster_faults(rows: DataFrame, doc: str, expected_rows: int, expected_wards: int, seats: int) -> DataFrame:
    """(doc, fault, ward, n): documents with another number of rows or wards, and wards with another number of seats."""
    by_ward = rows.groupBy(doc, "seat_ward").agg(F.count(F.lit(1)).alias("n"))
    by_doc = by_ward.groupBy(doc).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("wards"))
    none = F.lit(None).cast("int")
    return (
        by_doc.where(F.col("rows") != expected_rows).select(doc, F.lit("rows").alias("fault"), none.alias("ward"), F.col("rows").alias("n"))
        .unionByName(by_doc.where(F.col("wards") != expected_wards).select(doc, F.lit("wards").alias("fault"), none.alias("ward"), F.col("wards").alias("n")))
        .unionByName(by_ward.where(F.col("n") != seats).select(doc, F.lit("seats").alias("fault"), F.col("seat_ward").alias("ward"), "n"))
    )


# --- annual reports -------------------------------------------------------------------------------------------------------------------------

def whole_number(text: Column) -> Column:
    """A number as printed, without separators or decimals; 0 without a digit, null of a null."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\.[0-9]+\b", ""), "[^0-9]", "")
    return geo.once(digits, lambda d: F.when(d == "", F.lit(0).cast("long")).otherwise(d.try_cast("long")))


def numbers_in(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit("([0-9][0-9,]*)"), F.lit(1)), whole_number)


def section(text: Column, headings: list[str], size: int) -> Column:
    """So many characters of a text from the first heading on that it has, whatever the case; null without one."""
    at = geo.once(F.lower(text), lambda lower: F.coalesce(*[geo.once(F.instr(lower, h), lambda i: F.when(i > 0, i)) for h in headings]))
    return F.substring(text, at, F.lit(size))


def adds_up(numbers: Column, of: int = 6, columns: tuple[int, int, int] = (0, 1, 2)) -> Column:
    """Of the runs of so many neighbours among numbers, the first in which two columns make a third; null without one. The run that begins the row is tried first."""
    a, b, total = columns

    def first(n: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(n) - of, F.lit(0)))
        runs = F.transform(starts, lambda i: F.slice(n, i + 1, F.lit(of)))
        return F.get(F.filter(runs, lambda r: (F.size(r) == of) & (F.get(r, F.lit(a)) + F.get(r, F.lit(b)) == F.get(r, F.lit(total)))), F.lit(0))

    return F.get(F.transform(F.array(numbers), first), F.lit(0))  # numbers is evaluated once


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def _kept(value: Column, holds) -> Column:
    """The value if the condition, a function of it, holds, else null; the value is evaluated once."""
    return F.get(F.filter(F.array(value), lambda v: F.coalesce(holds(v), F.lit(False))), F.lit(0))


def _after(text: Column, pattern: str) -> Column:
    """The number in the pattern's first group; null without a match."""
    return whole_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def report_year(name: Column, text: Column) -> Column:
    """'20YY-YY' of the file's name or the first 2,500 characters; null without one."""
    both = F.concat(F.coalesce(name, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 2500))
    pattern = r"(20[0-9]{2})\s*[-–_]\s*(20[0-9]{2}|[0-9]{2})"
    return F.when(both.rlike(pattern), F.concat(F.regexp_extract(both, pattern, 1), F.lit("-"), F.right(F.regexp_extract(both, pattern, 2), F.lit(2))))


def members_of_table(text: Column) -> Column:
    """The six figures (members: adult, child, all; issues: adult, child, all) of the membership table's last total line; null unless adult and child members make all.

    Where no line is 'Total' and six numbers, the first line that begins with 'total' has the run of six that adds up.
    """
    def read(chunk: Column) -> Column:
        plain = _last(F.regexp_extract_all(chunk, F.lit(r"(?im)^\s*Total\s+" + r"\s+".join(["[0-9,]+"] * 6)), F.lit(0)))
        strict = lambda line: _kept(F.transform(F.regexp_extract_all(line, F.lit("([0-9,]+)"), F.lit(1)), whole_number), lambda n: F.get(n, F.lit(0)) + F.get(n, F.lit(1)) == F.get(n, F.lit(2)))
        lines = F.filter(F.split(chunk, r"\n"), lambda x: F.trim(x).rlike(r"(?i)^\W*total\b"))
        loose = F.get(F.filter(F.transform(lines, lambda x: adds_up(numbers_in(x))), lambda x: x.isNotNull()), F.lit(0))
        return geo.once(plain, lambda line: F.when(line.isNotNull(), strict(line)).otherwise(loose))

    return geo.once(section(text, ["statement showing membership", "details of membership"], SECTION), read)


def members_of_summary(text: Column) -> Column:
    """The same six figures of the summary lines: members, and all issues; nulls for the issues of adults and children."""
    pattern = r"(?i)Total Membership[^\n:]*?\([^\n]*?Adult[-\s]*([0-9, ]+)[^\n]*?Children[-\s]*([0-9, ]+)\)[^:\n]*:\s*([0-9, ]+)"
    m = F.array(*[whole_number(F.regexp_extract(text, pattern, k)) for k in (1, 2, 3)])
    none = F.lit(None).cast("long")
    return F.when(text.rlike(pattern), F.concat(m, F.array(none, none, _after(text, r"(?i)No\. of Books issued[^\n]*?[:>]\s*([0-9, ]+)"))))


def stock(text: Column) -> Column:
    """The collection's size: from the sentence, the labelled number, or the last large number of the stock table's first total line that has one. A number that a footnote's 0 ran into is taken without it."""
    longest = lambda c: F.reduce(F.regexp_extract_all(c, F.lit("([0-9][0-9,]*)"), F.lit(1)), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    mended = lambda number: geo.once(number, lambda n: F.when(n.between(10_000_000, 29_999_999) & (n % 10 == 0), F.floor(n / 10)).otherwise(n))
    of = lambda c: mended(whole_number(longest(F.nullif(c, F.lit("")))))
    told = of(F.regexp_extract(text, r"(?is)book collection(?: \(Net Book Stock\))?.{0,220}?was\s+([0-9,]+)", 1))
    labelled = of(F.regexp_extract(text, r"(?i)Net Book Stock\s+\D*([0-9][0-9,\s]+)", 1))
    totals = F.filter(F.split(section(text, ["analysis of net book stock"], STOCK_SECTION), r"\n"), lambda x: F.contains(F.lower(x), F.lit("total")))
    large = F.transform(totals, lambda x: _last(F.filter(F.transform(numbers_in(x), mended), lambda n: n > 100_000)))
    return F.coalesce(told, labelled, F.get(F.filter(large, lambda n: n.isNotNull()), F.lit(0)))


FINANCE = ("opening", "grant", "other_income", "available", "returned", "spent", "closing")


def annual_figures(docs: DataFrame, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """docs with the figures of an annual report: year, adult_members to total_issues, attendance, collection, books_added, the seven of FINANCE, confidence and status; rows without a year or any main figure are left out.

    status: 'reconciled' where the table's members add up and its issues do too, 'issues unreconciled' where adult and child issues don't make all (they are null then), 'summary' where only the summary lines have
    members, 'no members'. confidence is 'high' for a table. finance_adds_up: opening, grant and other income make what was available.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    table, told = members_of_table(t), members_of_summary(t)
    balance = _last(F.regexp_extract_all(section(t, ["unspent balance"], FINANCE_SECTION), F.lit(r"(?i)TOTAL\s+" + r"\s+".join(["[0-9,./-]+"] * 7)), F.lit(0)))
    money = F.transform(F.regexp_extract_all(balance, F.lit("([0-9,./-]+)"), F.lit(1)), whole_number)
    room = _after(t, r"(?i)Attendance of readers in Reading Rooms\s*:?\s*-?\s*([0-9, ]+)")
    served = _after(t, r"(?i)During the year under report\s+([0-9,]+)\s+persons availed this facility")
    read = docs.select("*", report_year(F.col(name_col), t).alias("year"), table.alias("_table"), told.alias("_told"), money.alias("_money"), stock(t).alias("collection"), _after(t, r"(?i)Books added to Stock\s*:?\s*([0-9, ]+)").alias("books_added"), F.coalesce(F.when(room >= 10_000, room), served, room).alias("attendance"))
    six = F.coalesce("_table", "_told")
    f = lambda k: F.get(six, F.lit(k))
    off = F.coalesce((f(3) > 0) & (f(4) > 0) & (f(5) > 0) & (f(3) + f(4) != f(5)), F.lit(False))
    names = ("adult_members", "child_members", "total_members", "adult_issues", "child_issues", "total_issues")
    figures = [(F.when(~off, f(k)) if k in (3, 4) else f(k)).alias(n) for k, n in enumerate(names)]
    status = F.when(off, "issues unreconciled").when(F.col("_table").isNotNull(), "reconciled").when(F.col("_told").isNotNull(), "summary").otherwise("no members")
    m = lambda k: F.get("_money", F.lit(k))
    out = read.select(
        *docs.columns, "year", *figures, "attendance", "collection", "books_added", *[m(k).alias(n) for k, n in enumerate(FINANCE)], (m(0) + m(1) + m(2) == m(3)).alias("finance_adds_up"),
        F.when(F.col("_table").isNotNull(), "high").otherwise("medium").alias("confidence"), status.alias("status"),
    )
    return out.where(F.col("year").isNotNull() & (F.coalesce("total_members", "total_issues", "collection", "spent").isNotNull()))

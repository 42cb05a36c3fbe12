"""Cells that arrive as strings: blanks, numbers, dates, fiscal years, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank cell.
BLANKS = ("", "nan", "none")


def clean_value(c: Column) -> Column:
    """The trimmed cell, null if it is blank."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*BLANKS), t)


def number(c: Column) -> Column:
    """A number, or null where the cell is none."""
    return c.cast("string").try_cast("double")


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def digits_only(c: Column) -> Column:
    """The digits of noisy text as a whole number; signs and points go, no digit is 0."""
    return F.coalesce(F.nullif(F.regexp_replace(c.cast("string"), "[^0-9]", ""), F.lit("")).try_cast("bigint"), F.lit(0))


def first_filled(*cs: Column) -> Column:
    """The first cell that isn't blank."""
    return F.coalesce(*[clean_value(c) for c in cs])


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def fiscal_start(d: Column, first_month: int = 4) -> Column:
    """The year in which a date's fiscal year begins."""
    return F.year(d) - (F.month(d) < first_month).cast("int")


def fiscal_label(start: Column) -> Column:
    """'YYYY-YY' of a fiscal year's first year."""
    return F.when(start.isNotNull(), F.format_string("%d-%02d", start, F.pmod(start + 1, F.lit(100))))


def fiscal_valid(label: Column) -> Column:
    """Whether a text is 'YYYY-YY' with the second year after the first."""
    a, b = F.regexp_extract(label, r"^(\d{4})-(\d{2})$", 1).try_cast("int"), F.regexp_extract(label, r"^(\d{4})-(\d{2})$", 2).try_cast("int")
    return F.coalesce(F.pmod(a + 1, F.lit(100)) == b, F.lit(False))


def fiscal_in_text(text: Column) -> Column:
    """The fiscal year that a text names: 'YYYY-YY', 'YYYY-YYYY', or the one that ends on a 31 March."""
    long = F.regexp_extract(text, r"(20\d{2})\s*[-–]\s*(?:20)?(\d{2})(?!\d)", 1).try_cast("int")
    march = F.regexp_extract(text, r"31[-./]0?3[-./](20\d{2})", 1).try_cast("int") - 1
    return fiscal_label(F.coalesce(march, long))


def letters_key(c: Column) -> Column:
    """A name's letters in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def words_key(c: Column) -> Column:
    """A name's words in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def human_bytes(n: Column, largest: str = "PB") -> Column:
    """1023B, 2.0KB, 3.4MB, 1.0GB, and so on up to the largest unit, in which greater sizes stay; null stays null."""
    d = n.cast("double")
    out = F.when(d < 1024, F.concat(n.cast("bigint").cast("string"), F.lit("B")))
    units = ("KB", "MB", "GB", "TB", "PB")
    last = units.index(largest)
    for i, unit in enumerate(units[: last + 1], 1):
        size = F.format_string(f"%.1f{unit}", F.bround(d / 1024**i, 1))
        out = out.when((d < 1024 ** (i + 1)) if i <= last else d.isNotNull(), size)
    return out


def numeric_tokens(text: Column) -> Column:
    """The numbers of a text, zeros left out; Gujarati digits count, thousands may have commas."""
    latin = F.translate(text, "૦૧૨૩૪૫૬૭૮૯", "0123456789")
    found = F.transform(F.regexp_extract_all(latin, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda t: F.regexp_replace(t, ",", "").try_cast("double"))
    return F.filter(found, lambda x: x.isNotNull() & (x != 0))


def roman(c: Column) -> Column:
    """A roman numeral up to XX as a number, or null."""
    numerals = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in numerals]), F.upper(F.trim(c))), F.lit(0)).cast("int")


def coordinates_in_url(url: Column) -> Column:
    """Struct (lat, lon) of a map link: the pin (!3d, !4d), else the view (@lat,lon), else the query (q=lat,lon); null without any."""
    n = r"(-?\d+(?:\.\d+)?)"
    pairs = [(rf"!3d{n}!4d{n}", 1, 2), (rf"!2d{n}!3d{n}", 2, 1), (rf"@{n},{n}", 1, 2), (rf"[?&]q={n},{n}", 1, 2)]
    one = lambda k: F.coalesce(*[F.regexp_extract(url, p, (a, b)[k]).try_cast("double") for p, a, b in pairs])
    return F.when(one(0).isNotNull(), F.struct(one(0).alias("lat"), one(1).alias("lon")))


def resolved_path(page: Column, href: Column) -> Column:
    """The site path that a relative link on a page leads to: no fragment or query, folders end in index.html; null for links to other sites."""
    bare = F.regexp_replace(href, r"[?#].*$", "")
    folder = F.regexp_replace(page, r"[^/]*$", "")
    joined = F.when(bare == "", page).when(F.startswith(bare, F.lit("/")), F.substring(bare, F.lit(2), F.length(bare))).otherwise(F.concat(folder, bare))
    steps = F.filter(F.split(joined, "/"), lambda s, i: (s != ".") & (s != "") | (i == F.size(F.split(joined, "/")) - 1))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    path = F.array_join(walked, "/")
    path = F.when((path == "") | F.endswith(path, F.lit("/")), F.concat(path, F.lit("index.html"))).otherwise(path)
    return F.when(~href.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)"), path)

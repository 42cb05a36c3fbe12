"""Cells in the several forms that sources write them: fiscal years, names, classes by keyword, checks of feed fields, colours."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardlight.functions import geo

#: Words of station names that don't tell stations apart, and short forms with what they stand for.
STATION_WORDS = ("railway", "station", "halt", "junction", "jn", "road", "rd")
SHORT_FORMS = {"stn": "station", "rd": "road", "jn": "junction", "jcn": "junction"}
#: Degrees Celsius and their red, green and blue.
HEAT = ((30, 0, 80, 30), (33, 120, 180, 40), (36, 240, 230, 40), (39, 245, 150, 30), (42, 225, 50, 30), (45, 150, 15, 20), (48, 90, 0, 25))
HEAT_ALPHA = 220


#: Separators between two years: one of these characters, or blanks around it too.
TIGHT, LOOSE = "^[-_ ]$", r"^\s*[-_]\s*$"


def _numbers(text: Column) -> Column:
    """Each run of digits of a text with what stands around it: structs (before, a, sep, b, after, c), b being the next number, c the one after it. Every form of a year below is a test of these."""
    def each(runs: Column) -> Column:
        at = lambda i, name: F.coalesce(F.get(runs, i), F.lit("")).alias(name)
        digits = F.filter(F.transform(runs, lambda x, i: F.struct(x.alias("a"), i.alias("i"))), lambda n: n["a"].rlike("^[0-9]"))
        return F.transform(digits, lambda n: F.struct(at(n["i"] - 1, "before"), n["a"].alias("a"), at(n["i"] + 1, "sep"), at(n["i"] + 2, "b"), at(n["i"] + 3, "after"), at(n["i"] + 4, "c")))

    return geo.once(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), each)


def _first(text: Column, label: Callable[[Column], Column]) -> Column:
    """The label of the first number that has one; null without any."""
    return F.get(F.filter(F.transform(_numbers(text), label), lambda x: x.isNotNull()), F.lit(0))


def _years(a: Column, b: Column) -> Column:
    """'20YY-YY' of two texts that end in two digits each."""
    return F.concat(F.lit("20"), F.right(a, F.lit(2)), F.lit("-"), F.right(b, F.lit(2)))


def _follows(label: Column) -> Column:
    """The label if its second year follows the first, else null."""
    a, b = F.substring(label, 3, 2).try_cast("int"), F.right(label, F.lit(2)).try_cast("int")
    return F.when(b == F.pmod(a + 1, F.lit(100)), label)


def _in_century(n: Column) -> Column:
    return F.right(n, F.lit(4)).rlike("^20[0-9]{2}$")


def _long(sep: str) -> Callable[[Column], Column]:
    """A year of four digits and the first two of the next number."""
    return lambda n: F.when(_in_century(n["a"]) & n["sep"].rlike(sep) & (F.length(n["b"]) >= 2), _years(n["a"], F.left(n["b"], F.lit(2))))


def _short(sep: str, a: str = "^[0-9]{2}$", b: str = "^[0-9]{2}$") -> Callable[[Column], Column]:
    """Two numbers of two digits that no word runs into."""
    return lambda n: F.when(n["a"].rlike(a) & n["b"].rlike(b) & n["sep"].rlike(sep) & ~n["before"].rlike(r"\w$") & ~n["after"].rlike(r"^\w"), _years(n["a"], n["b"]))


def year_of_file_name(name: Column) -> Column:
    """The first '20YY-YY' of a file name ('-', '_' or a blank between), else its first lone 'YY-YY'."""
    return F.coalesce(_first(name, _long(TIGHT)), _first(name, _short("^[-_]$")))


def year_of_link(text: Column) -> Column:
    """Of a link's label or address: '20YY-YY', else the year that a 31 March ends, else two consecutive two-digit years from 05-06 on."""

    def closed(n: Column) -> Column:
        march = (n["a"] == "31") & (n["b"] == "03") & n["sep"].rlike(LOOSE) & n["after"].rlike(LOOSE) & n["c"].rlike("^(20)?[0-9]{2}$") & ~n["before"].rlike(r"\w$")
        end = F.right(n["c"], F.lit(2)).try_cast("int") + 2000
        return F.when(march, F.format_string("%d-%02d", end - 1, F.pmod(end, F.lit(100))))

    return F.coalesce(_first(text, _long(LOOSE)), _first(text, closed), _follows(_first(text, _short(LOOSE, "^(0[5-9]|[12][0-9])$", "^(0[6-9]|[123][0-9])$"))))


def year_of_estimate(name: Column) -> Column:
    """The year after 'BE' (not 'RBE'), else the first '20YY-YY'; '' without either."""
    estimate = lambda n: F.when(n["before"].rlike("(^|[^R])BE[_ ]?$") & n["a"].rlike("^(20)?[0-9]{2}$") & (n["sep"] == "-") & (F.length(n["b"]) >= 2), _years(n["a"], F.left(n["b"], F.lit(2))))
    return F.coalesce(_first(name, estimate), _first(name, _long("^-$")), F.lit(""))


def year_written_out(text: Column) -> Column:
    """'20YY-20YY', else '20YY-YY', else six digits that are two consecutive years."""
    whole = lambda n: F.when(_in_century(n["a"]) & n["sep"].rlike(LOOSE) & n["b"].rlike("^20[0-9]{2}"), _years(n["a"], F.left(n["b"], F.lit(4))))
    joined = lambda n: F.when(n["a"].rlike("^20[0-9]{4}$"), _years(F.left(n["a"], F.lit(4)), n["a"]))
    return F.coalesce(_first(text, whole), _first(text, _long(LOOSE)), _follows(_first(text, joined)))


def earliest_year(text: Column) -> Column:
    """The first pair in a text, of two or four digits, whose second year follows the first; null without one."""

    def consecutive(n: Column) -> Column:
        four = n["a"].rlike("^20[0-9]{2}$") & n["b"].rlike("^[0-9]{2,4}$")
        two = n["a"].rlike("^[12][0-9]$") & n["b"].rlike("^[123][0-9]$")
        start, end = (F.when(F.length(y) == 4, y).otherwise(F.concat(F.lit("20"), y)).try_cast("int") for y in (n["a"], n["b"]))
        return F.when((four | two) & n["sep"].rlike("^[-_/]$") & (end == start + 1), F.format_string("%d-%02d", start, F.pmod(end, F.lit(100))))

    return _first(text, consecutive)


@F.pandas_udf(StringType())
def ascii_text(text: pd.Series) -> pd.Series:
    """Letters without their accents and nothing outside ASCII (compatibility decomposition, which Spark has no function for); null stays null."""
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def key_without(name: Column, words: tuple[str, ...] = STATION_WORDS) -> Column:
    """A name's words in ASCII and lower case without filler words, one blank between them."""
    bare = F.regexp_replace(F.lower(ascii_text(name)), rf"\b(?:{'|'.join(words)})\b", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def key_expanded(name: Column, forms: dict[str, str] | None = None) -> Column:
    """A name's words in lower case with short forms written out and '&' as a word."""
    out = F.regexp_replace(F.lower(name), "&", " and ")
    for short, full in (forms or SHORT_FORMS).items():
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def numbered_name(name: Column) -> Column:
    """Struct (number, key) of '012 Name Ward': what stands before the first blank, if it is a number, without leading zeros ('' without one), and the letters of the name, without a last word 'ward' if it is numbered."""
    whole = F.trim(F.coalesce(name, F.lit("")))
    words = F.split(whole, r"\s+")
    numbered = F.get(words, F.lit(0)).rlike("^[0-9]+$") & (F.size(words) > 1)
    last = F.size(words) - F.when((F.size(words) > 2) & (F.lower(F.element_at(words, -1)) == "ward"), 1).otherwise(0)
    kept = F.when(numbered, F.slice(words, F.lit(2), last - 1)).otherwise(words)
    number = F.when(numbered, F.regexp_replace(F.get(words, F.lit(0)), "^0+(?=[0-9])", "")).otherwise("")
    return F.struct(number.alias("number"), F.regexp_replace(F.lower(F.array_join(kept, "")), "[^a-z]", "").alias("key"))


def first_class(text: Column, classes: dict[str, str], default: str) -> Column:
    """The first class, in the given order, whose pattern is found in the text in lower case; null text is an empty one."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(lower.rlike(pattern), name) for name, pattern in classes.items()], F.lit(default))


def is_day(c: Column) -> Column:
    """Eight digits that are a date."""
    return F.coalesce(c.rlike(r"^\d{8}$") & F.try_to_timestamp(c, F.lit("yyyyMMdd")).isNotNull(), F.lit(False))


def is_clock(c: Column) -> Column:
    """H:MM:SS or HH:MM:SS; hours may pass 23, as they do after midnight of a service day."""
    return F.coalesce(c.rlike(r"^\d{1,2}:[0-5]\d:[0-5]\d$"), F.lit(False))


def is_whole(c: Column, least: int, most: int | None = None) -> Column:
    """A whole number within bounds."""
    text = F.trim(c.cast("string"))
    n = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.coalesce((n >= least) & (F.lit(True) if most is None else n <= most), F.lit(False))


def is_number(c: Column, least: float, most: float) -> Column:
    """A number within bounds; NaN isn't one."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(~F.isnan(n) & n.between(least, most), F.lit(False))


def are_points(coordinates: Column) -> Column:
    """An array of [lon, lat] arrays that has an element, and all of them within the globe's bounds."""
    inside = lambda p: F.coalesce((F.size(p) == 2) & is_number(F.get(p, F.lit(0)), -180, 180) & is_number(F.get(p, F.lit(1)), -90, 90), F.lit(False))
    return F.coalesce((F.size(coordinates) > 0) & F.forall(coordinates, inside), F.lit(False))


def colour(value: Column, stops: tuple[tuple[float, int, int, int], ...] = HEAT, alpha: int = HEAT_ALPHA) -> Column:
    """Struct (red, green, blue, alpha) on straight lines between stops, held at both ends, cut to whole numbers; a null or non-finite value has the first stop's colour and alpha 0."""
    x = value.cast("double")
    valid = F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    x = F.when(valid, x).otherwise(float(stops[0][0]))

    def channel(k: int) -> Column:
        out = F.when(x <= stops[0][0], float(stops[0][k]))
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            out = out.when(x <= b[0], a[k] + (x - a[0]) * ((b[k] - a[k]) / (b[0] - a[0])))
        return F.floor(out.otherwise(float(stops[-1][k])) + 1e-9).cast("int")

    return F.struct(channel(1).alias("red"), channel(2).alias("green"), channel(3).alias("blue"), F.when(valid, alpha).otherwise(0).alias("alpha"))

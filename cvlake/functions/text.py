"""Text normalisation and small scalar helpers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cvlake.config import MONTHS

BLANKS = " \t\n\r\x0b\x0c"
BLANK_RUN = r"[ \t\n\x0B\f\r]+"
NO_BLANKS = r"[^ \t\n\x0B\f\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def quoted(value) -> str:
    """A Python string or number as a SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def literal_map(pairs: dict) -> Column:
    """A constant map, as one expression."""
    return F.expr("map(" + ", ".join(quoted(x) for kv in pairs.items() for x in kv) + ")")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def words(c: Column) -> Column:
    """Words between blanks, none of them empty."""
    return F.regexp_extract_all(c, F.lit(NO_BLANKS), F.lit(0))


def n_words(c: Column) -> Column:
    return F.size(words(c))


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, BLANK_RUN, " "))


def contains_any(c: Column, keys: tuple[str, ...]) -> Column:
    return let(c, lambda x: F.exists(F.expr("array(" + ", ".join(map(quoted, keys)) + ")"), lambda k: F.contains(x, k)))


def first_by(rows: Column, key: Callable[[Column], Column]) -> Column:
    """The first row of each key, in order: sorted by key once, so long arrays take no more than n log n steps."""
    tagged = F.sort_array(F.transform(rows, lambda r, i: F.struct(key(r).alias("key"), i.alias("i"))))
    heads = let(tagged, lambda t: F.filter(t, lambda x, i: (i == 0) | (x["key"] != F.get(t, i - 1)["key"])))
    places = F.sort_array(F.transform(heads, lambda x: x["i"]))
    return let(F.struct(rows.alias("rows"), places.alias("places")), lambda s: F.transform(s["places"], lambda i: F.get(s["rows"], i)))


def first_spellings(items: Column) -> Column:
    """Trimmed, non-empty items, the first of those that differ only in case."""
    differ = lambda kept: F.size(F.array_distinct(F.transform(kept, F.lower))) == F.size(kept)
    return let(F.filter(F.transform(items, strip), lambda x: x != ""), lambda kept: F.when(differ(kept), kept).otherwise(first_by(kept, F.lower)))


def clean_lines(c: Column) -> Column:
    """Unified line ends, single blanks, trimmed lines, at most one empty line in a row."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.array_join(F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def clip01(x: Column) -> Column:
    """N3."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if one is null or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def looks_like_heading(line: Column) -> Column:
    """N5."""
    return let(
        strip(line),
        lambda s: F.coalesce((F.length(s) >= 3) & (n_words(s) <= 6) & (s.endswith(":") | ((F.upper(s) == s) & s.rlike(r"\p{L}") & (F.length(s) <= 40))), F.lit(False)),
    )


def postcode(outward: Column, inward: Column) -> Column:
    """N6."""
    return F.concat_ws(" ", F.upper(outward), F.upper(inward))


def month_year(c: Column) -> Column:
    """struct<date, confidence> of "2019" or "March 2019"; a null date and 0 for anything else."""
    months = literal_map(MONTHS)

    def read(s: Column) -> Column:
        name, year = F.regexp_extract(s, r"^([a-z]{3,9})\s+((?:19|20)[0-9]{2})$", 1), F.regexp_extract(s, "((?:19|20)[0-9]{2})$", 1)
        month = F.coalesce(months[name], months[F.substring(name, 1, 3)])
        plain = s.rlike("^(19|20)[0-9]{2}$")
        date = F.when(plain, F.make_date(F.nullif(year, F.lit("")).cast("int"), F.lit(1), F.lit(1))).when(month.isNotNull(), F.make_date(F.nullif(year, F.lit("")).cast("int"), month, F.lit(1)))
        return F.struct(date.alias("date"), F.when(plain, 0.70).when(month.isNotNull(), 0.90).otherwise(0.0).alias("confidence"))

    return let(F.lower(strip(c)), read)


def yyyy_mm(d: Column) -> Column:
    """N8."""
    return F.date_format(d, "yyyy-MM")


def months_between(a: Column, b: Column) -> Column:
    """Whole months from a to b, by calendar month."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def title_like(c: Column) -> Column:
    """Single blanks; words of an all-capitals text capitalised."""
    return let(one_line(c), lambda s: F.when((F.upper(s) == s) & s.rlike(r"\p{Lu}"), F.initcap(F.lower(s))).otherwise(s))

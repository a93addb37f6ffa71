"""Sections of a text, and blocks of lines in a work history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cvlake.config import BULLET, DATE_RANGE, SECTION_ALIASES
from cvlake.functions.text import first_spellings, let, looks_like_heading, n_words, strip, strip_chars


def alias_section(heading: Column) -> Column:
    """The section that a heading names, by the first alias in order of declaration that fits; null if none does."""
    every = [(section, alias) for section, aliases in SECTION_ALIASES.items() for alias in aliases]
    exact = [F.when(heading == alias, F.lit(section)) for section, alias in every]
    near = [F.when((heading == alias) | F.contains(F.lit(alias), heading) | F.contains(heading, F.lit(alias)), F.lit(section)) for section, alias in every]
    return F.when(n_words(heading) <= 4, F.coalesce(*near)).otherwise(F.coalesce(*exact))


def heading_section(line: Column) -> Column:
    """The section that a line opens, or null."""
    text = F.replace(strip(strip_chars(F.lower(line), ": ")), F.lit("&"), F.lit("and"))
    return F.when(looks_like_heading(line), let(text, alias_section))


def section_lines(text: Column) -> Column:
    """G1: array<struct<section, line>> of the non-blank lines of a text that are no section headings."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: let(strip(x), lambda s: F.struct(i.alias("no"), s.alias("line"), heading_section(s).alias("opens"))))

    def carry(ls: Column) -> Column:
        opened = F.transform(F.filter(ls, lambda x: x["opens"].isNotNull()), lambda x: F.struct(x["no"].alias("no"), x["opens"].alias("section")))
        heads = F.concat(F.array(F.struct(F.lit(-1).alias("no"), F.lit("header").alias("section"))), opened)

        def below(hs: Column) -> Column:
            after = lambda k: F.coalesce(F.get(hs, k + 1)["no"], F.size(ls))
            own = lambda h, k: F.filter(F.slice(ls, h["no"] + 2, after(k) - h["no"] - 1), lambda x: x["line"] != "")
            return F.flatten(F.transform(hs, lambda h, k: F.transform(own(h, k), lambda x: F.struct(h["section"].alias("section"), x["line"].alias("line")))))

        return let(heads, below)

    return let(lines, carry)


def lines_of(sections: Column, name: str) -> Column:
    return F.transform(F.filter(sections, lambda s: s["section"] == name), lambda s: s["line"])


def text_lines(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def has_date_range(line: Column) -> Column:
    """A line without four digits in a row has no year, which spares it the long pattern."""
    return line.rlike("[0-9]{4}") & line.rlike(DATE_RANGE)


def role_blocks(lines: Column) -> Column:
    """array<array<string>>.

    A line with a date range opens a block if the current one has two lines or more; then a block of at most two lines
    joins the one before it.
    """
    n = F.size(lines)
    dated = F.filter(F.transform(lines, lambda x, i: F.when(has_date_range(x), i)), lambda i: i.isNotNull())
    starts = F.aggregate(dated, F.array(F.lit(0)), lambda acc, i: F.when(i - F.element_at(acc, -1) >= 2, F.concat(acc, F.array(i))).otherwise(acc))

    def cut(starts: Column) -> Column:
        end = lambda s, k: F.coalesce(F.get(s, k + 1), n)
        kept = F.filter(starts, lambda s, k: (k == 0) | (end(starts, k) - s > 2))
        return let(kept, lambda ks: F.transform(ks, lambda s, k: F.slice(lines, s + 1, end(ks, k) - s)))

    return F.when(n > 0, let(starts, cut)).otherwise(F.array().cast("array<array<string>>"))


def without_bullet(line: Column) -> Column:
    return strip(F.regexp_replace(line, BULLET, ""))


def clean_bullets(lines: Column) -> Column:
    """Lines without bullets, headings and anything under 8 characters."""
    bare = F.transform(F.filter(lines, lambda x: strip(x) != ""), lambda x: without_bullet(strip(x)))
    return first_spellings(F.filter(bare, lambda x: ~looks_like_heading(x) & (F.length(x) >= 8)))

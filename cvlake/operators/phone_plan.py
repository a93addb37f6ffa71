"""Telephone numbers of Great Britain by the public national numbering plan: kind, validity and E.164 form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cvlake.config import PHONE
from cvlake.functions.text import let
from cvlake.operators.contact import uk_phones

# Beginnings of national numbers (without the leading 0), what they are for, and how many digits a number has.
GB_PLAN = (
    ("1", "geographic", (9, 10)), ("10", "not in use", ()), ("11", "geographic", (10,)), ("121", "geographic", (10,)), ("131", "geographic", (10,)),
    ("141", "geographic", (10,)), ("151", "geographic", (10,)), ("161", "geographic", (10,)), ("171", "not in use", ()), ("181", "not in use", ()),
    ("191", "geographic", (10,)), ("20", "geographic", (10,)), ("23", "geographic", (10,)), ("24", "geographic", (10,)), ("28", "geographic", (10,)),
    ("29", "geographic", (10,)), ("30", "nationwide", (10,)), ("33", "nationwide", (10,)), ("34", "nationwide", (10,)), ("37", "nationwide", (10,)),
    ("55", "corporate", (10,)), ("56", "internet", (10,)), ("70", "personal", (10,)), ("71", "mobile", (10,)), ("72", "mobile", (10,)),
    ("73", "mobile", (10,)), ("74", "mobile", (10,)), ("75", "mobile", (10,)), ("76", "pager", (10,)), ("7624", "mobile", (10,)), ("77", "mobile", (10,)),
    ("78", "mobile", (10,)), ("79", "mobile", (10,)), ("800", "free", (9, 10)), ("8001111", "free", (7,)), ("808", "free", (10,)), ("843", "shared", (10,)),
    ("844", "shared", (10,)), ("845", "shared", (10,)), ("845464", "shared", (7,)), ("870", "shared", (10,)), ("871", "shared", (10,)),
    ("872", "shared", (10,)), ("873", "shared", (10,)), ("90", "premium", (10,)), ("91", "premium", (10,)), ("98", "premium", (10,)),
)


def national(number: Column) -> Column:
    """The digits of a number without country code and leading 0."""
    return F.regexp_replace(F.regexp_replace(number, "[^0-9+]", ""), r"^(?:\+44|0044)?0?", "")


def planned(number: Column) -> Column:
    """struct<kind, valid, e164> of a number, by the longest beginning of the plan that it has; nulls and false if it has none."""
    entry = lambda kind, lengths: F.struct(F.lit(kind).alias("kind"), F.array(*[F.lit(n) for n in lengths]).cast("array<int>").alias("lengths"))
    plan = F.create_map(*[x for p, kind, lengths in GB_PLAN for x in (F.lit(p), entry(kind, lengths))])
    sizes = sorted({len(p) for p, _, _ in GB_PLAN}, reverse=True)

    def of(n: Column) -> Column:
        found = F.coalesce(*[plan[F.left(n, F.lit(k))] for k in sizes])
        return let(found, lambda e: let(F.coalesce(F.array_contains(e["lengths"], F.length(n)), F.lit(False)), lambda ok: F.struct(e["kind"].alias("kind"), ok.alias("valid"), F.when(ok, F.concat(F.lit("+44"), n)).alias("e164"))))

    return let(national(number), of)


def gb_phones(text: Column) -> Column:
    """E2 with the plan: the first three different valid numbers in E.164 form; if there is none, what uk_phones() finds."""
    raw = F.regexp_extract_all(text, F.lit(PHONE), F.lit(1))
    valid = F.array_distinct(F.filter(F.transform(raw, lambda r: planned(r)["e164"]), lambda e: e.isNotNull()))
    return let(valid, lambda v: F.when(F.size(v) > 0, F.slice(v, 1, 3)).otherwise(uk_phones(text)))

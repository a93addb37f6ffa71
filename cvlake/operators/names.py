"""Names of people, from file names and from the first lines of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cvlake.config import EMAIL, FILE_NAME_STEPS, NAME, NOT_A_NAME, PHONE, PROFILE_LINKS
from cvlake.functions.text import clip01, contains_any, first_spellings, let, n_words, one_line, words
from cvlake.operators.segment import text_lines


def _name(value: Column, confidence: Column) -> Column:
    return F.struct(value.cast("string").alias("name"), confidence.cast("double").alias("confidence"))


def file_stem(filename: Column) -> Column:
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def name_from_filename(filename: Column) -> Column:
    """struct<name, confidence>."""
    s = file_stem(filename)
    for pattern, by in FILE_NAME_STEPS:
        s = F.regexp_replace(s, pattern, by)

    def build(tokens: Column) -> Column:
        cased = F.transform(tokens, lambda t: F.when((F.upper(t) == t) & t.rlike("[A-Z]"), t).otherwise(F.initcap(F.lower(t))))
        return let(F.array_join(cased, " "), lambda n: F.when((F.size(tokens) >= 2) & ~n.rlike(r"[^A-Za-z\s'’\-]"), _name(n, F.when(F.size(tokens) <= 4, 0.80).otherwise(0.65))).otherwise(_name(F.lit(None), F.lit(0.0))))

    return let(F.slice(words(F.coalesce(s, F.lit(""))), 1, 6), build)


def strip_noise(s: Column) -> Column:
    """Without email addresses, telephone numbers and profile links."""
    for pattern in ("(?i)" + EMAIL, PHONE, *PROFILE_LINKS):
        s = F.regexp_replace(s, pattern, " ")
    return one_line(s)


def plausible_name(s: Column) -> Column:
    """P6."""
    parts = words(F.replace(s, F.lit("."), F.lit("")))
    initials = F.size(F.filter(parts, lambda p: F.length(p) == 1))
    ok = (s != "") & ~contains_any(F.lower(s), NOT_A_NAME) & (F.length(s) <= 60) & ~s.rlike(r"[^A-Za-z\s'’\-.]")
    return F.coalesce(ok & F.size(parts).between(2, 5) & (initials < 2), F.lit(False))


def name_from_content(text: Column) -> Column:
    """struct<name, confidence>: the best candidate of the first 15 lines, the first of equals."""

    def candidates(line: Column, i: Column) -> Column:
        def both(bare: Column) -> Column:
            whole = F.when(bare.rlike(f"^{NAME}$"), F.struct(bare.alias("name"), clip01(F.lit(0.78) + F.greatest(F.lit(0.0), (10 - i) * F.lit(0.01))).alias("score")))
            given = F.regexp_extract(line, r"(?i)\bname\s*[:\-]\s*(" + NAME + r")\b", 1)
            named = F.when(given != "", F.struct(given.alias("name"), F.lit(0.88).alias("score")))
            out = F.filter(F.array(whole, named), lambda c: c.isNotNull())
            return F.when((bare == "") | contains_any(F.lower(bare), NOT_A_NAME), F.array().cast("array<struct<name:string,score:double>>")).otherwise(out)

        return let(strip_noise(line), both)

    found = F.flatten(F.transform(F.slice(text_lines(F.coalesce(text, F.lit(""))), 1, 15), candidates))
    best = F.array_min(F.transform(found, lambda c, k: F.struct((-c["score"]).alias("far"), (-n_words(c["name"])).alias("few"), k.alias("k"), c["name"].alias("name"))))
    return let(best, lambda b: F.when(b.isNull(), _name(F.lit(None), F.lit(0.0))).otherwise(_name(b["name"], -b["far"])))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of lower-cased words; 0 if one has none."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def merged_name(a: Column, b: Column) -> Column:
    """P5: the words of both, each once."""
    return F.array_join(first_spellings(F.concat(words(a), words(b))), " ")


def reconcile(content: Column, file: Column, similarity: Callable[[Column, Column], Column] = token_similarity) -> Column:
    """struct<full_name, name_source, name_confidence> from two struct<name, confidence>.

    similarity: of two names; fuzzy.token_set_ratio also finds names that are spelled a little differently.
    """
    out = lambda n, s, x: F.struct(n.cast("string").alias("full_name"), F.lit(s).alias("name_source"), clip01(x).alias("name_confidence"))

    def decide(x: Column) -> Column:
        c, f, cc, fc = x["c"]["name"], x["f"]["name"], x["c"]["confidence"], x["f"]["confidence"]
        has_c, has_f = F.coalesce(c != "", F.lit(False)), F.coalesce(f != "", F.lit(False))
        return let(
            similarity(c, f),
            lambda sim: F.when(has_c & ~has_f, out(c, "content", cc))
            .when(has_f & ~has_c, out(f, "filename", fc))
            .when(~has_c & ~has_f, out(F.lit(None), "none", F.lit(0.0)))
            .when(sim >= 0.90, out(c, "merged", F.greatest(cc, fc) + 0.05))
            .when(sim >= 0.75, out(merged_name(c, f), "merged", F.greatest(cc, fc) - 0.05))
            .when(cc >= fc, out(c, "content", cc - 0.10))
            .otherwise(out(f, "filename", fc - 0.10)),
        )

    return let(F.struct(content.alias("c"), file.alias("f")), decide)

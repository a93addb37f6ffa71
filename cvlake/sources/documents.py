"""Files as documents: raw bytes, text, page lines."""

from __future__ import annotations

import io
import zipfile
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvlake.config import CONFIG, Config
from cvlake.functions.text import BLANKS, clean_lines, let, strip

#: Fixed value: the XML namespace of word processing documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, content) of all files below a folder; each file is read by the task that needs it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^./]+)$", 1))


def docx_lines(content: bytes) -> str:
    """Trimmed paragraphs outside tables, then table rows as cells joined by " | "."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t")).strip()
    lines = [s for p in body.findall(f"{W}p") if (s := said(p))]
    for row in body.iter(f"{W}tr"):
        cells = [s for c in row.findall(f"{W}tc") if (s := said(c))]
        if cells:
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def docx_text(content: Column) -> Column:
    """struct<text, error> of .docx bytes; a broken file is that row's error, and no reason to stop."""

    @F.arrow_udf("struct<text:string,error:string>")
    def read(contents: pa.Array) -> pa.Array:
        texts, errors = [], []
        for c in contents.to_pylist():
            try:
                texts.append(None if c is None else docx_lines(c))
                errors.append(None)
            except Exception as e:
                texts.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"])

    return read(content)


def extract_text(files: DataFrame) -> DataFrame:
    """Files (path, name, content) with text and error. Reads .docx and plain .txt; PDF needs a library that is not here, so a .pdf gets an error."""
    kind = suffix(F.col("name"))
    rows = files.withColumn("_d", docx_text(F.when(kind == ".docx", F.col("content"))))
    text = F.when(kind == ".docx", F.col("_d.text")).when(kind == ".txt", F.col("content").cast("string"))
    error = F.when(kind == ".docx", F.col("_d.error")).when(kind == ".txt", F.lit(None).cast("string")).when(kind == ".pdf", "no PDF reader installed").otherwise(F.concat(F.lit("unsupported file type: "), kind))
    return rows.select("path", "name", clean_lines(text).alias("text"), error.alias("error"))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def choose_ocr(text: Column, ocr_text: Column, config: Config = CONFIG) -> Column:
    """The recognised text where the extracted one has few letters and the recognised one has more."""
    better = (letters(text) < config.ocr_letters) & (letters(F.coalesce(ocr_text, F.lit(""))) > letters(text))
    return F.when(better, ocr_text).otherwise(text)


def lines_from_words(words: Column) -> Column:
    """Lines of a page from array<struct<text, top, x0>>: a gap of over 2 below a line's first word opens a new line."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(F.round(w["top"], 1).alias("top"), w["x0"].alias("x0"), i.alias("i"), w["text"].alias("text"))))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        fresh = acc["top"].isNotNull() & (F.abs(w["top"] - acc["top"]) > 2.0)
        return F.struct(
            F.when(acc["top"].isNull() | fresh, w["top"]).otherwise(acc["top"]).alias("top"),
            F.when(fresh, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]).alias("done"),
            F.when(acc["line"].isNull() | fresh, w["text"]).otherwise(F.concat(acc["line"], F.lit(" "), w["text"])).alias("line"),
        )

    lines = F.aggregate(placed, start, add, lambda acc: F.when(acc["line"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def page_lines(words: Column) -> Column:
    """lines_from_words() of a column, for many pages at once; it can't be in a lambda. Pages with nulls are left to that."""

    def tenths(x: np.ndarray) -> np.ndarray:
        """Rounded as by F.round(x, 1): halves of the decimal digits go away from zero."""
        y = np.abs(x) * 10.0
        out = np.copysign(np.floor(y + 0.5) / 10.0, x)
        unsure = np.flatnonzero((np.abs(y - np.floor(y) - 0.5) < 1e-3) | (y > 1e12))
        values, place = np.unique(x[unsure], return_inverse=True)
        out[unsure] = np.array([float(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in values.tolist()], float)[place]
        return out

    @F.arrow_udf("array<string>")
    def lines_of(pages: pa.Array) -> pa.Array:
        """The lines of each page; null for a page that is null or holds a null or a number that isn't finite."""
        size = pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words, page = pages.flatten(), np.repeat(np.arange(len(pages)), size)
        text, (top, x0) = words.field("text"), (pc.cast(words.field(c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("top", "x0"))
        bad = ~(np.isfinite(top) & np.isfinite(x0)) | (words.is_null().to_numpy(zero_copy_only=False) | text.is_null().to_numpy(zero_copy_only=False))
        odd = pages.is_null().to_numpy(zero_copy_only=False)
        odd[page[bad]] = True
        kept = np.flatnonzero(~odd[page])
        size, top = np.where(odd, 0, size), tenths(top[kept])
        order = np.lexsort((x0[kept], top, page[kept]))  # stable, so in the given order if both are equal
        top, page = top[order], page[kept][order]
        starts = np.cumsum(size) - size
        opens = np.zeros(len(top), bool)
        active = np.flatnonzero(size)
        first = np.full(len(size), -np.inf)
        for k in range(int(size.max(initial=0))):  # word k of all pages that have so many
            active = active[size[active] > k]
            at = starts[active] + k
            fresh = top[at] - first[active] > 2.0
            opens[at] = fresh
            first[active[fresh]] = top[at[fresh]]
        heads = np.flatnonzero(opens)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(heads, len(top)), pa.int32()), text.take(pa.array(kept[order]))), " ")
        lines = pc.utf8_trim(lines.cast(pa.string()), characters=BLANKS)
        full = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.bincount(page[heads][full], minlength=len(size)))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), lines.filter(pa.array(full)), mask=pa.array(odd))

    return F.coalesce(lines_of(words), lines_from_words(words))


def page_texts(pages: DataFrame, key: str, order: str, words: Column, config: Config = CONFIG) -> DataFrame:
    """(key, text) of a row for each page: page_text() of each document, with the lines made page by page, before pages meet."""
    lines = pages.select(key, order, page_lines(words).alias("lines"))
    held = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "lines"))).alias("p"))
    return held.select(key, join_pages(drop_repeated_lines(F.transform("p", lambda x: x["lines"]), config)).alias("text"))


def drop_repeated_lines(pages: Column, config: Config = CONFIG) -> Column:
    """array<array<string>> without short lines that most pages have; one page alone is left as it is."""
    each = F.sort_array(F.flatten(F.transform(pages, lambda p: F.array_distinct(F.filter(p, lambda x: F.length(x) <= 80)))))
    most = F.greatest(F.lit(2), F.ceil(F.size(pages) * config.header_footer_share).cast("int"))
    # in sorted order, a line that is there so often equals the one so many places on
    common = let(each, lambda e: F.array_distinct(F.filter(e, lambda x, i: F.coalesce(F.get(e, i + most - 1) == x, F.lit(False)))))
    return F.when(F.size(pages) < 2, pages).otherwise(let(common, lambda c: F.transform(pages, lambda p: F.filter(p, lambda x: ~F.array_contains(c, x)))))


def page_text(pages: Column, config: Config = CONFIG) -> Column:
    """The text of array<array<struct<text, top, x0>>>: lines of each page, without headers and footers, joined."""
    return join_pages(let(F.transform(pages, lines_from_words), lambda p: drop_repeated_lines(p, config)))


def join_pages(pages: Column) -> Column:
    """Pages of lines as one text, a blank line between pages."""
    return strip(F.array_join(F.transform(pages, lambda p: F.array_join(p, "\n")), "\n\n"))

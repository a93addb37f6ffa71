"""Listings of a document store: items, pages, folder trees and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvlake.config import CONFIG, Config
from cvlake.functions.text import let, strip
from cvlake.operators.names import file_stem
from cvlake.sources.store import scratch, written

#: M1, and a page of them.
ITEM = "struct<id:string,type:string,name:string,attributes:struct<name:string,is_folder:boolean,type:string,mime_type:string,file_type:string>>"
PAGE = f"struct<data:array<{ITEM}>,included:array<{ITEM}>,links:struct<next:string>>"
ID = "[A-Za-z0-9]{8,}"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_resume_filename(name: Column, config: Config = CONFIG, exact: str = "") -> Column:
    """S1."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r".(\.[^.]+)$", 1))
    ok = suffix.isin(*config.extensions) & file_stem(name).rlike("(?i)^(resume|cv)([-_ ]|$)")
    if exact.strip():
        ok = ok & (F.lower(strip(name)) == exact.strip().lower())
    return F.coalesce(ok, F.lit(False))


def resource_id(link: Column, strict: bool = False) -> Column:
    """The id that a link or a bare id holds; null, or an error if strict, where there is none."""
    s = strip(_text(link))
    path = F.regexp_extract(s, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(s, r"^[^?#]*\?([^#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda p: p.rlike(f"^{ID}$"))
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+$"))
    value = lambda k: let(F.regexp_extract(F.get(F.filter(pairs, lambda p: p.startswith(f"{k}=")), F.lit(0)), "=(.*)$", 1), lambda v: F.when(v.rlike(f"^{ID}$"), v))
    loose = F.nullif(F.regexp_extract(s, rf"(?i)(?:folder|folders|file|files|id|res_id)=({ID})", 1), F.lit(""))
    found = F.coalesce(F.when(s.rlike(f"^{ID}$"), s), F.try_element_at(segments, F.lit(-1)), *[value(k) for k in ("id", "res_id", "folder_id", "resource_id")], loose)
    if not strict:
        return found
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no folder id in link: "), s)))


def item_name(item: Column) -> Column:
    """S3."""
    own = item["attributes"]["name"]
    return strip(F.when(_text(own) != "", own).otherwise(_text(item["name"])))


def item_id(item: Column) -> Column:
    """S3."""
    return strip(_text(item["id"]))


def is_folder(item: Column, config: Config = CONFIG) -> Column:
    """S4."""
    a = item["attributes"]
    return (F.lower(_text(item["type"])) == "folders") | F.coalesce(a["is_folder"], F.lit(False)) | (F.lower(_text(a["type"])) == "folder") | F.lower(_text(a["mime_type"])).isin("folder", *config.folder_types) | (F.lower(_text(a["file_type"])) == "folder")


def is_file(item: Column) -> Column:
    """S5."""
    return ~is_folder(item) & ((F.lower(_text(item["type"])) == "files") | F.coalesce(~item["attributes"]["is_folder"], F.lit(False)) | (item_name(item) != ""))


def page_items(pages: DataFrame, body: str = "body", limit: int = 50) -> DataFrame:
    """Rows of a table of listing pages (JSON text) with items and has_more; a page that is no JSON has no items."""
    page = F.from_json(body, T._parse_datatype_string(PAGE))
    none = F.array().cast(f"array<{ITEM}>")
    items = F.concat(F.coalesce(F.col("_p.data"), none), F.coalesce(F.col("_p.included"), none))
    more = (F.coalesce(F.col("_p.links.next"), F.lit("")) != "") | (F.size(F.coalesce(F.col("_p.data"), none)) >= limit)
    return pages.withColumn("_p", page).withColumns({"items": F.filter(items, lambda x: x.isNotNull()), "has_more": more}).drop("_p")


def list_resumes(edges: DataFrame, root: str, include_subfolders: bool = True, config: Config = CONFIG, exact: str = "") -> DataFrame:
    """(id, name, virtual_path) of the résumé files below a folder.

    edges: (parent_id, id, name, is_folder). The tree is walked level by level, as deep as it goes; a folder that several
    paths reach, or that lies in a cycle, is entered once, where it is reached first (fewest levels, then path). Each
    level is one join and is written to the shared folder, and only the question whether it is empty comes to the driver.
    """
    roots = edges.sparkSession.createDataFrame([(root, root, "")], "root string, folder string, prefix string")
    found = resumes_below(edges, roots, include_subfolders, config, exact)
    return found.select("id", "name", "virtual_path").orderBy(F.lower("virtual_path"), "id")


def resumes_below(edges: DataFrame, roots: DataFrame, include_subfolders: bool = True, config: Config = CONFIG, exact: str = "") -> DataFrame:
    """list_resumes() of many trees in one walk: (root, id, name, virtual_path) for roots (root, folder, prefix)."""
    spark = edges.sparkSession
    named = edges.where("id <> '' AND name <> ''")
    seen = level = roots
    while include_subfolders:
        below = named.where("is_folder").join(level, F.col("parent_id") == F.col("folder")).select("root", F.col("id").alias("folder"), F.concat("prefix", "name", F.lit("/")).alias("prefix"))
        level = written(below.groupBy("root", "folder").agg(F.min("prefix").alias("prefix")).join(seen.select("root", "folder"), ["root", "folder"], "left_anti"), scratch(spark, "folders"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    files = named.where("NOT is_folder").where(is_resume_filename(F.col("name"), config, exact))
    return files.join(seen, files.parent_id == seen.folder).select("root", "id", "name", strip(F.concat("prefix", "name")).alias("virtual_path"))


def within_limit(listing: DataFrame, most: int = CONFIG.listing_items) -> DataFrame:
    """The listing's safety stop: an error if there are more rows than allowed."""
    size = listing.agg(F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > most, F.raise_error(F.lit("too many items listed"))).otherwise(F.lit(True))
    return listing.join(F.broadcast(size)).where(checked).drop("_n")


def web_url(base: str, file_id: Column) -> Column:
    """S9."""
    return F.concat(F.lit(base.rstrip("/") + "/file/"), file_id)

"""A paged listing as a Spark data source: format "paged_listing".

Pages are JSON texts in shared storage, a file each, in folders `folder=<id>/offset=<first item>` (as
`pages.write.partitionBy("folder", "offset").text(path)` leaves them). A folder is read as its store would give it: from offset 0
on, a page after the other, as long as a page says that there is more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cvlake.sources.listing import is_file, is_folder, item_id, item_name, page_items

FORMAT = "paged_listing"
#: Tasks that folders are dealt out to before a task reads several.
MOST_TASKS = 256


@dataclass
class Folders(InputPartition):
    """Folders that one task reads."""

    names: tuple[str, ...]


class PagedListing(DataSource):
    """Options: path; limit, items of a full page (50); folders_per_task (64 at most)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "folder string, offset bigint, body string, has_more boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit, self.some = options["path"], int(options.get("limit", 50)), int(options.get("folders_per_task", 64))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Folders]:
        """Only the names of folders are listed here."""
        from pyarrow import fs

        store, base = self._store()
        names = sorted(f.base_name.removeprefix("folder=") for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("folder="))
        some = min(self.some, -(-len(names) // MOST_TASKS) or 1)  # a folder's pages follow each other, so few folders are a task each
        return [Folders(tuple(names[i : i + some])) for i in range(0, len(names), some)]

    def read(self, part: Folders) -> Iterator[tuple]:
        """(folder, offset, body, has_more, error) of each page; a page that fails twice is an error of its own, and ends its folder."""
        store, base = self._store()
        for folder in part.names:
            offset, more = 0, True
            while more:
                body, error = None, None
                for _ in range(2):
                    try:
                        body, error = self.page(store, base, folder, offset), None
                        data, more = self.parsed(body)
                        break
                    except Exception as e:
                        data, more, error = [], False, f"{type(e).__name__}: {e}"
                yield folder, offset, body, more, error
                offset += max(len(data), 1)

    def page(self, store, base: str, folder: str, offset: int) -> str:
        from pyarrow import fs

        at = f"{base.rstrip('/')}/folder={folder}/offset={offset}"
        (file,) = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name[:1] not in "._"]
        with store.open_input_stream(file) as s:
            return s.read().decode("utf-8")

    def parsed(self, body: str) -> tuple[list, bool]:
        """The page's own items, and whether more follow: by its link, or as it is full."""
        page = json.loads(body)
        data = page.get("data") or []
        return data, bool((page.get("links") or {}).get("next")) or len(data) >= self.limit


def listed_edges(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """(parent_id, id, name, is_folder, error) of all pages at path, for list_resumes(); a row without an id for each page with an error."""
    spark.dataSource.register(PagedListing)
    pages = spark.read.format(FORMAT).option("path", path).option("limit", limit).load()
    items = page_items(pages.withColumnRenamed("has_more", "said_more"), limit=limit).select("folder", "error", F.explode_outer("items").alias("item"))
    known = items.where((F.col("item").isNotNull() & (is_folder(F.col("item")) | is_file(F.col("item")))) | F.col("error").isNotNull())
    return known.select(F.col("folder").alias("parent_id"), item_id(F.col("item")).alias("id"), item_name(F.col("item")).alias("name"), F.coalesce(is_folder(F.col("item")), F.lit(False)).alias("is_folder"), "error")

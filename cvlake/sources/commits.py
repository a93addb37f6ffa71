"""Numbered states of a table in shared storage, each put there only if no other has its number."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Commits:
    """States 1, 2, ... of what lies at a path: small JSON files in its folder log, of which the last one counts.

    A state is written whole under a name of its own and then gets its number by a step that fails if the number is taken:
    renaming, which by Hadoop's contract doesn't replace a file, or in a local folder a hard link. Of several
    writers that go on from the same state one succeeds, and the others are told. Needs a store whose renaming keeps that
    contract (HDFS, local disks; a bare object store doesn't).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path, f"{path}/log"
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def last(self) -> tuple[int, dict]:
        """Number and content of the last state; (0, {}) before the first. Only names are listed, and one file is read."""
        try:
            names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileNotFoundException":
                raise
            return 0, {}
        turn = max((int(n.removesuffix(".json")) for n in names if n[:1].isdigit()), default=0)
        return (turn, json.loads(self.spark.read.text(f"{self.folder}/{turn:020d}.json", wholetext=True).first()[0])) if turn else (0, {})

    def put(self, turn: int, state: dict) -> bool:
        """Whether state became number turn; False if another one has it."""
        draft, place = self._path(f"_draft-{uuid.uuid4().hex}"), self._path(f"{turn:020d}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() != "file":
                return not self._fs.exists(place) and self._fs.rename(draft, place)
            local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(local(place), local(draft))
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)

    def drop(self, name: str) -> None:
        """Delete a folder beside the states that no state names."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

"""A log of JSON commits in a folder.

Commit n is the file n.json, written under another name and then given its own,
which fails if it is there already: so of two writers one wins, and a reader sees a
commit whole or not at all. The highest number is the state; nothing is ever
rewritten. On a local disk the name is a hard link; elsewhere it is a rename that
doesn't replace, which must be one step, as on HDFS. Object stores without such a
rename are only for a single writer.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Corrupted(Exception):
    """A commit that can't be read, or a file that a commit names and that is missing."""


class Conflict(Exception):
    """Another writer has made the commit."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.last() is not None

    def numbers(self) -> list[int]:
        folder = self._path(self.path)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        file = self._path(f"{self.path}/{number:010d}.json")
        stream = self._fs.open(file)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as e:
            raise Corrupted(f"commit {number} of {self.path} isn't JSON") from e

    def last(self) -> tuple[int, dict] | None:
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else None

    def commit(self, number: int, content: dict) -> None:
        """Make commit `number`; raises Conflict if it has been made."""
        self._fs.mkdirs(self._path(self.path))
        draft, final = self._path(f"{self.path}/.{uuid.uuid4().hex}"), self._path(f"{self.path}/{number:010d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        try:
            self._name(draft, final)
        except FileExistsError as e:
            raise Conflict(f"commit {number} of {self.path} has been made by another writer") from e
        finally:
            self._fs.delete(draft, False)

    def _name(self, draft, final) -> None:
        if self._fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), final.toUri().getPath())
        elif self._fs.exists(final) or not self._fs.rename(draft, final):
            raise FileExistsError(final.toString())

    def drop_before(self, number: int) -> None:
        """Forget older commits, once nothing reads them any more."""
        for n in self.numbers():
            if n < number:
                self._fs.delete(self._path(f"{self.path}/{n:010d}.json"), False)

    def folders(self, path: str, prefix: str) -> dict[str, float]:
        """The folders in `path` whose names begin with `prefix`, and when they were changed, in seconds."""
        found = self._fs.listStatus(self._path(path)) if self.has(path) else []
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found if s.isDirectory() and s.getPath().getName().startswith(prefix)}

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def has(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

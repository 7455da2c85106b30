"""Numbered commits in a shared folder, each of which can be made once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has made this commit already."""


class CommitLog:
    """Small JSON values under the numbers 0, 1, 2, ... in a folder.

    A value is written under a name of its own and then renamed to its number, which fails if the number is taken: of
    two writers that go on from the same commit, one gets an error and nothing of its value is ever seen. That is
    as safe as the file system's rename without overwriting (atomic on HDFS and the like).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._folder = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri() if "://" in self.path else self._fs.getUri(), self._conf)

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def newest(self) -> int:
        """Number of the last commit, -1 if there is none."""
        if not self._fs.exists(self._folder):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._file(f"{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, value: dict) -> None:
        """Makes commit ``number``, which must follow the newest; CommitConflict if another writer was first."""
        if number != self.newest() + 1:
            raise CommitConflict(f"commit {number} can't follow {self.newest()} in {self.path}")
        written = self._file(f".{uuid.uuid4().hex}.tmp")
        out = self._fs.create(written, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        self._publish(written, number)

    def _publish(self, written, number: int) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._context.rename(written, self._file(f"{number:012d}.json"), options)
        except Py4JJavaError as fault:
            self._fs.delete(written, False)
            if "FileAlreadyExistsException" in str(fault.java_exception.toString()):
                raise CommitConflict(f"commit {number} was made by another writer in {self.path}") from None
            raise

    def delete_folder(self, folder: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def folders(self, parent: str) -> list[str]:
        """Names of the folders below a folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(parent)
        return [s.getPath().getName() for s in self._fs.listStatus(path) if s.isDirectory()] if self._fs.exists(path) else []

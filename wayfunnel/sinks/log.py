"""A log of numbered entries, each created once: of two writers of one number the second is told so."""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """Small JSON files ``<number>.json`` in a folder of any file system that Spark can write to.

    An entry is written under another name and renamed without overwriting, so readers see whole entries only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._fs.Path(folder)
        self._files = root.getFileSystem(self._conf)
        self._root = self._files.makeQualified(root)

    def _path(self, name: str) -> Any:
        return self._fs.Path(self._root, name)

    def numbers(self) -> list[int]:
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def read(self, number: int) -> dict[str, Any]:
        stream = self._files.open(self._path(f"{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict[str, Any] | None]:
        """The last number and its entry; (0, None) for an empty log."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def commit(self, number: int, entry: dict[str, Any]) -> bool:
        """Create an entry; false if that number is there already."""
        self._files.mkdirs(self._root)
        draft, final = self._path(f".draft-{uuid.uuid4().hex}"), self._path(f"{number:012d}.json")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(self._root.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def forget(self, number: int) -> None:
        self._files.delete(self._path(f"{number:012d}.json"), False)

    def delete(self, folder: str) -> None:
        self._files.delete(self._fs.Path(folder), True)

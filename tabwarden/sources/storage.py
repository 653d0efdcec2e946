"""Small files that drivers agree through: whole or not there at all, and never replaced."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Storage:
    """A folder in any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._jvm = spark._jvm
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.path(*names))

    def listed(self, *names: str) -> list[str]:
        """Names in a folder, in order; none if there is no such folder."""
        if not self.exists(*names):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(*names)))

    def modified(self, *names: str) -> int:
        """Milliseconds by the clock of the file system."""
        return self.fs.getFileStatus(self.path(*names)).getModificationTime()

    def write(self, text: str, *names: str) -> None:
        out = self.fs.create(self.path(*names), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, *names: str) -> Any:
        stream = self.fs.open(self.path(*names))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def delete(self, *names: str) -> None:
        self.fs.delete(self.path(*names), True)

    def put_if_absent(self, value: Any, folder: str, name: str) -> bool:
        """Write a JSON file whole under a name, unless that name is taken; False then.

        A file is written beside it and given the name in one step that fails if the name
        exists: a link on a local disk, else a rename without overwriting.
        """
        draft = f".{uuid.uuid4().hex}"
        self.write(json.dumps(value), folder, draft)
        at, to = self.path(folder, draft), self.path(folder, name)
        try:
            if self.fs.getScheme() == "file":
                def local(p):
                    return self._jvm.java.io.File(p.toUri().getPath()).toPath()

                self._jvm.java.nio.file.Files.createLink(local(to), local(at))
            else:
                options = self._jvm.org.apache.hadoop.fs.Options.Rename
                none = self.spark.sparkContext._gateway.new_array(options, 1)
                none[0] = options.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                    to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(at, to, none)
            return True
        except Exception:
            if not self.exists(folder, name):
                raise
            return False
        finally:
            self.fs.delete(at, False)

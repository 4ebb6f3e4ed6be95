"""Files of a store on whatever file system Spark has for their path."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

HOLD = "hold-"
HOLD_SECONDS = 3600


class Folder:
    """A directory reached through Hadoop's file system classes, so it may be local, HDFS or an object store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def full(self, name: str) -> str:
        return f"{self.path}/{name}"

    def make(self) -> None:
        self._fs.mkdirs(self._at())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at())) if self._fs.exists(self._at()) else []

    def modified(self, name: str) -> int:
        """Unix seconds."""
        return self._fs.getFileStatus(self._at(name)).getModificationTime() // 1000

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @contextmanager
    def held(self, seconds: int = HOLD_SECONDS) -> Iterator[None]:
        """While this is open, and for at most some seconds, ``gc`` deletes nothing here: for readers that take long."""
        name = f"{HOLD}{uuid.uuid4().hex}"
        self.replace(name, str(int(time.time()) + seconds))
        try:
            yield
        finally:
            self.delete(name)

    def holds(self, now: int) -> int:
        """How many holds are open; those that outlived their time are deleted."""
        left = 0
        for name in self.names():
            if name.startswith(HOLD) and self.exists(name):
                if int(self.read(name)) > now:
                    left += 1
                else:
                    self.delete(name)
        return left

    def replace(self, name: str, text: str) -> None:
        """Write a file whole or not at all: a new file is renamed over the old one."""
        fresh = f".{name}.new"
        stream = self._fs.create(self._at(fresh), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hflush()
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._at(fresh), self._at(name), options)

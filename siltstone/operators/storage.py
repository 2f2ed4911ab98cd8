"""Shared folders for written tables, and publishing them by one atomic rename."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (`spark.checkpoint.dir`). Where that is unset, a temporary folder serves a session on one machine; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """Files of one folder, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self.files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.files.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """Names in the folder, sorted; none where it does not exist."""
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.at(name))) if self.exists(name) else []

    def make(self, name: str = "") -> None:
        self.files.mkdirs(self.at(name))

    def delete(self, name: str = "") -> None:
        self.files.delete(self.at(name), True)

    def rename(self, name: str, to: str) -> bool:
        """One atomic step of the file system. False where `to` is there already (as a file) or `name` is not."""
        return not self.exists(to) and bool(self.files.rename(self.at(name), self.at(to)))

    def write(self, name: str, text: str) -> None:
        """A new file with `text`; an error where it is there already."""
        out = self.files.create(self.at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        source = self.files.open(self.at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

"""Sinks: result files as JSON, and tables that are published together or not at all."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from siltstone.operators.storage import Folder

PENDING = "_pending"


def _open(path: str):
    """File system and plain path of a URI (file, hdfs, s3 and what else pyarrow knows)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: paths under the pending folder."""

    files: list[str]


class ResultWriter(DataSourceWriter):
    """Rows (day, file_name, body) as lines of one file a task and day in a pending folder, which the driver makes visible by one rename."""

    def __init__(self, path: str):
        self.path, self.batch = path.rstrip("/"), uuid.uuid4().hex

    @property
    def pending(self) -> str:
        return f"{self.path}/{PENDING}-{self.batch}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _open(self.pending)
        context = TaskContext.get()
        name = f"results-{context.partitionId()}-{context.taskAttemptId()}.json"
        out: dict[str, object] = {}
        try:
            for r in iterator:
                day = str(r["day"])
                if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
                    raise ValueError(f"not a day: {day!r}")
                if day not in out:
                    files.create_dir(f"{root}/day={day}", recursive=True)
                    out[day] = files.open_output_stream(f"{root}/day={day}/{name}")
                out[day].write((json.dumps({"file_name": r["file_name"], "body": r["body"]}, ensure_ascii=False) + "\n").encode())
        finally:
            for f in out.values():
                f.close()
        return Written([f"day={day}/{name}" for day in out])

    def commit(self, messages: list[Written | None]) -> None:
        """Files of attempts that did not count go, then one rename publishes the rest."""
        from pyarrow import fs

        files, root = _open(self.pending)
        keep = {f for m in messages if m for f in m.files}
        if not keep:
            return self.abort(messages)
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and info.path[len(root) + 1 :] not in keep:
                files.delete_file(info.path)
        files.move(root, f"{root.rpartition('/')[0]}/batch={self.batch}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _open(self.pending)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)


class ResultFiles(DataSource):
    """Format `siltstone_results`: see `sink_json`."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_results"

    def schema(self) -> str:
        return "day string, file_name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        if overwrite:
            raise ValueError("result files are only added")
        return ResultWriter(self.options["path"])


def sink_json(results: DataFrame, path: str) -> None:
    """Add results (day, file_name, body: JSON text) to the folder `path`. All of a write become visible together; a failed write leaves nothing. Rows of a day lie together under batch and day."""
    results.sparkSession.dataSource.register(ResultFiles)
    results.select(F.col("day").cast("string").alias("day"), "file_name", "body").write.format("siltstone_results").mode("append").option("path", path).save()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(day, file_name, body, stored_in) of all published results; nothing where none was."""
    kind = "file_name string, body string, batch string, day string"
    if not any(n.startswith("batch=") for n in Folder(spark, path).names()):
        return spark.createDataFrame([], "day string, file_name string, body string, stored_in string")
    return spark.read.schema(kind).json(path).select("day", "file_name", "body", F.col("_metadata.file_name").alias("stored_in"))


def list_result_files(spark: SparkSession, path: str, day: str | None = None, limit: int = 100) -> DataFrame:
    """(day, place, file_name, body): the newest results of each day (or of one: only its folder is read), last file name first."""
    rows = read_results(spark, path)
    if day is not None:
        rows = rows.filter(F.col("day") == day)
    w = W.partitionBy("day").orderBy(F.desc("file_name"))
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit).select("day", "place", "file_name", "body")


class PublishError(RuntimeError):
    """Somebody else published first, or a table could not be written; what was readable still is."""


@dataclass
class Publication:
    """Tables in `root` that are replaced together. A version is written aside as a whole; the rename of its manifest publishes it.

    Manifests are numbered: the greatest names the version that readers see. A writer that starts from manifest n publishes n + 1, and fails if that is there by then.
    """

    spark: SparkSession
    root: str

    def _manifests(self) -> list[int]:
        return sorted(int(m[1]) for n in Folder(self.spark, self.root).names() if (m := re.fullmatch(r"manifest-(\d+)", n)))

    def version(self) -> int:
        """Number of the current manifest; 0 before the first."""
        return max(self._manifests(), default=0)

    def read(self, table: str) -> DataFrame | None:
        """The published table; None before the first publication."""
        n = self.version()
        if not n:
            return None
        folder = Folder(self.spark, self.root).read(f"manifest-{n}")
        return self.spark.read.parquet(f"{self.root}/{folder}/{table}")

    def publish(self, tables: dict[str, DataFrame], start: int | None = None, between: Callable[[str], None] = lambda table: None) -> int:
        """Write all tables and make them visible at once; `start`: the version that they were made from. `between` is called before each table. Returns the new number."""
        files = Folder(self.spark, self.root)
        n = (self.version() if start is None else start) + 1
        folder = f"version-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                between(name)
                df.write.parquet(f"{self.root}/{folder}/{name}")
            files.write(f"{folder}/_manifest", folder)
            if not files.rename(f"{folder}/_manifest", f"manifest-{n}"):
                raise PublishError(f"version {n} is there already")
        except Exception:
            files.delete(folder)
            raise
        return n

    def clean(self, keep: int = 2) -> None:
        """Delete all but the last versions, and what failed writers left."""
        files, numbers = Folder(self.spark, self.root), self._manifests()
        live = {files.read(f"manifest-{n}") for n in numbers[-keep:]}
        for n in numbers[:-keep]:
            files.delete(f"manifest-{n}")
        for name in files.names():
            if name.startswith("version-") and name not in live:
                files.delete(name)


def sink_dual_write(store: Publication, results: DataFrame, payloads: DataFrame, between: Callable[[str], None] = lambda table: None) -> int:
    """Add results and their payloads to a publication of tables `records` and `payloads`: both or neither.

    results: (result_id, document_id, model, created_at, ...); payloads: (result_id, ...). Of a document and model the latest result of this write takes the
    place of what is there (ties: the greater result_id; null documents or models are keys like others). No payload stays without its record."""
    w = W.partitionBy("document_id", "model").orderBy(F.desc("created_at"), F.desc("result_id"))
    new = results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    start = store.version()
    if start:
        # null keys meet each other too
        named = lambda df: df.withColumn("_k", F.to_json(F.struct("document_id", "model")))
        old = named(store.read("records")).join(named(new).select("_k"), "_k", "left_anti").drop("_k")
        new = old.unionByName(new)
        payloads = store.read("payloads").unionByName(payloads)
    kept = payloads.join(new.select("result_id"), "result_id", "left_semi")
    return store.publish({"payloads": kept, "records": new}, start, between)

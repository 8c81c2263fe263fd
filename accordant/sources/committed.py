"""Reports of several lists that change as a whole: a data source whose commit puts the manifest last.

Each run writes its lists below a folder of its own; the manifest names the files of the run that holds.  A run that fails leaves
manifest and files as they were, and one that succeeds takes the files of earlier runs away, lists that are empty now included.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from accordant.sources.stores import store_of

MANIFEST = "manifest.json"


@dataclass
class _Written(WriterCommitMessage):
    """What one task wrote: (list, file, rows), in the order of its partition."""

    partition: int
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, always: list[str]):
        self.path, self.always = path, always
        self.run = f"run-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, inner, _ = store_of(self.path)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store.create_dir(f"{inner}/{self.run}", recursive=True)
        written, bucket, stream = [], None, None
        try:
            for b in batches:
                for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if stream is None or name != bucket:
                        if stream is not None:
                            stream.close()
                        bucket, file = name, f"{self.run}/{part:06d}-{attempt}-{len(written)}.txt"
                        stream = store.open_output_stream(f"{inner}/{file}")
                        written.append([name, file, 0])
                    stream.write(f"{value}\n".encode())
                    written[-1][2] += 1
        finally:
            if stream is not None:
                stream.close()
        return _Written(part, written)

    def commit(self, messages: list[_Written | None]) -> None:
        store, inner, _ = store_of(self.path)
        store.create_dir(inner, recursive=True)
        lists: dict[str, dict] = {name: {"rows": 0, "files": []} for name in self.always}
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, file, rows in message.files:
                own = lists.setdefault(name, {"rows": 0, "files": []})
                own["rows"] += rows
                own["files"].append(file)
        with store.open_output_stream(f"{inner}/{self.run}.json") as out:
            out.write(json.dumps({"run": self.run, "lists": lists}, indent=2).encode())
        store.move(f"{inner}/{self.run}.json", f"{inner}/{MANIFEST}")
        for old in store.get_file_info(fs.FileSelector(inner)):
            if old.type == fs.FileType.Directory and old.base_name.startswith("run-") and old.base_name != self.run:
                store.delete_dir(old.path)

    def abort(self, messages: list[_Written | None]) -> None:
        store, inner, _ = store_of(self.path)
        if store.get_file_info(f"{inner}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/{self.run}")


class Report(DataSource):
    """`report`: rows (list, value) under the option path; the option always: lists that are there also when empty."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return "list string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], json.loads(self.options.get("always", "[]")))


def write_report(rows: DataFrame, path: str, always: list[str] = (), order: str = "value") -> None:
    """rows: (list, value, ...).  Every list as text files, sorted by `order`; a long list is cut into files in that order.

    always: lists that are in the manifest even without rows; other lists are there only with rows.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Report)
    by = [F.col("list"), F.col(order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col("list").cast("string"), F.col("value").cast("string"))
    dealt.write.format("report").mode("append").option("path", path).option("always", json.dumps(list(always))).save()


def read_report(spark: SparkSession, path: str) -> tuple[dict[str, int], DataFrame]:
    """(rows of each list, (list, pos, value)): what the manifest says, and the lists it names."""
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])
    named = [(name, k, file) for name, own in manifest["lists"].items() for k, file in enumerate(own["files"])]
    sizes = {name: own["rows"] for name, own in manifest["lists"].items()}
    if not named:
        return sizes, spark.createDataFrame([], "list string, pos long, value string")
    # A line's number in its file, and the file's in its list, make its place.
    text = spark.read.option("wholetext", True).text([f"{path}/{file}" for _, _, file in named]).select(F.col("_metadata.file_name").alias("_f"), "value")
    known = spark.createDataFrame([(name, k, file.rsplit("/", 1)[1]) for name, k, file in named], "list string, _k int, _f string")
    lines = text.join(F.broadcast(known), "_f").select("list", "_k", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("_at", "value"))
    return sizes, lines.select("list", (F.col("_k").cast("long") * F.lit(1 << 40) + F.col("_at")).alias("pos"), "value")


def jury_files(requests: DataFrame, verdicts: DataFrame, path: str, key: str = "cid") -> None:
    """A jury's files: the list `manifest` of its requests and the list `raw` of its verdicts, a JSON object a row, by key; verdicts
    without a label stay, with their error."""
    row = lambda df, name: df.select(F.lit(name).alias("list"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"), F.col(key).cast("string").alias("_key"))
    write_report(row(requests, "manifest").unionByName(row(verdicts, "raw")), path, ["manifest", "raw"], "_key")

"""Intermediate tables in the folder that all executors share, given up run by run."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a session on this machine alone (tests) gets a new local folder; a cluster has no such way out.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="accordant-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """What operators share and write on behalf of one run."""

    def __init__(self):
        self.written: list[str] = []
        self.shared: list[Any] = []


_run: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Gives up at its end what operators called inside have shared and written, and nothing else.

    For callers that write their own result inside: results of these operators that are not written by then can't be
    computed any more.  Results made outside of it keep what they need.
    """
    own = Scratch()
    before = _run.set(own)
    try:
        yield own
    finally:
        _run.reset(before)
        for held in own.shared:
            held.destroy()
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in own.written:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/accordant-{uuid.uuid4().hex}"
    if run := _run.get():
        run.written.append(folder)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def share(spark: SparkSession, value: Any):
    """A broadcast; inside `scratch`, until its end."""
    held = spark.sparkContext.broadcast(value)
    if run := _run.get():
        run.shared.append(held)
    return held

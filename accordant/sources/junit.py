"""JUnit reports as a data source: files are partitions, each streamed through the XML parser with constant memory."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import BinaryIO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from accordant.sources.stores import files, reachable, store_of

SCHEMA = "file_path string, pos int, classname string, name string, file string, decisive string, message string"
#: Children that decide a test case's bucket (fixed values).
DECISIVE = {"failure", "error", "skipped"}
#: Bytes read, and test cases emitted, at a time.
CHUNK, ROWS = 1 << 16, 10_000


def cases(stream: BinaryIO, name: str = "") -> Iterator[tuple]:
    """(classname, name, file, decisive, message) of the test cases of a report, in the order in which they end.

    decisive: the first direct child that is a failure, an error or skipped; text, comments and what stands deeper don't count.
    """
    parser = expat.ParserCreate(namespace_separator="}")
    depth, open_cases, done = 0, [], []

    def start(tag: str, given: dict) -> None:
        nonlocal depth
        depth += 1
        if open_cases and tag in DECISIVE:
            at, held, decided = open_cases[-1]
            if depth == at + 1 and not decided:
                decided += [tag, given.get("message")]
        if tag == "testcase":
            open_cases.append((depth, [given.get(k) for k in ("classname", "name", "file")], []))

    def end(tag: str) -> None:
        nonlocal depth
        depth -= 1
        if tag == "testcase":
            _, held, decided = open_cases.pop()
            done.append((*held, *(decided or (None, None))))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        while chunk := stream.read(CHUNK):
            parser.Parse(chunk, False)
            yield from done
            done.clear()
        parser.Parse(b"", True)
    except expat.ExpatError as error:
        raise ValueError(f"{name}: {error}") from error
    yield from done


def _batches(path: str, stream: BinaryIO) -> Iterator[pa.RecordBatch]:
    held, pos = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held))
        places = pa.array(range(pos - len(held), pos), pa.int32())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), places, *[pa.array(c, pa.string()) for c in columns]], names)

    for case in cases(stream, path):
        held.append(case)
        pos += 1
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        return [_File(f.path) for f in files(self.path, ".xml")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        store, _, front = store_of(self.path)
        with store.open_input_stream(partition.path) as stream:
            yield from _batches(front + partition.path, stream)


class JUnit(DataSource):
    """`junit`: the option path names a report or a folder of *.xml reports."""

    @classmethod
    def name(cls) -> str:
        return "junit"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            yield from _batches(path, io.BytesIO(content.as_buffer()))


def junit_cases(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, pos, classname, name, file, decisive, message) of JUnit reports' test cases, in the order in which they end.

    A broken report fails the job with its name.  Where only Spark opens the store, a report is read as one value.
    """
    if reachable(path):
        spark.dataSource.register(JUnit)
        return spark.read.format("junit").load(path)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    return whole.select(F.col("path"), "content").mapInArrow(_parsed, SCHEMA)

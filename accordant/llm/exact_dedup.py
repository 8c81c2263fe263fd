"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only.

Each of RUNS runs holds one row for each digest it has seen: the best copy so far and the number of copies.  In
each binomial round FAN_IN neighbouring runs exchange their rows by digest and merge into one, until a single run
is left.  A run is spread over partitions by digest, so no round gathers it in one task, and rows are combined
before each exchange, so a copy group sends one row a task whatever its size.  Each level compares a second hash and
the length beside the digest, so a digest alone never joins two texts, and keeps the best identifier of those equal.

Texts are equal when identical after deleting white space [\\x20\\x09-\\x0D].  Of equal texts the row with the
most code points stays, then the smallest id (a null id comes last), then one of the identical rows.  A null
text counts as empty; empty texts are equal to each other.  Columns other than the id and the text are not
read, and `deduplicate` hands them on whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_marked, materialise, meet, row_key

RUNS = 32
FAN_IN = 2
_KEY = ["digest", "second", "size"]


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, hashes of the row, digest, second, size, chars, run), written once so that rows keep their numbers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(*row_key(id_col, text_col), text.alias("text"), F.translate(text, " \t\n\x0b\f\r", "").alias("plain"))
    return materialise(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "_id",
            "_h",
            "_g",
            F.unhex(F.sha2("plain", 256)).alias("digest"),
            F.xxhash64("plain").alias("second"),
            F.octet_length("plain").alias("size"),
            F.char_length("text").alias("chars"),
            F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"),
        ),
        "digests",
    )


def merged(rows: DataFrame) -> DataFrame:
    """One row for each digest: its best copy (row, id) and the number of copies."""
    best = F.struct((-F.col("chars")).alias("less"), F.col("_id").isNull().alias("none"), F.col("_id"), F.col("row"))
    runs = rows.groupBy("run", *_KEY).agg(F.min(best).alias("best"), F.count("*").alias("copies"))
    width = RUNS
    while width > 1:
        width = -(-width // FAN_IN)
        runs = (
            runs.withColumn("run", F.expr(f"run div {FAN_IN}"))
            .groupBy("run", *_KEY)
            .agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
        )
    return materialise(runs.select(*_KEY, F.col("best.row").alias("keep_row"), F.col("best._id").alias("keep_id"), "copies"), "merged")


def _marked(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `digests` with keep_id, keep_row and copies."""
    rows = digests(documents, id_col, text_col)
    return meet(rows, merged(rows), _KEY)


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (binary SHA-256 of the normalised text)."""
    return _marked(documents, id_col, text_col).select(
        F.col("_id").alias(id_col), "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    found = _marked(documents, id_col, text_col).select("_id", "_h", "_g", (F.col("row") == F.col("keep_row")).alias("kept"))
    return keep_marked(documents, materialise(found, "marked"), id_col, text_col)

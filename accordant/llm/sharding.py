"""Sharding by a two-pass external shuffle, in DataFrame functions only.

1. Scatter: a seeded hash of a row's identity gives it a draw, and the draw a bucket, uniformly.  A bucket holds about
   `bucket_bytes` of text, so one fits in a task's memory; one exchange deals the rows to their buckets.
2. Each bucket is put in the order of its draws, shuffled (Fisher-Yates, seeded) and written to the shared folder with
   the places of its rows.  Buckets, one behind the other, are one random order of all rows.
3. That order is cut into shards.  A row's number is its place plus the rows of the buckets before its own; these
   offsets, of at most MOST_BUCKETS buckets, are broadcast, so texts move once and are never sorted or gathered whole.

Law: `rows`, counts of shards differ by one at most.  Copies, hot sources and long documents are dealt like any other
row: what counts is a row's identity, not its content.  By default that is monotonically_increasing_id(), so the rows
must come from files or a written table (a repeated task sees the same rows in the same order); `row_id` names columns
that say it better, such as file name and row index, and then the draws depend on neither splits nor cluster.  Rows equal
in row_id share a bucket.

Null ids and texts, empty texts and repeated rows are rows like all others; no column's type matters.  Columns named
shard or slot are replaced, all others are handed on.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise

#: Bytes of text that a bucket holds, about.
BUCKET_BYTES = 16 << 20
#: Most buckets: their offsets are broadcast (12 bytes each).  Beyond, that is from 16 TB on, buckets get larger instead.
MOST_BUCKETS = 1 << 20
#: What a row costs beside its text.
ROW_BYTES = 16


def weight(text_col: str = "text") -> Column:
    """Bytes of a row: those of its text in UTF-8 (null: none) and ROW_BYTES."""
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES).cast("long")


def buckets(documents: DataFrame, text_col: str, bucket_bytes: int) -> tuple[int, int]:
    """(rows, buckets): at least one bucket for each of the session's shuffle partitions."""
    rows, size = documents.agg(F.count("*"), F.sum(weight(text_col))).first()
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows, min(max(-(-(size or 0) // bucket_bytes), parts), MOST_BUCKETS)


def scattered(documents: DataFrame, n: int, seed: int, row_id: list[str] | None) -> DataFrame:
    """(_bucket, _place, _row): rows dealt to n buckets by their draws, each bucket shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in (row_id or [])])
    own = [F.col(f"`{c}`") for c in row_id] if row_id else [F.monotonically_increasing_id()]
    drawn = documents.select(row.alias("_row"), F.xxhash64(F.lit(seed), *own).alias("_draw"))
    dealt = drawn.withColumn("_bucket", F.pmod("_draw", F.lit(n)).cast("int")).repartition(n, "_bucket").sortWithinPartitions("_bucket", "_draw")
    held = dealt.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    return held.select("_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_place", "_row"))


def shuffled(documents: DataFrame, shards: int = 40, seed: int = 20240917, row_id: list[str] | None = None, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents in a random order, with `shard` (from 0) and `slot` (from 0, without gaps, in the shard's order).

    Columns of row_id are used for the draws alone and not handed on.
    """
    rows, n = buckets(documents, text_col, bucket_bytes)
    written = materialise(scattered(documents, n, seed, row_id), "buckets")
    counts = written.groupBy("_bucket").agg((F.max("_place") + 1).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_BUCKETS rows
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = written.join(F.broadcast(offsets), "_bucket").withColumn("_number", F.col("_before") + F.col("_place"))
    small, larger = rows // shards, rows % shards  # the first `larger` shards have a row more
    edge = larger * (small + 1)
    shard = F.when(F.col("_number") < edge, F.expr(f"_number div {small + 1}")).otherwise(F.expr(f"{larger} + (_number - {edge}) div {max(1, small)}"))
    start = F.col("_shard") * small + F.least("_shard", F.lit(larger))
    keep = [F.col(f"_row.`{c}`") for c in documents.columns if c not in ("shard", "slot", *(row_id or []))]
    return number.withColumn("_shard", shard).select(*keep, F.col("_shard").cast("int").alias("shard"), (F.col("_number") - start).alias("slot"))


def write(placed: DataFrame, folder: str) -> None:
    """One folder `shard=N` a shard; its files, each in the order of slots, hold a run of slots each."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)

"""Consecutive numbers in an order, without a single task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.scratch import materialise

_ROW = (1 << 33) - 1  # the bits of monotonically_increasing_id() that count inside a partition


def numbered(rows: DataFrame, order: list[str], name: str = "at", partitions: int | None = None) -> DataFrame:
    """The rows with their numbers from 0 in the order given (nulls first); equal rows in any order.

    Rows are dealt to ranges of the order, and among equal keys to ranges of an arbitrary number, so a frequent key is not
    one task; each range is sorted and written with its rows' places.  A row's number is its place plus the rows
    of the ranges before it: one sum a partition, which the driver adds up.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c != name]
    salted = rows.select(*kept, *[F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order)], F.monotonically_increasing_id().alias("_salt"))
    by = [*[F.col(f"_o{k}") for k in range(len(order))], F.col("_salt")]
    ranges = salted.repartitionByRange(partitions, *by) if partitions else salted.repartitionByRange(*by)
    ranges = ranges.sortWithinPartitions(*by).select(*kept, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("_place"))
    placed = materialise(ranges, "ranges")
    sizes = dict(placed.groupBy("_part").count().collect())
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate([0, *[sizes[p] for p in parts]])))
    offset = F.create_map(*[F.lit(x).cast(kind) for p in parts for x, kind in ((p, "int"), (before[p], "long"))])[F.col("_part")] if parts else F.lit(0).cast("long")
    return placed.select(*kept, (offset + F.col("_place")).alias(name))

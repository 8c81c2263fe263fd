"""Set algebra on bitmaps: items are numbered once, each group's items are bits of a few short rows.

A bitmap row holds 32,768 numbers of one group; unions, sizes, items of one group only and all regions come from these
rows, a bucket at a time, without any group's items in one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.operators.joins import distinct_keys, lookup
from accordant.operators.numbering import numbered
from accordant.scratch import materialise

#: Most groups whose regions are counted: a region is named by a bit a group.
MOST_GROUPS = 20


def group_bitmaps(members: DataFrame, group: str, items: list[str]) -> DataFrame:
    """(group, bucket, bits) of members (group, items, ...); rows with a null group or no item at all are left out."""
    rows = members.select(F.col(group).alias("group"), *items).filter(F.col("group").isNotNull() & F.coalesce(*[F.col(c).isNotNull() for c in items]))
    known = numbered(distinct_keys(rows, items), items, "_number")
    placed = lookup(rows, known, items)
    bucket, bit = F.bitmap_bucket_number("_number").alias("bucket"), F.bitmap_bit_position("_number")
    return materialise(placed.groupBy("group", bucket).agg(F.bitmap_construct_agg(bit).alias("bits")), "bitmaps")


def sizes(bitmaps: DataFrame) -> DataFrame:
    """(group, n): the items of each group."""
    return bitmaps.groupBy("group").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def union_size(bitmaps: DataFrame) -> DataFrame:
    """(n): the items of all groups together."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def _regions(groups: list[str]):
    def run(held: pa.Array) -> pa.Array:
        out = []
        for own in held.to_pylist():
            codes = np.zeros(1 << 15, np.int64)
            for x in own:
                bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8), bitorder="little")
                codes[: len(bits)] |= bits.astype(np.int64) << groups.index(x["group"])
            code, n = np.unique(codes[codes > 0], return_counts=True)
            out.append([{"mask": "".join("1" if c >> k & 1 else "0" for k in range(len(groups))), "n": int(m)} for c, m in zip(code.tolist(), n.tolist())])
        return pa.array(out, pa.list_(pa.struct([("mask", pa.string()), ("n", pa.int64())])))

    run.__annotations__ = {"held": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<mask: string, n: long>>")


def region_counts(bitmaps: DataFrame, groups: list[str]) -> DataFrame:
    """(mask, n): how many items belong to exactly the groups marked 1, in the order of `groups`; other groups don't count."""
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"{len(groups)} groups make too many regions")
    names = bitmaps.filter(F.col("group").cast("string").isin(groups)).select(F.col("group").cast("string").alias("group"), "bucket", "bits")
    held = names.groupBy("bucket").agg(F.collect_list(F.struct("group", "bits")).alias("held"))  # MOST_GROUPS bitmaps of 4 KB
    return held.select(F.explode(_regions(groups)("held")).alias("x")).groupBy("x.mask").agg(F.sum("x.n").alias("n"))

"""Set algebra on bitmaps against Python sets."""

import random

import pytest

from accordant.operators import bitmaps


def test_regions_sizes_and_union(spark):
    draw = random.Random(2)
    sets = {g: {draw.randrange(70_000) for _ in range(n)} for g, n in (("a", 30_000), ("b", 20_000), ("c", 7), ("other", 50))}
    rows = [(g, k) for g, own in sets.items() for k in own] + [("a", next(iter(sets["a"])))] * 900 + [(None, 1), ("a", None)]
    held = bitmaps.group_bitmaps(spark.createDataFrame(rows, "g string, k int"), "g", ["k"])
    assert held.groupBy("group", "bucket").count().filter("count > 1").count() == 0
    assert {r["group"]: r["n"] for r in bitmaps.sizes(held).collect()} == {g: len(own) for g, own in sets.items()}
    assert bitmaps.union_size(held).first()["n"] == len(set().union(*sets.values()))
    names = ["c", "a", "b"]
    want = {}
    for k in set().union(*(sets[g] for g in names)):
        mask = "".join("1" if k in sets[g] else "0" for g in names)
        want[mask] = want.get(mask, 0) + 1
    assert {r["mask"]: r["n"] for r in bitmaps.region_counts(held, names).collect()} == want


def test_no_members_and_too_many_groups(spark):
    held = bitmaps.group_bitmaps(spark.createDataFrame([], "g string, k int"), "g", ["k"])
    assert bitmaps.sizes(held).count() == 0 and bitmaps.union_size(held).first()["n"] == 0 and bitmaps.region_counts(held, ["a"]).count() == 0
    with pytest.raises(ValueError):
        bitmaps.region_counts(held, [str(k) for k in range(21)])

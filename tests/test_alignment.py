"""Edit scripts of ordered lists against a plain table of lengths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import alignment


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_longest_common_of_few_and_many_copies():
    rng = random.Random(3)
    for _ in range(300):
        kinds = rng.choice([1, 2, 3, 30])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randint(0, 60))] for _ in "ab")
        pairs = alignment.longest_common(np.array(a, np.int64), np.array(b, np.int64))
        assert len(pairs) == length(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_many_copies_stay_small():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2, 6000), rng.integers(0, 2, 6000)  # 18 million equal pairs
    assert len(alignment.longest_common(a, b)) == alignment._lengths(a, b)[-1] > 4000


def lists():
    rng = random.Random(11)
    out = {}
    for g in range(40):
        a = [f"t{k}" for k in range(rng.randint(0, 50))] if g % 2 else [rng.choice(["x", "y", None, "z"]) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b[at : at + rng.randint(1, 3)] = []
            else:
                b[at:at] = [f"new{rng.randrange(9)}", rng.choice(a or ["q"])]
        if g % 7 == 0:
            rng.shuffle(b)
        out[None if g == 39 else g] = (a, b)
    out[40], out[41], out[42] = ([], ["only"]), (["gone", "too"], []), (["same", None], ["same", None])
    return out


def frames(spark, given):
    rows = lambda side: [(g, k, x, "extra") for g, ab in given.items() for k, x in enumerate(ab[side])]
    return [spark.createDataFrame(rows(s), "run long, pos int, _item string, _s string").repartition(5) for s in (0, 1)]


@pytest.mark.parametrize("most", [alignment.MOST, 4])
def test_script_makes_one_list_of_the_other(spark, most):
    given = lists()
    script = alignment.edit_script(*frames(spark, given), ["run"], ["pos"], "_item", most)
    found = {}
    for r in script.collect():
        found.setdefault(r["run"], []).append(r)
    assert None in found and 42 not in found
    assert [tuple(r)[1:] for r in found[40] + found[41]] == [("insert", 0, 0, 0, 1), ("delete", 0, 2, 0, 0)]
    for g, (a, b) in given.items():
        made, kept = list(a), len(a)
        for r in sorted(found.get(g, []), key=lambda r: -r["a_from"]):
            made[r["a_from"] : r["a_to"]] = b[r["b_from"] : r["b_to"]]
            kept -= r["a_to"] - r["a_from"]
            assert r["kind"] == ("insert" if r["a_to"] == r["a_from"] else "delete" if r["b_to"] == r["b_from"] else "change")
        assert made == b
        assert kept == length(a, b) if most == alignment.MOST else kept <= length(a, b)


def test_counts_and_empty_runs(spark):
    given = lists()
    a, b = frames(spark, given)
    counts = {r["run"]: tuple(r)[1:] for r in alignment.changed(a, b, ["run"], ["pos"], "_item").collect()}
    assert counts == {g: (n, len(x) - n, len(y) - n) for g, (x, y) in given.items() if x or y for n in [length(x, y)]}
    assert alignment.edit_script(a.limit(0), b.limit(0), ["run"], ["pos"], "_item").count() == 0


def test_long_lists_are_cut_into_small_blocks(spark):
    """Two lists of 20,000, one with some tests gone, some new and neighbours changed over: no block is larger than three rows."""
    a = spark.range(20_000).selectExpr("0 AS run", "id AS pos", "id AS node")
    b = a.filter("node % 1000 <> 7").selectExpr("run", "CASE WHEN node % 500 = 3 THEN pos + 1.5 ELSE pos END AS pos", "node")
    b = b.union(spark.range(10).selectExpr("0", "id * 1999 + 0.25", "-id - 1"))
    rows, _ = alignment._numbered_in_groups(a, b, ["run"], ["pos"], "node")
    shared = rows.filter("_side = 0").join(rows.filter("_side = 1").select("_item", F.col("_p").alias("_low"), F.col("_p").alias("_high")), "_item")
    assert alignment._blocks(shared.select("_p", "_low", "_high")).groupBy("_block").count().agg(F.max("count")).first()[0] == 2
    assert tuple(alignment.changed(a, b, ["run"], ["pos"], "node").first()) == (0, 20_000 - 20 - 40, 20 + 40, 10 + 40)

"""Expected disagreement against all pairs, on sparse, dense and mixed sets."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accordant.operators import agreement
from accordant.plans import queries


def masi(x, y):
    both = len(x & y)
    return both / len(x | y) * (1 if x == y else 2 / 3 if x <= y or y <= x else 1 / 3 if both else 0)


@pytest.mark.parametrize("light", [0, 2, 5, 32])
def test_closeness_is_that_of_all_pairs(spark, monkeypatch, light):
    monkeypatch.setattr(agreement, "SETS_PER_BLOCK", 20)
    draw = random.Random(light)
    rows, want = [], {}
    for g, names in (("sparse", range(400)), ("dense", range(6)), ("mixed", [0, 1, 2, *range(3, 300)])):
        weights = [40 if n < 3 and g == "mixed" else 1 for n in names]
        sets = {frozenset(draw.choices(names, weights, k=draw.randrange(1, 7))) for _ in range(90)}
        times = {s: draw.randrange(1, 4) for s in sets}
        rows += [(g, sorted(f"i{n}" for n in s), float(times[s])) for s in sets]
        want[g] = sum(times[x] * times[y] * masi(x, y) for x in sets for y in sets)
    got = agreement.closeness(spark.createDataFrame(rows, "granularity string, items array<string>, times double"), light)
    assert {r["granularity"]: round(r["close"], 6) for r in got.collect()} == {g: round(v, 6) for g, v in want.items()}


def test_sparse_sets_make_few_pairs(spark):
    """Sets that share few items: rows and blocks stay in proportion to the elements."""
    sets = spark.range(20_000).selectExpr("'g' AS granularity", "transform(sequence(0, 4), k -> concat('i', (id * 5 + k * 7) div 3)) AS items", "1.0D AS times")
    sets = sets.withColumn("items", F.array_distinct("items")).dropDuplicates(["items"])
    close = agreement.closeness(sets).first()["close"]
    assert close >= sets.count()


def test_empty_sets_of_sets(spark):
    none = spark.createDataFrame([], "granularity string, items array<string>, times double")
    assert agreement.closeness(none).count() == 0


@pytest.mark.parametrize("names, most", [(120, 46), (3000, 700), (5, 2)])
@pytest.mark.parametrize("inside", [True, False])
def test_packed_counts_are_those_of_all_pairs(names, most, inside):
    """Sets whose counts share a number of a product, by several columns, with many sizes and with few."""
    draw = random.Random(most)
    sets = [sorted(draw.sample(range(names), draw.randrange(1, min(most, names) + 1))) for _ in range(61)]
    side = [0 if inside else k % 2 for k in range(61)]
    times = [float(draw.randrange(1, 4)) for _ in sets]
    block = pa.table({"granularity": ["g"] * 61, "times": times, "items": pa.array(sets, pa.list_(pa.int64())), "size": pa.array(map(len, sets), pa.int32()), "side": pa.array(side, pa.int32())})
    pairs = [(x, y) for x in range(61) for y in range(61) if inside or side[x] != side[y]]
    want = sum(times[x] * times[y] * masi(set(sets[x]), set(sets[y])) for x, y in pairs)
    assert agreement._closeness(block)["close"][0].as_py() == pytest.approx(want, rel=1e-12)


def test_work_follows_items_and_blocks(monkeypatch):
    """A product used to be 2,048 columns wide, whatever items there are, and a set went to four times as many tasks."""
    assert agreement.SETS_PER_BLOCK >= 8000
    made = []
    zeros = np.zeros
    monkeypatch.setattr(agreement.np, "zeros", lambda shape, *a: made.append(shape) or zeros(shape, *a))
    sets = [[k % 7, 7 + k % 5] for k in range(35)]
    agreement._closeness(pa.table({"granularity": ["g"] * 35, "times": [1.0] * 35, "items": pa.array(sets, pa.list_(pa.int64())), "size": pa.array([2] * 35, pa.int32()), "side": pa.array([0] * 35, pa.int32())}))
    assert max(x[1] for x in made if isinstance(x, tuple)) <= 12


def _brute(sets, times, mine, other):
    have = np.zeros((len(sets), 1 + max(max(s) for s in sets)))
    for k, s in enumerate(sets):
        have[k, s] = 1
    size, shared = have.sum(axis=1), have[mine] @ have[other].T
    a, b = size[mine][:, None], size[other][None, :]
    steps = np.where((shared == a) & (shared == b), 1, np.where((shared == a) | (shared == b), 2 / 3, 1 / 3))
    return times[mine] @ (shared / (a + b - shared) * steps) @ times[other]


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("repeated", [1, 3, 700, 0.5])
@pytest.mark.parametrize("names, sizes, light", [(40, [9, 10, 11], 0), (9, [1, 2, 3, 4], 2), (3000, [20], 0), (300, range(1, 90), 0)])
def test_pairs_in_words_of_bits(monkeypatch, names, sizes, light, repeated, inside):
    """Sets of few sizes that fill words, repeated alike or not, in several tiles, with sizes that light items add to; and sets of many sizes."""
    draw = np.random.default_rng(names)
    monkeypatch.setattr(agreement, "WORDS", 7, raising=False)
    monkeypatch.setattr(agreement, "CELLS", 5000, raising=False)
    sets = [np.sort(draw.choice(names, draw.choice(list(sizes)), replace=False)) for _ in range(900)]
    times = draw.integers(1, repeated + 1, 900) * 1.0 if repeated >= 1 else draw.integers(1, 4, 900) * repeated
    side = np.zeros(900, np.int32) if inside else (np.arange(900) % 3 == 0).astype(np.int32)
    size = np.array([len(s) for s in sets])
    block = pa.table({"granularity": ["g"] * 900, "times": times, "items": pa.array(sets, pa.list_(pa.int64())), "size": pa.array(size + light, pa.int32()), "side": side})
    if light:  # items of its own that no other set has
        sets = [np.concatenate([s, names + light * k + np.arange(light)]) for k, s in enumerate(sets)]
    mine, other = (np.arange(900), np.arange(900)) if inside else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    want = _brute(sets, times, mine, other) * (1 if inside else 2)
    if light and inside:  # a set meets itself in its light items as well, which isn't counted here
        alone = size / (size + 2 * light) / 3
        want += (times * times * (alone - 1)).sum()
    assert agreement._closeness(block)["close"][0].as_py() == pytest.approx(want, rel=1e-12)


def test_counts_of_pairs_are_not_held(monkeypatch):
    """What the pairs of two blocks share used to be held at once, as floats: here more than 16 MB."""
    draw = np.random.default_rng(1)
    sets = [np.sort(draw.choice(40, 10, replace=False)) for _ in range(8000)]
    side = (np.arange(8000) % 2).astype(np.int32)
    block = pa.table({"granularity": ["g"] * 8000, "times": np.ones(8000), "items": pa.array(sets, pa.list_(pa.int64())), "size": pa.array([10] * 8000, pa.int32()), "side": side})
    tracemalloc.start()
    close = agreement._closeness(block)["close"][0].as_py()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert close == pytest.approx(2 * _brute(sets, np.ones(8000), np.flatnonzero(side == 0), np.flatnonzero(side == 1)), rel=1e-12)
    assert peak < 12 << 20


@pytest.mark.parametrize("name", ["a12_krippendorff_masi", "a13_agreement_report"])
def test_elements_are_made_once(spark, sf, monkeypatch, name):
    """Sets, distances and the number of units used to read the events and shuffle their elements each for itself."""
    plans = []
    write = agreement.materialise
    monkeypatch.setattr(agreement, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    plans.append(queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
    reading = [p for p in plans if "props" in p]
    assert len(reading) == 1
    assert reading[0].count("Exchange") == (1 if name.startswith("a13") else 2)  # by user, and for a12 by set


def test_a_block_goes_to_its_tasks_as_one_row(spark, monkeypatch):
    """Every set used to be a row for every other block."""
    monkeypatch.setattr(agreement, "SETS_PER_BLOCK", 50)
    sets = spark.range(400).selectExpr("'g' AS granularity", "array('a' || id % 20, 'b' || id div 20, 'c') AS items", "1.0D AS times")
    plan = agreement.closeness(sets, 0)
    seen = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "sets#" in seen and "items#" not in seen
    assert plan.first()["close"] > 400

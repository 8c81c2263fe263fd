"""Consecutive numbers, and what is built on them."""

import pytest
from pyspark.sql import functions as F

from accordant.operators import numbering, results


@pytest.mark.parametrize("n,partitions", [(0, 3), (1, 8), (5000, 7)])
def test_numbers_follow_the_order(spark, n, partitions):
    rows = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 0 WHEN id % 50 = 1 THEN NULL ELSE id * 7919 % 1000 END AS k", "id AS v", "1 AS at").repartition(4)
    out = numbering.numbered(rows, ["k"], partitions=partitions)
    assert out.columns == ["k", "v", "at"]
    found = sorted(out.collect(), key=lambda r: r["at"])
    assert [r["at"] for r in found] == list(range(n)) and len({r["v"] for r in found}) == n
    keys = [(r["k"] is not None, r["k"] or 0) for r in found]
    assert keys == sorted(keys)


def test_a_frequent_key_is_not_one_task(spark):
    rows = spark.range(20_000).selectExpr("0 AS k")
    ranges = numbering.numbered(rows, ["k"], partitions=8)
    assert ranges.agg(F.max("at"), F.count_distinct("at")).first() == (19_999, 20_000)
    assert "SinglePartition" not in ranges._jdf.queryExecution().toString()


def test_requests_are_numbered_without_a_single_task(spark):
    grid = results.request_grid(spark.range(30).selectExpr("concat('i', id) AS instance"), ["a", "b"])
    assert "Window" not in grid._jdf.queryExecution().toString()
    ids = sorted("i%d" % k for k in range(30))
    want = {(f"c{(k * 2 + o) * 2 + p}", i, o, "ab"[p]) for k, i in enumerate(ids) for o in (0, 1) for p in (0, 1)}
    assert {tuple(r) for r in grid.collect()} == want


def test_any_number_of_runs(spark):
    rows = spark.range(1500).selectExpr("id AS day", "explode(array('x', 'y', concat('z', id div 2))) AS node").union(spark.createDataFrame([(None, "q")], "day long, node string"))
    base, run = results.consecutive(rows, "day")
    found = results.run_difference(base, run, ["run", "node"])
    assert found.count() == 2 * 749 and found.agg(F.count_distinct("run")).first()[0] == 749
    assert {tuple(r) for r in found.filter("run = 2").collect()} == {(2, "z0", 1, 0), (2, "z1", 0, 1)}


def test_units_for_people_are_numbered(spark):
    aggregated = spark.createDataFrame([("b", "partial", None, None, "low confidence", True), ("a", "aligned", None, None, "", False), ("A", None, None, None, "no valid verdicts", True)], "unit string, final string, order0 string, order1 string, flag_reason string, flagged boolean")
    assert [(r["at"], r["unit"]) for r in results.flagged(aggregated).orderBy("at").collect()] == [(0, "A"), (1, "b")]
    statuses = spark.createDataFrame([("c", "agree"), ("a", "agree"), ("b", "conflict")], "unit string, status string")
    assert [tuple(r) for r in results.with_status(statuses, "agree", limit=1).collect()] == [(0, "a")]
    pilot = spark.createDataFrame([("x",), ("x",), ("z",)], "instance string")
    assert results.members(spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "instance string, v int"), pilot).count() == 2
    seen = results.first_seen_counts(spark.createDataFrame([("q", 1), ("r", 2), ("r", 4), ("q", 3), ("s", 0)], "c string, at int"), "c", ["at"])
    assert [tuple(r) for r in seen.orderBy("at").collect()] == [(0, "q", 2), (1, "r", 2), (2, "s", 1)]

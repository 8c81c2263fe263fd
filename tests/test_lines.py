"""Logical lines, the line index and the joins with hot keys, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from accordant.operators import joins, lines, statements

SPANS = {
    "": [],
    "# only a comment\n\n": [],
    "x = 1": [(1, 1)],
    "x = 1; y = 2\nz = 3\n": [(1, 1), (2, 2)],
    "def f(\n    a,\n    b,  # why\n):\n    # note\n\n    return (a +\n            b)\n": [(1, 4), (7, 8)],
    '@mark\nclass A:\n    """Says\n    much."""\n\n    k = [\n\n        1,\n    ]\n': [(1, 1), (2, 2), (3, 4), (6, 9)],
    "a = 1 \\\n    + 2\nif a:\n    pass\nelse:\n    b = '''\n\n'''\n": [(1, 2), (3, 3), (4, 4), (5, 5), (6, 8)],
    "good = 1\nbad = (\n": [(1, 1)],
    "if x:\n        y\n    z\n": [(1, 1), (2, 2)],
}


@pytest.mark.parametrize("source", SPANS)
def test_logical_lines_of_a_file(source):
    assert lines.statement_spans(source) == SPANS[source]


def test_each_file_is_cut_once(spark):
    body = "def f():\n" + "".join(f"    x{k} = g({k},\n        0)\n" for k in range(200))
    sources = spark.createDataFrame([("p", "c", f"f{k}.py", body) for k in range(5)] + [("p", "c", "f0.py", body), ("p", "c", "unasked.py", body)], "repo string, commit string, path string, text string")
    rows = spark.range(2000).selectExpr("concat('o__p-', id) AS instance_id", "'c' AS base_commit", "concat('f', id % 3, '.py') AS file", "cast(id % 402 + 1 AS string) AS line", "'' AS statements")
    seen = spark.sparkContext.accumulator(0)
    found = statements.extract(rows, sources, seen).collect()
    assert seen.value == 3 and len(found) == 2000
    for r in found:
        n = int(r["line"])
        want = (1, 1) if n == 1 else (n - n % 2, n - n % 2 + 1) if n < 402 else (None, None)
        assert (r["start_line"], r["end_line"]) == want
        if n > 1 and n < 402:
            k = n // 2 - 1
            assert r["extracted_statement"] == f"x{k} = g({k},\n    0)" and r["note"] == "multiline"


def test_large_files_leave_in_pieces(spark, monkeypatch):
    files = spark.createDataFrame([("a", "x = 1\n" * 50_000), ("b", None)], "k string, text string")
    out = lines.logical_lines(files, ["k"])
    assert out.agg(F.count("*"), F.min("start"), F.max("end"), F.count_distinct("start")).first() == (50_000, 1, 50_000, 50_000)
    index = lines.line_index(files, ["k"])
    assert {tuple(r) for r in index.groupBy("k").agg(F.count("*"), F.max("pos"), F.max("high")).collect()} == {("a", 50_001, 50_001, 150_000), ("b", 1, 1, 0)}


WORDS = ["x = 1", "x  =  1", "call(a,", "  b)", "", "   ", 'say("hi")', "say('hi')", "}", "caf\u00e9\u00a0x"]


def test_index_checks_as_the_lines_say(spark):
    """Every status of check_rows against `check` over the array of all lines."""
    draw = random.Random(5)
    files = [[draw.choice(WORDS) for _ in range(n)] for n in (1, 2, 40, 60)] + [["}"] * 30, ["a"] + [""] * 30 + ["b"], [f"p{k}" for k in range(40)]]
    cases = []
    for f, own in enumerate(files):
        for n in range(1, len(own) + 2):
            here = own[n - 1 : n + draw.choice([0, 1, 2, 24, 25])]
            for stmt in ("", draw.choice(WORDS), " ".join(here), "".join(here).replace('"', "'"), own[(n + 3) % len(own)], own[(n + 10) % len(own)].replace("'", '"'), "no ... such"):
                cases.append((f"o__p-{f}", "c", f"f{f}", str(n), stmt))
    sources = spark.createDataFrame([("p", "c", f"f{k}", "\n".join(own)) for k, own in enumerate(files)], "repo string, commit string, path string, text string")
    rows = spark.createDataFrame(cases, "instance_id string, base_commit string, file string, line string, statements string")
    text = {f"f{k}": own for k, own in enumerate(files)}
    plain = spark.createDataFrame([(*c, text[c[2]]) for c in cases], "instance_id string, base_commit string, file string, line string, statements string, lines array<string>")
    said = statements.check(F.col("lines"), F.col("line").cast("int"), F.col("statements"))
    want = plain.select("file", "line", "statements", said.alias("c")).selectExpr("file", "line", "statements", "coalesce(c.status, 'error:line_out_of_range')", "coalesce(c.repo_line, '')", "coalesce(c.detail, '')")
    got = statements.check_rows(rows, sources).select("file", "line", "statements", "status", "repo_line", "detail")
    got, want = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert got == want
    assert {r[3] for r in got} == {"match", "whitespace", "multiline", "quote_diff", "line_offset", "paraphrase", "mismatch", "error:line_out_of_range"}


def test_spans_that_contain_points(spark):
    draw = random.Random(7)
    spans = [(draw.choice("ab"), s, s + draw.choice([0, 1, 2, 5, 40, 300, -1]), i) for i, s in enumerate(draw.choices(range(-50, 400), k=300))] + [("a", None, 3, 0), (None, 0, 9, 0), ("a", 5, None, 0)]
    points = [(draw.choice(["a", "b", "c", None]), draw.choice([*range(-60, 420), None]), i) for i in range(1500)] + [("a", 7, 0)] * 800
    got = joins.containing(spark.createDataFrame(points, "k string, line int, i int"), spark.createDataFrame(spans, "k string, start int, end int, own int"), ["k"], "line", ["own"])
    found = sorted(str((r["k"], r["line"], r["start"], r["end"])) for r in got.collect())
    want = []
    for k, n, _ in points:
        fits = [s[1:3] for s in spans if k is not None and n is not None and s[0] == k and s[1] is not None and s[2] is not None and s[1] <= n <= s[2]]
        want.append((k, n, *(min(fits) if fits else (None, None))))
    assert found == sorted(map(str, want))


def test_nearest_rows(spark):
    draw = random.Random(9)
    rows = [(draw.choice("ab"), draw.randrange(300)) for _ in range(90)]
    points = [(draw.choice("abc"), draw.randrange(300)) for _ in range(200)]
    got = joins.nearest(spark.createDataFrame(points, "k string, n long"), spark.createDataFrame(rows, "k string, pos int"), ["k"], "n", "pos", 10)
    want = set()
    for k, n in points:
        far = [p - n for q, p in rows if q == k and 0 < abs(p - n) <= 10]
        if far:
            want.add((k, n, min(far, key=lambda d: (abs(d), d))))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("frequent", [1, 3, 10_000])
def test_lookup_keeps_hot_keys_and_nulls(spark, monkeypatch, frequent):
    monkeypatch.setattr(joins, "FREQUENT", frequent)
    rows = spark.createDataFrame([("hot", k) for k in range(500)] + [(None, 1), (None, 2), ("rare", 3), ("none", 4)], "k string, v int")
    keyed = joins.distinct_keys(rows, ["k"]).filter("NOT k <=> 'none'").withColumn("said", F.coalesce("k", F.lit("null")))
    inner = joins.lookup(rows, keyed, ["k"])
    assert inner.columns == ["k", "v", "said"] and inner.filter("said = coalesce(k, 'null')").count() == inner.count() == 503
    assert joins.lookup(rows, keyed, ["k"], how="left").filter("said IS NULL").count() == 1

"""What a task holds, and how often work is done, as tables grow."""

import random
import re
import tokenize

import pytest
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators import joins, lines, patches, reconcile, statements
from accordant.plans import more, queries


def test_matching_deals_rows_to_tasks_of_a_fixed_share(spark, monkeypatch):
    """Small shuffled partitions used to be joined to a few tasks, whatever number of rows they held."""
    monkeypatch.setattr(joins, "ROWS_AT_ONCE", 500)
    n = F.col("id")
    locs = spark.range(20_000).select((n % 3000).alias("unit"), F.when(n % 2 == 0, "A").otherwise("B").alias("side"), n.cast("int").alias("idx"), F.concat(F.lit("f"), n % 2).alias("file"), (n % 5).cast("int").alias("line"), F.lit("s").alias("stmt"))
    assert reconcile.match(locs).rdd.getNumPartitions() == 40


@pytest.mark.parametrize("name", ["a1_status_counts", "p20_resolution_override", "p21_merge_documents"])
def test_units_are_dealt_to_tasks_of_a_fixed_share(spark, sf, monkeypatch, name):
    """What follows the matcher used to be grouped and joined by unit in the session's number of partitions, whatever the rows."""
    monkeypatch.setattr(joins, "ROWS_AT_ONCE", 500)
    monkeypatch.setattr(queries, "materialise", lambda df, _: df)  # all in one plan
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((?:unit|l_orderkey)#\d+L?(?:, \w+#\d+)*, (\d+)\)", plan)
    assert len(dealt) > 2 and min(map(int, dealt)) > 9  # of 6,000 rows, some 5,400 matches; the session has 4


def test_probe_of_unmatched_rows_deals_them_to_tasks_of_a_fixed_share(spark, sf, monkeypatch):
    """The windows and pairs of the matcher used to stand in the session's number of partitions here too."""
    monkeypatch.setattr(joins, "ROWS_AT_ONCE", 500)
    plan = queries.j3_same_side_probe(spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((?:unit|l_orderkey)#\d+L?(?:, \w+#\d+)*, (\d+)\)", plan)
    assert len(dealt) > 1 and min(map(int, dealt)) > 9  # of 6,000 rows; the session has 4


def nodes(tree: str, name: str) -> int:
    return tree.count(name)


def test_expressions_are_worked_out_once(spark):
    """The margin of a statement used to be worked out again for each of its lines, squeezed texts for each way to say them."""
    row = spark.createDataFrame([(["    a", "      b", "", "    c"], "x  y", "x y z")], "lines array<string>, cur string, ext string")
    margin = row.select(statements.dedented(F.col("lines"), F.lit(1), F.lit(4)).alias("t"))
    assert margin.first()["t"] == "a\n  b\n\nc"
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert nodes(plan(margin), "regexp_extract(") == 1
    change = row.select(statements.change(F.col("cur"), F.col("ext")).alias("c"))
    assert tuple(change.first()["c"]) == ("unsafe", "sub-statement pointer, balloons x1.67", 5 / 3)
    assert nodes(plan(change), "regexp_replace(") == 6


def test_heads_of_hunks_are_read_once(spark):
    """A head used to be matched anew for each of its numbers, and twice for counts; missing counts are one."""
    text = "--- a/x\n+++ b/x\n@@ -3 +4,2 @@ f\r\n-a\n+b\n+c\n"
    found = patches.hunks(spark.createDataFrame([(1, text)], "k int, text string"), ["k"])
    assert found.select("old_file", "new_file", "old_start", "old_count", "new_start", "new_count").first()[:] == ("x", "x", 3, 1, 4, 2)
    assert nodes(found._jdf.queryExecution().analyzed().toString(), "regexp_extract(_h") == 0


def test_plain_source_is_not_tokenized(monkeypatch):
    """Every file used to go through the tokenizer; of source that only brackets and margins tell, lines are read at once."""
    parts = ["x", "if", "1", "007", "1.", "1a", "=", "(", ")", "[", "]", "{", "}", ",", ":", ";", " ", "\n", "\n    ", "\n  ", "# c (", "'a'", "\\\n", "\t", "$", "\u00e9"]
    draw = random.Random(11)
    sources = ["".join(draw.choices(parts, [1, 1, 1] + [0.2] * 3 + [1] * 15 + [0.1] * 5, k=draw.randrange(30))) for _ in range(20_000)]
    plain = [(s, found) for s in sources if (found := lines._plain_spans(s)) is not None]
    assert len(plain) > 1000 and all(found == lines._spoken_spans(s) for s, found in plain)
    monkeypatch.setattr(tokenize, "generate_tokens", None)
    assert lines.statement_spans("def f():\n    # a (\n    v = g(1,\n\n          2)  # b\n\n    x = 3") == [(1, 1), (3, 5), (7, 7)]


def test_extraction_deals_rows_to_tasks_of_a_fixed_share(spark, monkeypatch):
    """Rows used to be looked up in the session's number of partitions, after two sorts of all of them; a file of very many rows
    goes to several tasks, and is told from the next one also where Arrow batches end."""
    monkeypatch.setattr(joins, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(statements, "HOT", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        body = "def f():\n" + "".join(f"    x{k} = g({k},\n        0)\n" for k in range(100))
        texts = [("p", "c", f"f{k}.py", body.replace("x", f"y{k}_")) for k in range(20)] + [("p", "c", "f0.py", None), ("p", "c", "none.py", None), (None, None, None, body)]
        sources = spark.createDataFrame(texts, "repo string, commit string, path string, text string")
        rows = spark.range(3000).selectExpr("concat(CASE WHEN id % 50 = 7 THEN 'o__q-' ELSE 'o__p-' END, id) AS instance_id", "CASE WHEN id % 31 = 0 THEN '' ELSE 'c' END AS base_commit", "CASE id % 6 WHEN 0 THEN concat('f', id % 24, '.py') WHEN 1 THEN 'none.py' WHEN 2 THEN 'lost.py' ELSE 'f0.py' END AS file", "CASE WHEN id % 29 = 0 THEN 'six' ELSE cast(id % 202 + 1 AS string) END AS line", "'' AS statements", "id % 2 AS start")
        seen = spark.sparkContext.accumulator(0)
        out = statements.extract(rows, sources, seen)
        assert out.columns == [*rows.columns, "start_line", "end_line", "n_lines", "extracted_statement", "note"]
        found = out.collect()
        dealt = re.findall(r"hashpartitioning\(path#\d+, commit#\d+, repo#\d+, _share#\d+L, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert dealt and set(dealt) == {"60"} and len({r["instance_id"] for r in found}) == len(found) == 3000
    assert 6 < seen.value <= 60 + 6  # f0.py once a share, at most
    for r in found:
        at, n = int(r["instance_id"][5:]), 0 if r["line"] == "six" else int(r["line"])
        known = r["file"] == "none.py" or (r["file"] != "lost.py" and int(r["file"][1:-3]) < 20)
        stopped = "line_not_int (ignored)" if at % 29 == 0 else "no_base_commit" if at % 31 == 0 else "repo_missing" if at % 50 == 7 else None if known else "path_or_commit_missing"
        want = (None, None, "", stopped or "no_statement_at_line (blank/comment?)")
        if not stopped and r["file"] != "none.py" and n < 202:
            k, name = n // 2 - 1, f"y{r['file'][1:-3]}_"
            want = (1, 1, "def f():", "") if n == 1 else (n - n % 2, n - n % 2 + 1, f"{name}{k} = g({k},\n    0)", "multiline")
        assert (r["start_line"], r["end_line"], r["extracted_statement"], r["note"]) == want


@pytest.mark.parametrize("name", ["a34_extract_summary", "a33_spans_by_instance", "p22_replacements"])
def test_extracting_queries_deal_rows_to_tasks_of_a_fixed_share(spark, sf, monkeypatch, name):
    """No exchange of rows, or of what is found for them, stands at the session's number of partitions."""
    monkeypatch.setattr(joins, "ROWS_AT_ONCE", 500)
    plan = getattr(more, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((?:path|instance_id)#\d+(?:, \w+#\d+L?)*, (\d+)\)", plan)
    assert len(dealt) >= (2 if name.startswith("a33") else 1) and min(map(int, dealt)) > 9  # of 6,000 rows; the session has 4


def test_extracted_text_is_made_once_a_span(spark, sf):
    """Margins used to be cut by column functions, for each row that asks and again in the filter on what differs; the file and commit
    of a row went twice, as keys and inside of it."""
    plan = more.p22_replacements(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract(" not in plan and "base_commit, " not in plan
    draw = random.Random(5)
    parts = ["a", "b c", " ", "  ", "\t", "\n", "\n  ", "\r", "\x85", "\u2028", "\u2029", "\xa0", "\x1c", "\u3000", "\u200b", "\f"]
    bodies = spark.createDataFrame([("".join(draw.choices(parts, k=draw.randrange(12))),) for _ in range(5000)], "body string")
    split = F.split("body", "\n", -1)
    made = bodies.select("body", statements.dedented(split, F.lit(1), F.size(split)).alias("text")).collect()
    assert len({r["text"] for r in made}) > 1000 and all(r["text"] == lines.dedent(r["body"].split("\n")) for r in made)


@pytest.mark.parametrize("text", [None, "", "a__b-12", "a__b__c-1-23", "b-12", "__-", "a__-1", "a__12", "a__b-", "a__b-x1", "x\n__b-1", "a__b-1\n", "a__b-1\u2028", "\u00e9__\u00fc-9", "a___b-1"])
def test_repo_names_without_patterns(spark, text):
    """Names are cut without patterns, which took more time than reading the rows; what patterns say of line ends stays."""
    old = F.regexp_replace(F.regexp_replace(F.coalesce("t", F.lit("")), "^.*?__", ""), "-[0-9]+$", "")
    one = spark.createDataFrame([(text,)], "t string").select(old.alias("a"), T.repo_name("t").alias("b"), F.col("t")).first()
    assert one["a"] == one["b"]


def test_extraction_reads_rows_once_for_files_and_sorts_by_plain_keys(spark):
    """Rows used to be put together once more to list the files, and looked up by two columns a key, as if keys could be null."""
    body = "def f():\n    x = 1 \x0c\n    v = g(1,\n      2)\n"
    sources = spark.createDataFrame([("p", "c", "a.py", body)], "repo string, commit string, path string, text string")
    rows = spark.createDataFrame([("o__p-1", "c", f, n, s) for f in ("a.py", "b.py", None) for n in ("2", "4", None) for s in ("x  =  1", "1", None)], "instance_id string, base_commit string, file string, line string, statements string")
    found = statements.extract(rows, sources)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "coalesce(path" not in plan and "isnull(path" not in plan
    said = {tuple(r) for r in found.filter("file = 'a.py' AND line IS NOT NULL").select("line", "statements", "start_line", "extracted_statement", "note").collect()}
    wrapped = "v = g(1,\n  2)"
    assert said == {
        ("2", "x  =  1", 2, "x = 1", ""), ("2", "1", 2, "x = 1", ""), ("2", None, 2, "x = 1", ""),
        ("4", "x  =  1", 3, wrapped, "multiline; current_not_contained"), ("4", "1", 3, wrapped, "multiline"), ("4", None, 3, wrapped, "multiline"),
    }
    assert {r["note"] for r in found.filter("file IS NULL OR line IS NULL OR file = 'b.py'").collect()} == {"no_location", "line_not_int (ignored)", "path_or_commit_missing"}

"""Hunks, edits and carried lines against patches made by hand and by difflib."""

import difflib
import random

import pytest

from accordant.operators import patches
from accordant.sources import readers

PATCH = """diff --git a/pkg/a.py b/pkg/a.py
index 1..2 100644
--- a/pkg/a.py
+++ b/pkg/a.py
@@ -2,5 +2,4 @@ def f():
 two
--- three
-four
+++ both

 six
@@ -10 +9,2 @@
-ten
+ten
+more
\\ No newline at end of file
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1,2 @@
+a
+b
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/old name.py b/moved.py
similarity index 90%
rename from old name.py
rename to moved.py
--- a/old name.py
+++ b/moved.py
@@ -3,0 +4,2 @@
+x
+y
"""


def test_hunks_edits_and_names(spark):
    df = spark.createDataFrame([(1, PATCH), (2, None), (3, "no patch")], "id long, text string")
    heads = [tuple(r)[2:8] for r in patches.hunks(df, ["id"]).orderBy("_file", "hunk").collect()]
    assert heads[:2] == [("pkg/a.py", "pkg/a.py", 0, 2, 5, 2), ("pkg/a.py", "pkg/a.py", 1, 10, 1, 9)] and len(heads) == 5
    found = {(r["old_file"], r["new_file"], r["at"], r["removed"], r["added"]) for r in patches.edits(df, ["id"]).collect()}
    assert found == {
        ("pkg/a.py", "pkg/a.py", 3, 2, 1),
        ("pkg/a.py", "pkg/a.py", 10, 1, 2),
        (None, "new.py", 1, 0, 2),
        ("gone.py", None, 1, 2, 0),
        ("old name.py", "moved.py", 4, 0, 2),
    }


def test_lines_are_carried(spark):
    df = spark.createDataFrame([(1, PATCH)], "id long, text string")
    asked = {"pkg/a.py": [1, 2, 3, 4, 5, 6, 9, 10, 11, 500], "gone.py": [1, 2], "old name.py": [3, 4], "untouched.py": [7]}
    points = spark.createDataFrame([(1, f, n) for f, own in asked.items() for n in own] + [(2, "pkg/a.py", 10)], "id long, file string, line int")
    got = {(r["id"], r["file"], r["line"]): (r["new_file"], r["new_line"]) for r in patches.carried(points, patches.edits(df, ["id"]), ["id"]).collect()}
    none = (None, None)
    want = {1: 1, 2: 2, 3: None, 4: None, 5: 4, 6: 5, 9: 8, 10: None, 11: 11, 500: 500}
    assert [got[1, "pkg/a.py", n] for n in want] == [none if z is None else ("pkg/a.py", z) for z in want.values()]
    assert got[1, "gone.py", 1] == got[1, "gone.py", 2] == none
    assert (got[1, "old name.py", 3], got[1, "old name.py", 4]) == (("moved.py", 3), ("moved.py", 6))
    assert got[1, "untouched.py", 7] == ("untouched.py", 7) and got[2, "pkg/a.py", 10] == ("pkg/a.py", 10)


@pytest.mark.parametrize("context", [0, 1, 3])
def test_random_patches(spark, context):
    draw = random.Random(context)
    rows, points, want = [], [], {}
    for k in range(40):
        old = [draw.choice(["a", "b", "-- c", "++ d", "", "@@ -1 +1 @@", "diff --git"]) for _ in range(draw.randrange(60))]
        new = [x for y in old for x in draw.choice([[y]] * 6 + [[], ["n"], [y, "m"], ["q", y]])]
        lines = list(difflib.unified_diff(old, new, "a/f", "b/f", n=context, lineterm=""))
        text = "\n".join((["diff --git a/f b/f"] if k % 2 else []) + lines) + "\n"
        rows.append((k, text))
        match = difflib.SequenceMatcher(None, old, new)
        kept = {b.a + i + 1: b.b + i + 1 for b in match.get_matching_blocks() for i in range(b.size)}
        for n in range(1, len(old) + 1):
            points.append((k, "f", n))
            want[k, n] = kept.get(n)
    found = patches.carried(spark.createDataFrame(points, "id int, file string, line int"), patches.edits(spark.createDataFrame(rows, "id int, text string"), ["id"]), ["id"])
    assert {(r["id"], r["line"]): r["new_line"] for r in found.collect()} == want


def test_recorded_lines_of_variants(spark, tmp_path):
    """Files to differences: patches and ground truth read by their names."""
    own = tmp_path / "own__repo-1"
    own.mkdir()
    (own / "1.patch").write_text("--- a/f.py\n+++ b/f.py\n@@ -3 +3,2 @@\n-x\n+y\n+z\n")
    (own / "2_unverified.patch").write_text("--- a/f.py\n+++ b/f.py\n@@ -1,0 +2 @@\n+y\n")
    (own / "1-gt.json").write_text("[2,10]")
    (own / "2-gt.json").write_text("[2, 9]")
    (own / "13-summary.json").write_text("[1,2]")
    (own / "base_commit.txt").write_text("abc")
    at = f"file://{tmp_path}"
    assert [tuple(r) for r in readers.combined_rules(spark, at).collect()] == [("own__repo-1", 13, [1, 2])]
    assert ("own__repo-1", "base_commit", "abc") in {tuple(r) for r in readers.instance_fields(spark, at).collect()}
    truth, given = readers.variant_truth(spark, at), readers.variant_patches(spark, at)
    assert {(r["rule"], r["verified"]) for r in given.collect()} == {(1, True), (2, False)}
    keys = ["instance", "rule"]
    points = given.selectExpr(*keys, "'f.py' AS file", "explode(array(2, 9)) AS line")
    found = patches.truth_differences(truth, patches.carried(points, patches.edits(given, keys), keys), keys)
    assert [tuple(r) for r in found.collect()] == [("own__repo-1", 2, [2, 9], [3, 10])]

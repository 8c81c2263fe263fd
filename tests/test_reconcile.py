import random

from accordant.operators import reconcile
from accordant.sources import readers


def greedy(a, b):
    """Pairs (step, a_idx, b_idx) by taking, pass by pass, the first right location that fits each left one."""
    loose = lambda s: s.replace(" ", "").rstrip(",:;")
    keys = [lambda x: (x[1], x[2], x[3]), lambda x: (x[1], x[3]), lambda x: (x[1], x[2]), lambda x: (x[1], loose(x[3]))]
    out, a, b = set(), list(a), list(b)
    for step, key in enumerate(keys, 1):
        for left in list(a):
            hit = next((r for r in b if key(r) == key(left)), None)
            if hit:
                out.add((step, left[0], hit[0]))
                a.remove(left)
                b.remove(hit)
    return out | {(5, x[0], None) for x in a} | {(5, None, x[0]) for x in b}


def test_matching_is_greedy(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for unit in range(150):
        sides = {s: [(i, rng.choice("fg"), rng.choice([None, 1, 2, 15]), rng.choice(["x", "x,", "y z", "yz"])) for i in range(rng.randint(0, 6))] for s in "AB"}
        rows += [(unit, s, *x) for s, own in sides.items() for x in own]
        want[unit] = greedy(sides["A"], sides["B"])
    found = reconcile.match(spark.createDataFrame(rows, "unit int, side string, idx int, file string, line int, stmt string"))
    got = {u: set() for u in want}
    for r in found.collect():
        got[r["unit"]].add((r["step"], r["a_idx"], r["b_idx"]))
    assert got == want


def test_readers(spark, tmp_path):
    (tmp_path / "x__y-1.json").write_text('{"root_cause": [{"file": "a.py", "line": "12", "statement": "s"}, 3, {"file": "b.py", "line": null}]}')
    docs = readers.json_documents(spark, str(tmp_path))
    assert [tuple(r) for r in readers.locations(docs).orderBy("idx").collect()] == [("x__y-1", 0, "a.py", 12, "s"), ("x__y-1", 2, "b.py", None, "")]
    junit = tmp_path / "r.xml"
    junit.write_text('<testsuite><testcase classname="m.T" name="a" file="m.py"/><testcase classname="m" name="b" file="m.py"><failure message="no"/></testcase><testcase name="c"><skipped message="xfail"/></testcase></testsuite>')
    rows = {r["name"]: (r["decisive"], r["message"]) for r in readers.junit_cases(spark, str(junit)).collect()}
    assert rows == {"a": (None, None), "b": ("failure", "no"), "c": ("skipped", "xfail")}
    (tmp_path / "ids.txt").write_text("1 django__django-11\n\n2 a__b-3\n2 a__b-3\n")
    assert sorted(r[0] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["b-3", "django-11"]

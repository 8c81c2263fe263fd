"""Folders in, folders out, against documents made by hand."""

import csv
import glob
import json

import pytest

from accordant import chains
from accordant.operators import documents
from accordant.sources import committed


def loc(file, line, statement, **more):
    return {"file": file, "line": line, "statement": statement, **more}


A = {
    "same": {"instance_id": "same", "root_cause": [loc("./a.py", 3, "x  = 1")], "confidence": 5, "reasoning": "ra", "own": {"kept": [1, None, "é"]}},
    "near": {"root_cause": [loc("a.py", 3, "x = 1", note="na"), "odd"], "confidence": "high", "reasoning": None, "multi_rc": True, "is_defensive": False},
    "far": {"root_cause": [loc("a.py", 1, "x"), loc("b.py", 9, "f(a);"), loc("c.py", 4, "g"), loc("d.py", 5, "h()")], "fault_triggering_call_site": [loc("t.py", 2, "t")], "reasoning": "ra far"},
    "skipped": {"root_cause": [loc("a.py", 1, "x")]},
    "won": {"root_cause": [loc("a.py", 1, "x")], "reasoning": "ra won"},
    "only_a": {"root_cause": []},
    "bare": {},
}
B = {
    "same": {"instance_id": "same", "root_cause": [loc("a.py", 3, "x = 1")], "confidence": 5, "reasoning": "rb"},
    "near": {"root_cause": [loc("a.py", 5, "x = 1")], "confidence": "low", "reasoning": "rb near", "multi_rc": False, "is_defensive": None},
    "far": {"root_cause": [loc("a.py", 1, "y", note=7), loc("b.py", 90, "f(a)"), loc("a.py", None, "z")], "fault_triggering_call_site": [], "reasoning": "rb far"},
    "skipped": {"root_cause": [loc("a.py", 2, "y")]},
    "won": {"root_cause": [loc("b.py", 1, "x")], "reasoning": "rb won", "confidence": 1},
    "bare": {"root_cause": None},
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    top = tmp_path_factory.mktemp("chains")
    for name, docs in (("a", A), ("b", B)):
        (top / name).mkdir()
        for stem, doc in docs.items():
            (top / name / f"{stem}.json").write_text(json.dumps(doc, ensure_ascii=False))
    return top


def lines(folder):
    return [x for f in sorted(glob.glob(f"{folder}/part-*")) for x in open(f, encoding="utf-8").read().split("\n") if x]


def docs_in(folder):
    return {f.split("unit=")[1]: json.loads(lines(f)[0]) for f in glob.glob(f"{folder}/unit=*")}


def agreement(exact, a, b):
    return {"exact_matches": exact, "locations_ann": a, "locations_bob": b}


def test_merged_folders(spark, folders):
    at = f"file://{folders}"
    choices = spark.createDataFrame([("skipped", " skip "), ("won", "bob"), ("unknown", "A")], "unit string, choice string")
    chains.merge_folders(spark, f"{at}/a", f"{at}/b", f"{at}/merged", f"{at}/report", "ann", "bob", resolutions=choices, include_minor=True)
    merged = docs_in(folders / "merged")
    shift = {"type": "line_mismatch", "severity": "minor", "file": "a.py", "statement": "x = 1", "line_delta": 2, "ann": {"line": 3, "note": "na"}, "bob": {"line": 5, "note": None}}
    flags = [{"type": "confidence_differs", "ann": "high", "bob": "low"}, {"type": "multi_rc_differs", "ann": True, "bob": False}]
    extra = {"type": "extra_location", "severity": "blocking", "line": 1, "statement": "x", "note": None, "same_file_as_other_side": False}
    head = {"annotators": ["ann", "bob"], "primary": "ann"}
    assert merged == {
        "same": A["same"] | {"merge_metadata": head | {"status": "agree", "root_cause_agreement": agreement(1, 1, 1), "reasoning_bob": "rb"}},
        "near": A["near"] | {"merge_metadata": head | {"status": "minor_conflict", "root_cause_agreement": agreement(0, 2, 1), "reasoning_bob": "rb near", "unresolved_conflicts": [shift], "informational_differences": flags}},
        "bare": {"merge_metadata": head | {"status": "agree", "root_cause_agreement": agreement(0, 0, 0), "reasoning_bob": None}},
        "won": B["won"]
        | {
            "merge_metadata": {
                "status": "resolved",
                "annotators": ["ann", "bob"],
                "primary": "bob",
                "root_cause_agreement": agreement(0, 1, 1),
                "reasoning_ann": "ra won",
                "informational_differences": [{"type": "confidence_differs", "ann": None, "bob": 1}],
                "resolved_in_favour_of": "bob",
                "resolved_conflicts": [extra | {"only_in": "ann", "file": "a.py"}, extra | {"only_in": "bob", "file": "b.py"}],
            }
        },
    }
    rows = {r["instance_id"]: r for r in map(json.loads, lines(folders / "report" / "instances"))}
    assert {k: r["status"] for k, r in rows.items()} == {"same": "agree", "near": "minor_conflict", "far": "conflict", "skipped": "skipped_by_resolution", "won": "resolved", "bare": "agree"}
    assert rows["same"]["agreed"] == [{"file": "a.py", "line": 3, "statement": "x = 1"}]
    assert (rows["skipped"]["resolution"], rows["skipped"]["conflict_status_before_skip"], rows["won"]["resolution"]) == ("skip", "conflict", "bob")
    assert rows["far"]["conflicts"] == [
        {"type": "statement_mismatch", "severity": "blocking", "file": "a.py", "line": 1, "ann": {"statement": "x", "note": None}, "bob": {"statement": "y", "note": 7}},
        {"type": "line_and_formatting_mismatch", "severity": "blocking", "file": "b.py", "line_delta": 81, "ann": {"line": 9, "statement": "f(a);"}, "bob": {"line": 90, "statement": "f(a)"}},
        {"type": "extra_location", "severity": "blocking", "only_in": "ann", "file": "c.py", "line": 4, "statement": "g", "note": None, "same_file_as_other_side": False},
        {"type": "extra_location", "severity": "blocking", "only_in": "ann", "file": "d.py", "line": 5, "statement": "h()", "note": None, "same_file_as_other_side": False},
        {"type": "extra_location", "severity": "blocking", "only_in": "bob", "file": "a.py", "line": None, "statement": "z", "note": None, "same_file_as_other_side": True},
    ]
    assert rows["far"]["informational"] == [{"type": "ftcs_differs", "ann": ["t.py:2  t"], "bob": []}]
    (summary,) = map(json.loads, lines(folders / "report" / "summary"))
    assert summary["counts"] == {"agree": 2, "conflict": 1, "minor_conflict": 1, "resolved": 1, "skipped_by_resolution": 1}
    assert summary["conflict_types"]["extra_location"] == 7 and set(summary["agreement_metrics"]) == {"file", "statement", "line", "full"}
    sizes, ids = committed.read_report(spark, f"{at}/report/ids")
    assert sizes == {"agreed": 2, "conflicts": 2, "merged": 4, "conflicts_blocking": 1, "conflicts_minor": 1, "resolved": 1, "skipped_by_resolution": 1}
    assert [r["value"] for r in ids.filter("list = 'merged'").orderBy("pos").collect()] == ["bare", "near", "same", "won"]


def test_ground_truth_from_decisions(spark, folders):
    at = f"file://{folders}"
    agreed = spark.createDataFrame([(" same", "Both", 1), ("near", "B", 2), ("far", "odd", 3)], "unit string, choice string, row int")
    conflicts = spark.createDataFrame([("far", "B", 1), ("won", "A", 2)], "unit string, choice string, row int")
    warnings = chains.decided_documents(spark, agreed, conflicts, f"{at}/a", f"{at}/b", f"{at}/truth")
    assert [r["unit"] for r in warnings.collect()] == ["far"]
    assert docs_in(folders / "truth") == {
        "same": {"instance_id": "same", "root_cause": [loc("./a.py", 3, "x  = 1")], "confidence": 5, "comments": "both agreed", "reasoning": {"annotator1": "ra", "annotator2": "rb"}},
        "near": {"instance_id": "near", "root_cause": [loc("a.py", 3, "x = 1")], "confidence": "high", "comments": "both agreed", "reasoning": {"annotator1": "", "annotator2": "rb near"}},
        "far": {"instance_id": "far", "root_cause": [loc("a.py", 1, "y"), loc("b.py", 90, "f(a)"), loc("a.py", None, "z")], "confidence": None, "comments": "annotator2", "reasoning": {"annotator1": "", "annotator2": "rb far"}},
        "won": {"instance_id": "won", "root_cause": [loc("a.py", 1, "x")], "confidence": None, "comments": "annotator1", "reasoning": {"annotator1": "ra won", "annotator2": ""}},
    }


def test_flat_rows_and_statement_checks(spark, folders):
    at = f"file://{folders}"
    docs = chains.readers.json_documents(spark, f"{at}/a")
    commits = spark.createDataFrame([("same", "c1", 1), ("same", "c2", 2)], "instance_id string, base_commit string, row int")
    flat = sorted(map(tuple, chains.flat_rows(docs, commits).collect()))
    assert ("same", "c1", "./a.py", "3", "x  = 1") in flat and ("bare", "", "", "", "") in flat and ("only_a", "", "", "", "") in flat
    with open(folders / "rows.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["instance_id", "base_commit", "file", "line", "statements"])
        out.writerows([("o__p-1", "c", "f.py", "1", "x = 1"), ("o__p-1", "c", "f.py", "2", 'say(\n    "a")'), ("o__p-2", "", "f.py", "2", "y"), ("o__p-2", "c", "", "", "")])
    sources = spark.createDataFrame([("p", "c", "f.py", 'x = 1\nsay(\n    "a")\n')], "repo string, commit string, path string, text string")
    chains.check_table(spark, f"{at}/rows.csv", sources, f"{at}/checks")
    read = lambda name: spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{at}/checks/{name}").na.fill("").collect()
    assert sorted(r["status"] for r in read("checked")) == ["error:no_base_commit", "match", "multiline", "no_location"]
    assert sorted(r["extracted_statement"] for r in read("extracted")) == ["", "", 'say(\n    "a")', "x = 1"]
    assert [len(read(name)) for name in chains.BUCKETS.values()] == [2, 0, 2]
    spans = [json.loads(x) for x in lines(folders / "checks" / "spans")]
    assert [s["instance_id"] for s in spans] == ["o__p-1"] and len(spans[0]["spans"]) == 2


def test_fields_of_documents(spark):
    df = spark.sql("""SELECT parse_json('{"a":1,"b":{"c":[null]},"d":2}') AS doc""")
    said = df.select(documents.F.to_json(documents.without_field(documents.F.col("doc"), "a", "d")).alias("x"), documents.F.to_json(documents.with_field(documents.F.col("doc"), "a", documents.F.lit('"q\\"r"'))).alias("y")).first()
    assert json.loads(said["x"]) == {"b": {"c": [None]}} and json.loads(said["y"])["a"] == 'q"r'

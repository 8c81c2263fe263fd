"""Readers on files made for them, and sinks by reading back what they wrote."""

import json
import os

import pytest
from pyspark.sql import functions as F

from accordant.operators import results
from accordant.sources import readers, sinks


def lines(path):
    return sorted(x for f in os.listdir(path) if f.startswith("part-") for x in open(f"{path}/{f}", encoding="utf-8").read().splitlines())


def test_json_folders(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"root_cause": [], "reasoning": null}')
    (tmp_path / "a.json").write_text('{"instance_id": "z",\n "reasoning": "why"}\n')
    (tmp_path / "c.json").write_text("no json")
    docs = readers.json_documents(spark, str(tmp_path))
    assert [(r["instance_id"], r["stem"]) for r in docs.select("instance_id", "stem").collect()] == [("z", "a"), ("b", "b"), ("c", "c")]
    assert sorted(map(tuple, readers.reasoning(docs).collect())) == [("b", ""), ("c", ""), ("z", "why")]
    assert readers.json_documents(spark, str(tmp_path / "none")).count() == 0
    assert readers.locations(docs).count() == 0


def test_tables_and_lists(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('\ufeffid,text\n1,"two\nlines ""q"""\n2,\n'.encode())
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'two\nlines "q"'), ("2", None)]
    (tmp_path / "ids.txt").write_text(" b \n\na\nb\n")
    assert [r[0] for r in readers.plain_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["b", "a", "b"]
    (tmp_path / "long.txt").write_text("2 o__b-3\n1 o__a-1\n")
    assert [r[0] for r in readers.id_list(spark, str(tmp_path / "long.txt")).collect()] == ["a-1", "b-3"]


def test_junit_reports(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        """<testsuites><testsuite><!-- <testcase name="no"/> --><testcase classname="m.T" name="a &gt; &quot;b&quot;" file="m.py" time="1"/>
        <testcase name="c"><system-out>x</system-out><skipped message="xfail &lt;x&gt;"/><failure message="later"/></testcase>
        <testcase name="d"><error message="e1">trace</error><skipped message="s"/></testcase><testcase name="e"><failure>only text</failure></testcase></testsuite></testsuites>"""
    )
    rows = readers.junit_cases(spark, str(tmp_path / "r.xml")).orderBy("pos").collect()
    assert [(r["pos"], r["classname"], r["name"], r["file"], r["decisive"], r["message"]) for r in rows] == [
        (0, "m.T", 'a > "b"', "m.py", None, None),
        (1, None, "c", None, "skipped", "xfail <x>"),
        (2, None, "d", None, "error", "e1"),
        (3, None, "e", None, "failure", None),
    ]
    cases = readers.junit_cases(spark, str(tmp_path / "r.xml")).select(F.lit(1).alias("run"), "pos", results.categorize(F.col("decisive"), F.col("message")).alias("bucket"), results.node_id(F.col("classname"), F.col("file"), F.col("name")).alias("node"))
    buckets = results.test_buckets(cases).first()
    assert (buckets["passed"], buckets["failed"], buckets["skipped"], buckets["xfailed"]) == (['m.T::a > "b"'.replace("m.T", "m.py::T")], ["d", "e"], [], ["c"])
    assert [(r["bucket"], r["pos"], r["node"]) for r in results.in_buckets(cases).filter("bucket = 'failed'").orderBy("pos").collect()] == [("failed", 0, "d"), ("failed", 1, "e")]


def test_run_folders(spark, tmp_path):
    for model, instance, k, text in (("m1", "i1", "b", '{"o__i1": {"resolved": true}, "x": {"resolved": false}}'), ("m1", "i1", "c", '{"o__i1": {"resolved": false}}'), ("m1", "i2", "a", '{"o__i2": {}}'), ("m2", "i1", "a", '{"o": {"resolved": false}}')):
        folder = tmp_path / model / instance / "logs" / "run_evaluation" / k
        folder.mkdir(parents=True)
        (folder / "report.json").write_text(text)
    found = sorted(map(tuple, readers.run_reports(spark, str(tmp_path)).select("model", "instance", "resolved").collect()))
    assert found == [("m1", "i1", True), ("m1", "i2", False), ("m2", "i1", False)]
    run = tmp_path / "m1" / "i1"
    (run / "b.traj.json").write_text('{"messages": [{"role": "user"}, {"role": "exit", "extra": {"exit_status": "one"}}, {"role": "exit", "extra": {}}]}')
    (run / "c.traj.json").write_text('{"messages": [{"role": "exit", "extra": {"exit_status": "other"}}]}')
    messages = readers.exit_messages(spark, str(tmp_path))
    assert sorted((r["pos"], r["role"], r["exit_status"]) for r in messages.collect()) == [(0, "user", None), (1, "exit", "one"), (2, "exit", None)]
    runs = spark.createDataFrame([("m1", "i1", True, True), ("m1", "i2", True, False), ("m1", "i3", False, False), ("m1", "i4", True, True)], "model string, instance string, has_dir boolean, has_trajectory boolean")
    own = messages.select(F.lit("m1").alias("model"), F.lit("i1").alias("instance"), "pos", "role", "exit_status")
    status = results.exit_of(runs, own)
    assert sorted((r["instance"], r["status"]) for r in status.collect()) == [("i1", "unknown"), ("i2", "no_trajectory"), ("i3", "no_instance_dir"), ("i4", "no_exit_message")]
    assert json.loads(results.missing_reports(status).first()["missing"]) == {"i1": "unknown", "i2": "no_trajectory", "i3": "no_instance_dir", "i4": "no_exit_message"}
    pivot = results.ordered_pivot(status.unionByName(status.filter("status = 'unknown'")), "model", "status", "m")
    assert pivot.columns[:2] == ["model", "unknown"] and tuple(pivot.first())[:2] == ("1", "2")
    (run / "exit_statuses_1.yaml").write_text("instances_by_exit_status:\n  Submitted:\n  - 'a-1'\n  - b-2\n  LimitsExceeded:\n  - c-3\n")
    assert sorted(map(tuple, readers.exit_statuses(spark, str(tmp_path)).collect())) == [("LimitsExceeded", "c-3"), ("Submitted", "a-1"), ("Submitted", "b-2")]
    patches = tmp_path / "spts" / "x__y-1"
    patches.mkdir(parents=True)
    for name in ("1.patch", "13_unverified.patch", "note.patch"):
        (patches / name).write_text("x")
    assert sorted(map(tuple, readers.variant_catalog(spark, str(tmp_path / "spts")).collect())) == [("x__y-1", 1, True), ("x__y-1", 13, False)]


def test_sinks_write_what_they_got(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, g string, v int")
    at = lambda n: str(tmp_path / n)
    sinks.nested_json(df, at("nested"), "k", "g")
    assert [json.loads(x) for x in lines(at("nested"))] == [{"k": "a", "rows": [{"g": "x", "rows": [{"v": 1}]}, {"g": "y", "rows": [{"v": 2}]}]}, {"k": "b", "rows": [{"g": "x", "rows": [{"v": 3}]}]}]
    sinks.per_key_json(df, at("keys"), "k")
    assert [json.loads(x) for x in lines(at("keys") + "/k=b")] == [{"g": "x", "v": 3}]
    sinks.csv_with_header(df.coalesce(1), at("csv"))
    assert lines(at("csv")) == ["a,x,1", "a,y,2", "b,x,3", "k,g,v"]
    sinks.buckets(df, at("buckets"), "g")
    assert sorted(r["v"] for r in spark.read.option("header", True).csv(at("buckets") + "/g=x").collect()) == ["1", "3"]
    sinks.grouped_json(df, at("grouped"), "k")
    assert [json.loads(x) for x in lines(at("grouped"))][1] == {"b": [{"g": "x", "v": 3}]}
    ids = spark.createDataFrame([("agreed", "2"), ("agreed", "1"), ("resolved", "3")], "bucket string, id string")
    sinks.id_lists(ids, at("ids"), ["agreed", "conflicts"], ["resolved", "skipped"])
    assert lines(at("ids") + "/bucket=agreed") == ["1", "2"] and lines(at("ids") + "/bucket=conflicts") == [] and lines(at("ids") + "/bucket=resolved") == ["3"]
    sinks.id_lists(ids.filter("bucket = 'agreed'"), at("ids"), ["agreed", "conflicts"], ["resolved", "skipped"])
    assert not os.path.exists(at("ids") + "/bucket=resolved") and os.path.exists(at("ids") + "/bucket=conflicts")
    sinks.changes(df, at("changes"))
    with pytest.raises(Exception):
        sinks.changes(df, at("changes"))
    text = sinks.markdown_report("Report", df.select("v", "g"), "g", {"x": "Ex", "z": "Zet"}, metrics=df.groupBy("k").count().orderBy("k"))
    assert text.split("\n")[:5] == ["# Report", "", "- considered: **3**", "- x: **2**", "- y: **1**"]
    assert "## Ex (2)" in text and "Zet" not in text and "| a | 2 |" in text


def test_a_report_too_long_for_reading_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_LINES", 2)
    assert sinks.markdown(spark.range(2)).count("\n") == 3
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(3))

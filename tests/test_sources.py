"""JUnit reports as the XML parser sees them, and reports that change as a whole."""

import io
import json
import os
import tracemalloc
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from accordant.operators import results
from accordant.sources import committed, junit

REPORT = """<?xml version="1.0" encoding="utf-8"?>
<!-- <testcase classname="no" name="comment"><failure/></testcase> -->
<testsuites><testsuite name="s &lt;failure">
<testcase classname="a.B" name="passes" file="a.py"><system-out><![CDATA[<failure message="quoted"/> </testcase>]]></system-out></testcase>
<testcase classname="a" name="xfail" file="a.py"><properties><error/></properties><skipped message="expected test failure &amp; more"/><failure/></testcase>
<testcase classname='a' name='fails'><!-- <skipped/> --><failure message='"x" &#233;'>text <![CDATA[<skipped/>]]></failure><skipped message="later"/></testcase>
<testcase name="bare"/>
<testcase name="outer"><testcase name="inner"><error/></testcase><skipped/></testcase>
</testsuite></testsuites>"""


def plain(text):
    """Direct children, by the tree of the whole report."""
    out = []
    for _, e in ElementTree.iterparse(io.BytesIO(text.encode()), events=("end",)):
        if e.tag == "testcase":
            first = next((c for c in e if c.tag in junit.DECISIVE), None)
            out.append((e.get("classname"), e.get("name"), e.get("file"), None if first is None else first.tag, None if first is None else first.get("message")))
    return out


def test_direct_children_decide():
    assert list(junit.cases(io.BytesIO(REPORT.encode()))) == plain(REPORT)
    own = REPORT.replace("<testsuites>", '<testsuites xmlns="urn:x">')
    assert list(junit.cases(io.BytesIO(own.encode()))) == plain(own) == []


def test_reports_are_partitions(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"r{k}.xml").write_text(REPORT)
    (tmp_path / "other.txt").write_text("no report")
    for reach in (True, False):
        monkeypatch.setattr(junit, "reachable", lambda path: reach)
        found = junit.junit_cases(spark, f"file://{tmp_path}")
        rows = found.orderBy("file_path", "pos").collect()
        assert [tuple(r)[2:] for r in rows] == plain(REPORT) * 3
        assert [r["pos"] for r in rows[:6]] == list(range(6)) and rows[0]["file_path"].endswith("r0.xml")
    bucket = found.select(results.categorize(F.col("decisive"), F.col("message")).alias("b")).groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in bucket} == {"passed": 6, "xfailed": 3, "failed": 6, "skipped": 3}


def test_a_broken_report_is_named(spark, tmp_path):
    (tmp_path / "bad.xml").write_text(REPORT[:300])
    with pytest.raises(Exception, match="bad.xml"):
        junit.junit_cases(spark, f"file://{tmp_path}").count()


class Endless(io.RawIOBase):
    """A report of n test cases that is never in memory."""

    def __init__(self, n):
        self.n, self.at = n, -1

    def read(self, size=-1):
        self.at += 1
        if self.at == 0:
            return b"<testsuite>"
        if self.at <= self.n:
            return b'<testcase name="t"><system-out>' + b"x" * 60_000 + b"</system-out></testcase>"
        return b"</testsuite>" if self.at == self.n + 1 else b""


def test_memory_stays_constant():
    tracemalloc.start()
    assert sum(1 for _ in junit.cases(Endless(3000))) == 3000  # 180 MB
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def lists_of(spark, path):
    sizes, rows = committed.read_report(spark, path)
    out = {name: [] for name in sizes}
    for r in rows.orderBy("list", "pos").collect():
        out[r["list"]].append(r["value"])
    assert {k: len(v) for k, v in out.items()} == sizes
    return out


def test_lists_are_sorted_and_change_together(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    ids = [("agreed", f"i{k * 7919 % 5000:05d}") for k in range(5000)] + [("resolved", "b"), ("resolved", "a")]
    committed.write_report(spark.createDataFrame(ids, "list string, value string").repartition(5), path, ["agreed", "conflicts"])
    found = lists_of(spark, path)
    assert found == {"agreed": sorted(v for b, v in ids if b == "agreed"), "resolved": ["a", "b"], "conflicts": []}
    committed.write_report(spark.createDataFrame([("conflicts", "z")], "list string, value string"), path, ["agreed", "conflicts"])
    assert lists_of(spark, path) == {"agreed": [], "conflicts": ["z"]}
    assert len([x for x in os.listdir(tmp_path / "report") if x.startswith("run-")]) == 1
    committed.write_report(spark.createDataFrame([], "list string, value string"), path, ["agreed"])
    assert lists_of(spark, path) == {"agreed": []}


def test_a_failed_run_leaves_the_old_report_whole(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    good = spark.createDataFrame([("agreed", "a"), ("resolved", "b")], "list string, value string")
    committed.write_report(good, path, ["agreed"])
    before = lists_of(spark, path)
    bad = spark.range(200).selectExpr("'agreed' AS list", "CASE WHEN id = 150 THEN raise_error('stop') ELSE cast(id AS string) END AS value")
    with pytest.raises(Exception, match="stop"):
        committed.write_report(bad, path, ["agreed"])
    assert lists_of(spark, path) == before
    assert len(os.listdir(tmp_path / "report")) == 2  # the manifest and the run that holds


def test_jury_files(spark, tmp_path):
    path = f"file://{tmp_path}/jury"
    requests = results.request_grid(spark.createDataFrame([("i1",), ("i2",)], "instance string"), ["p"])
    verdicts = requests.selectExpr("cid", "CASE WHEN ordering = 0 THEN 'aligned' END AS label", "CASE WHEN ordering = 1 THEN 'timeout' END AS error")
    committed.jury_files(requests, verdicts, path)
    found = {k: [json.loads(x) for x in v] for k, v in lists_of(spark, path).items()}
    assert [r["cid"] for r in found["manifest"]] == ["c0", "c1", "c2", "c3"]
    assert found["manifest"][2] == {"cid": "c2", "instance": "i2", "ordering": 0, "provider": "p"}
    assert found["raw"][1] == {"cid": "c1", "label": None, "error": "timeout"}

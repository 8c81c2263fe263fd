"""Queries that do the whole job beside ones whose SQL cuts it."""

import os

from pyspark.sql import functions as F

from accordant.operators import results
from accordant.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_whole_pages_are_normalised(spark):
    html = {r["page_id"]: r["html"] for r in queries.table(spark, SF, "pages").collect()}
    loose = {r["page_id"]: r["loose"] for r in queries.QUERIES["f1_text_normalize_whole"](spark, SF).collect()}
    assert loose.keys() == html.keys()
    kept = lambda x: "".join(c for c in x if c > " ").rstrip(",:;")
    assert {k: kept(v) for k, v in loose.items()} == {k: kept(v) for k, v in html.items()}
    assert max(map(len, loose.values())) > 300


def test_every_day_is_a_run_and_order_counts(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", 7, "view"), (2, "2024-01-01 02:00:00", 8, "view"), (3, "2024-01-02 01:00:00", 7, "view"), (4, "2024-01-02 02:00:00", 8, "view")]
    rows += [(5, "2024-01-05 01:00:00", 8, "view"), (6, "2024-01-05 02:00:00", 7, "view")]  # the same two, the other way round
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES["x6_run_equality_all_days"](spark, str(tmp_path)).collect()
    assert sorted((str(r["run"]), r["pos"], r["user_id"], r["only_a"], r["only_b"]) for r in found) == [("2024-01-05", 1, 7, 1, 0), ("2024-01-05", 1, 8, 0, 1), ("2024-01-05", 2, 7, 0, 1), ("2024-01-05", 2, 8, 1, 0)]


def test_every_model_reaches_the_matrix(spark):
    d = queries.table(spark, SF, "documents")
    cells = {(r["instance"], r["model"]) for r in queries.QUERIES["k10_result_matrix_all_models"](spark, SF).collect()}
    assert cells == {(i[0], m[0]) for i in d.select("lang").distinct().collect() for m in d.select("source").distinct().collect()}
    assert len({m for _, m in cells}) > 2

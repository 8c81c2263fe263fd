"""What a run gives up, and columns whose names clash with the operators' own."""

import pytest

import corpus_pipeline
from accordant.llm import queries
from accordant.llm.common import materialise, scratch, share


def test_only_what_a_run_wrote_and_shared_is_given_up(spark):
    rows = spark.range(5)
    outside, held = materialise(rows, "outside"), share(spark, [1])
    with scratch(spark) as own:
        inside = materialise(rows, "inside")
        share(spark, [2])
        assert inside.count() == 5 and (len(own.written), len(own.shared)) == (1, 1)
        with scratch(spark) as inner:
            materialise(rows, "inner")
        assert len(inner.written) == 1 and inside.count() == 5
    assert outside.count() == 5 and held.value == [1]
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        inside.count()


def test_results_made_before_the_pipeline_stay_readable(spark, sf):
    first, second = queries.op10_exact_dedup(spark, sf), queries.op8_toxicity(spark, sf)
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert first.count() == second.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.fixture(scope="module")
def clashing(spark, sf, tmp_path_factory):
    """The tables with columns in documents that carry the operators' own names."""
    folder = tmp_path_factory.mktemp("clash")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for c in ("_id", "_grade", "_label", "_doc", "_row", "_h", "_bucket", "_place", "slot", "id", "ids", "item", "slice", "pair"):
        docs = docs.selectExpr("*", f"doc_id AS {c}")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"file://{folder}/{t}.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("name", ["op6_quality_classifier", "op8_toxicity", "op11_token_alignment", "op12_lexical_search", "op13_external_shuffle", "pipeline"])
def test_clashing_columns_change_nothing(spark, sf, clashing, name):
    run = corpus_pipeline.run if name == "pipeline" else queries.queries()[name]
    names = [c for c in run(spark, sf).columns if c not in ("shard", "slot")]
    rows = [sorted(map(tuple, run(spark, at).select(names).collect()), key=str) for at in (sf, clashing)]
    assert rows[0] == rows[1]

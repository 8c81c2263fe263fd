"""Nulls, empty tables, repeated rows and columns with clashing names."""

import pytest

from accordant.llm import bpe, decontam, exact_dedup, line_dedup, pii, quality, queries, toxicity

SCHEMA = "doc_id long, text string, id string, row int, digest string, h int"
ROWS = [(1, None, "a", 1, "x", 1), (2, "", "a", 1, "x", 1), (None, "one two", "a", 1, "x", 1), (3, "one two", "a", 1, None, 1), (3, "one two", "a", 1, None, 1), (4, "z" * 50_000, None, 1, "x", 1)]
BENCHMARK = "item_id long, text string"
RUNS = {
    "lines": lambda d, b: line_dedup.dedup_lines(d, 2),
    "pii": lambda d, b: pii.find(d),
    "quality": lambda d, b: quality.grade(d, quality.fit(["good text here"] * 9 + ["!!!! ****"] * 9, [1] * 9 + [0] * 9)),
    "unfitted quality": lambda d, b: quality.grade(d, quality.fit([], [])),
    "toxicity": lambda d, b: toxicity.score(d, toxicity.fit(["you idiot there"] * 40 + ["a calm day out"] * 80, [1] * 40 + [0] * 80)),
    "unfitted toxicity": lambda d, b: toxicity.score(d, toxicity.fit([], [])),
    "decontamination": lambda d, b: decontam.search(d, b),
    "tokens": lambda d, b: bpe.encode(d, queries.tokenizer_file()),
    "copies": lambda d, b: exact_dedup.groups(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_gets_a_result(spark, name):
    docs, items = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([(1, None), (None, "one two")], BENCHMARK)
    assert RUNS[name](docs, items).count() == len(ROWS)
    assert RUNS[name](docs.limit(0), items.limit(0)).count() == 0


def test_one_of_equal_rows_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]

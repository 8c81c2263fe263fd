"""Ranked search against a plain ranking: ties, nulls, repeated rows, shards, blocks."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from accordant.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """The contract, item by item and document by document."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


WORDS = "alpha beta Gamma delta épée 日本 x1 42 the THE of".split()
DOCS = [(i, " ".join(WORDS[(i * j) % 11] for j in range(1, i % 9 + 2)) + ". " + "tie" * (i % 2)) for i in range(300)]
DOCS += [(None, "alpha tie"), (5, "alpha; beta"), (5, "alpha; beta"), (900, None), (901, ""), (902, "!!! ..."), (903, "alpha " * 20_000)]
ITEMS = [(1, "Alpha, beta!"), (2, None), (3, "nothing here"), (1, "Alpha, beta!"), (None, "tie tie the"), (4, ""), (5, "épée 日本 42")]


def found(spark, docs, items, k, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS item").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS item")
    out = search.search(*search.build(d), b, k)
    return sorted((tuple(r) for r in out.select("item_id", "rank", "id", "score").collect()), key=str)


@pytest.mark.parametrize("shard,k", [(4 << 20, 5), (700, 50), (64, 3)])
def test_equals_plain_ranking(spark, monkeypatch, shard, k):
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    assert found(spark, DOCS, ITEMS, k) == plain(DOCS, ITEMS, k)


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEM_BYTES", 40)
    assert found(spark, DOCS, ITEMS, 7) == plain(DOCS, ITEMS, 7)


def test_empty_tables_and_string_ids(spark):
    assert found(spark, [], ITEMS, 5) == [] == found(spark, DOCS, [], 5)
    d = spark.createDataFrame([("b", "one two"), ("a", "one two")], "doc_id string, text string")
    out = search.search(*search.build(d), spark.createDataFrame([("q", "one")], "item_id string, text string"), 1)
    assert [tuple(r)[:3] for r in out.collect()] in ([], [("q", 1, "a")])


def test_selection_is_exact_on_ties():
    import numpy as np

    score, ids = np.array([0, 5, 5, 7, 5, 0, 5]), pa.array([0, 9, 3, 4, None, 1, 2])
    assert [ids[int(i)].as_py() for i in search.best(score, ids, 3)] == [4, 2, 3]
    assert sorted(search.best(score, ids, 9).tolist()) == [1, 2, 3, 4, 6]

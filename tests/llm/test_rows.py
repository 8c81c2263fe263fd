"""Components over many tasks, which rows stay, clashing columns, and held-out quality."""

import random
import zlib

import numpy as np
import pytest

from accordant.llm import common, exact_dedup, ngram_join, quality, queries


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES_PER_TASK", 40)
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1150)] + [(5, 5), (-3, 1100)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    found = common.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["root"] for r in found} == root and len(found) == len(root)


ROWS = [(1, "a b c d e f g h i j", 1), (1, "a b c d e f g h i j", 1), (1, "z y x w v u t s r q p", 2), (0, "z y x w v u t s r q p", 3), (None, "m n o p q r", 4), (None, None, 5), (None, None, 5), (9, "", 6)]
CLASH = "doc_id long, text string, _tail int"


def test_one_row_of_a_component_stays(spark):
    df = spark.createDataFrame(ROWS, CLASH)
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [ROWS[0], ROWS[3], ROWS[4], ROWS[5], ROWS[6], ROWS[7]]))


@pytest.mark.parametrize("words", [1 << 17, 1])
def test_exact_copies_with_ties_and_clashing_names(spark, monkeypatch, words):
    """Also with a bitmap so small that most rows have to meet their marks."""
    monkeypatch.setattr(common, "MAP_WORDS", words)
    rng = random.Random(6)
    texts = ["", None, "a b", "ab", "a  b ", "é", "x" * 9000] + [f"t{k}" for k in range(40)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), k if k % 3 else 0, k % 2) for k in range(300)]
    rows += [(3, "same", 1, 1)] * 5 + [(k, "hot copy", 0, 0) for k in range(1000, 1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest int, _h int").repartition(7)
    key = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    best = {}
    for i, t, *_ in rows:
        best[key(t)] = min(best.get(key(t), (1, True, 0)), (-len(t or ""), i is None, i or 0))
    size = {k: sum(key(r[1]) == k for r in rows) for k in best}
    found = exact_dedup.groups(df).collect()
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == len(best)
    assert sorted(str((r["keep_id"], r["group_size"])) for r in found) == sorted(str((None if best[key(t)][1] else best[key(t)][2], size[key(t)])) for _, t, *_ in rows)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    kept = [tuple(r) for r in out.collect()]
    assert sorted(str((-len(t or ""), i is None, i or 0)) for i, t, *_ in kept) == sorted(map(str, best.values()))
    assert all(r in rows for r in kept)


def test_columns_named_like_results(spark):
    df = spark.createDataFrame(ROWS, CLASH)
    model = quality.fit(["good text here"] * 9 + ["!!!! ****"] * 9, [1] * 9 + [0] * 9)
    kept = quality.select(df, model, threshold=0.0)
    assert kept.columns == df.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, ROWS))
    assert quality.grade(df, model).columns == ["doc_id", "text", "_expected_grade", "_tail"]


def test_gradient_and_order_of_the_ordinal_model():
    """At the fit, moving a threshold makes no difference to the likelihood worth naming, and thresholds rise."""
    rng = random.Random(4)
    vocabulary = {0: "zz!! qq?? ##", 1: "calm word day", 2: "good fine clear"}
    grades = [rng.randrange(3) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary[rng.choice([g, g, (g + 1) % 3])].split()) for _ in range(12)) for g in grades]
    model = quality.fit(texts, grades)
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts])

    def likelihood(thresholds):
        tail = 1 / (1 + np.exp(-(scores[:, None] - thresholds[None, :])))
        full = np.concatenate([np.ones((len(scores), 1)), tail, np.zeros((len(scores), 1))], 1)
        rows = np.arange(len(scores))
        return np.log(full[rows, grades] - full[rows, np.array(grades) + 1]).mean()

    at = likelihood(model.thresholds)
    for k in range(2):
        for step in (0.4, -0.4):
            moved = model.thresholds.copy()
            moved[k] += step
            if np.diff(moved)[0] > 0:
                assert likelihood(moved) < at + 0.01


def test_quality_on_held_out_labels(spark):
    """Fitted on two thirds of the labels, judged on the rest."""
    big = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.fit(*quality.rated_sample(documents, labels.filter("pmod(crc32(cast(doc_id AS string)), 3) <> 1"), queries.grade()))
    own = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    rows = [r for r in quality.grade(documents, model).select("doc_id", "_tail").collect() if own.get(r["doc_id"]) is not None]
    low, good = ([r["_tail"] for r in rows if own[r["doc_id"]] == k] for k in (0, 1))
    assert len(low) > 100 and sum(t < 0.5 for t in low) > 0.95 * len(low)
    assert sum(t >= 0.5 for t in good) > 0.98 * len(good)

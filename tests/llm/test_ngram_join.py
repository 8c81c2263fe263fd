import random

import numpy as np

from accordant.llm import ngram_join

SCHEMA = "doc_id long, text string, size int, class string"


def brute(rows, k, percent):
    """(doc_id, n_shingles, component) by comparing every pair."""
    sets, ids = [], [r[0] for r in rows]
    for _, text, *_ in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = part[i], part[j]
                part = [a if p == b else p for p in part]
    low = {}
    for i, p in zip(ids, part):
        low[p] = min(low.get(p, i), i, key=lambda v: (v is None, v or 0))
    return sorted(((i, len(s), low[p] if s else i) for i, s, p in zip(ids, sets, part)), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 20, 60, 150]))]
            if kind > 0.8:
                words += common
        rows.append((i, " ".join(words), 7, "x"))
    return rows


def test_matches_brute_force(spark, monkeypatch):
    for seed, percent, k in ((1, 85, 4), (2, 80, 5)):
        rows = corpus(seed, 160)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert collected(ngram_join.similar(df, k, percent)) == brute(rows, k, percent)


def test_long_lists_and_blocks_give_the_same(spark, monkeypatch):
    rows = corpus(3, 140)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", 400)
    assert collected(ngram_join.similar(df, 4, 85)) == brute(rows, 4, 85)


def test_edge_cases(spark):
    rows = [(1, None, 1, "a"), (2, "", 1, "a"), (3, "A b\tc", 1, "a"), (4, "a B c", 1, "a"), (None, "a b c", 1, "a"), (5, "x " * 3000, 1, "a"), (5, "x " * 3000, 1, "a"), (6, "y" * 100000, 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(ngram_join.similar(df, 4, 85)) == brute(rows, 4, 85)
    assert ngram_join.similar(df.limit(0), 4, 85).count() == 0
    assert ngram_join.similar(df.filter("text IS NULL OR text = ''"), 4, 85).count() == 2


def test_keep_one_keeps_the_columns(spark):
    rows = [(1, "a b c d e f", 1, "p"), (2, "a b c d e f", 2, "q"), (3, None, 3, "r"), (4, "", 4, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns and sorted(r[0] for r in out.collect()) == [1, 3, 4]


def test_links_finds_exactly_the_similar_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - i], rng.integers(0, 1 << 60, i, dtype=np.uint64)])) for i in range(0, 40, 3)]
    src, dst = ngram_join.links(np.arange(len(sets)), sets, 85)
    for a, b in zip(src, dst):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)

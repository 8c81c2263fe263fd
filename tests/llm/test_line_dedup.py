"""The perfect hash as written arrays, and lines against brute force."""

import random

import numpy as np

from accordant.llm import line_dedup


def test_the_hash_is_minimal_and_survives_writing():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(2))
    docs = rng.integers(1, 9, 20_000)
    index = line_dedup.LineIndex.of(np.concatenate([high, high[:500]]), np.concatenate([low, low[:500]]), np.concatenate([docs, docs[:500]]))
    assert sorted(index.hash.slots(high, low)) == list(range(20_000))
    read = line_dedup.LineIndex.read(**index.arrays())
    want = docs.copy()
    want[:500] *= 2
    assert (read.documents(high, low) == want).all()
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert (read.documents(other, other) > 0).mean() < 1e-3
    empty = line_dedup.LineIndex.read(**line_dedup.LineIndex.of(high[:0], low[:0], docs[:0]).arrays())
    assert (empty.documents(high, low) == 0).all()


def test_counts_come_from_the_hash_alone(spark, monkeypatch):
    """With a hash that leads to other slots nothing is found, as shards keep no keys."""
    docs = spark.createDataFrame([(k, "same line\nline " + str(k)) for k in range(30)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(docs, 10).collect()} == {1}
    slots = line_dedup.PerfectHash.slots
    monkeypatch.setattr(line_dedup.PerfectHash, "slots", lambda self, h, l: np.roll(slots(self, h, l), 1) * 0 - 1 if len(h) else slots(self, h, l))
    index = line_dedup.LineIndex.of(np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64), np.full(5, 10))
    assert (line_dedup.LineIndex.read(**index.arrays()).documents(np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64)) == 0).all()


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["a line", "  A Line\t", "", "x", "unique", "日本語 の 行", "\x0b"]
    rows = [(rng.choice([None, k]), "\n".join(rng.choice(pool + [f"own {rng.randrange(60)}"]) for _ in range(rng.randint(1, 9))) if rng.random() > 0.05 else None) for k in range(200)]
    rows += rows[:20] + [(900, "z" * 200_000)]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    for least, chars in ((10, 1), (3, 4)):
        gone = {k for k, n in seen.items() if n >= least and len(k) >= chars}
        want = []
        for i, t in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if key(x) not in gone]
            want.append(str((i, len(lines), len(lines) - len(kept), "\n".join(kept))))
        found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), least, chars).collect()
        assert sorted(want) == sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])) for r in found)

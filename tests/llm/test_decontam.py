"""Matches against brute force, a benchmark in many parts, and longest matches with their places."""

import random
import re

import pytest

from accordant.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    """(id, words, hit words, items, longest) of each document."""
    out = []
    for i, text, *_ in docs:
        w = words(text)
        hit, found, longest = set(), set(), 0
        for item, body in items:
            b = words(body)
            n = min(window, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            places = [k for k in range(len(w) - n + 1) if n and tuple(w[k : k + n]) in grams]
            for k in places:
                hit.update(range(k, k + n))
            if places:
                found.add(item)
                for a in range(len(w)):  # verbatim stretches that hold a window
                    for z in range(len(b)):
                        m = 0
                        while a + m < len(w) and z + m < len(b) and w[a + m] == b[z + m]:
                            m += 1
                        longest = max(longest, m if m >= n else 0)
        out.append(str((i, len(w), len(hit), sorted(found - {None}), longest or None)))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)] + ["Ärger", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([0, 2, 6, 12, 20]))) for k in range(40)] + [(3, "one two three four"), (3, "five six seven eight"), (None, "null item text here now")]
    docs = []
    for k in range(60):
        body = text(rng.randint(0, 30)).split()
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(own) + 1)
            body[rng.randrange(len(body) + 1) : 0] = own[a:]
            body += own
        docs.append((k, "  ".join(body), 1, "x"))
    return docs + [(None, None, 1, "x"), (7, "", 1, "x"), docs[0], docs[1]], items


def found(spark, docs, items, window):
    rows = decontam.search(spark.createDataFrame(docs, "doc_id long, text string, _hits int, _row string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window)
    assert rows.columns.count("_hits") == 1 and "_row" in rows.columns
    return sorted(str((r["doc_id"], r["_n_words"], r["n"], r["_items"] or [], r["_longest"])) for r in rows.withColumn("n", decontam.hit_words(rows["_hits"])).collect())


@pytest.mark.parametrize("part_bytes", [decontam.PART_BYTES, 60])
def test_search_against_brute_force(spark, monkeypatch, part_bytes):
    """In one part, and in some forty that are searched one after the other."""
    docs, items = corpus()
    monkeypatch.setattr(decontam, "PART_BYTES", part_bytes)
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_remove_keeps_columns_and_clean_rows(spark, monkeypatch):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, _hits int, _row string"), spark.createDataFrame(items, "item_id string, text string")
    clean = sorted(str(d) for d in docs if eval(brute([d], items, 5)[0])[2] == 0)
    for size in (decontam.PART_BYTES, 300):
        monkeypatch.setattr(decontam, "PART_BYTES", size)
        out = decontam.remove(df, bench, 5)
        assert out.columns == df.columns
        assert sorted(str(tuple(r)) for r in out.collect()) == clean
    assert decontam.remove(df, bench.limit(0), 5).count() == len(docs)

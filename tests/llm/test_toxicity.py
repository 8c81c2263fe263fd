"""Scores against a plain scorer, one document and one window at a time; both dictionaries come from the trainer."""

import math
import random
import re

import zstandard

from accordant.llm import toxicity

BAD = ["idiot", "moron", "worthless", "scum"]


def corpus(seed, n, toxic_share=0.3):
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        bad = rng.random() < toxic_share
        for _ in range(len(words) // 12 + 1 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD).title()
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def plain_score(model, text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", lower)]
    windows = []
    for i in range(0, len(spans), toxicity.WINDOW):
        own = spans[i : i + toxicity.WINDOW]
        raw = lower[own[0][0] : own[-1][1]].encode()
        windows += [raw[k : k + toxicity.WINDOW_BYTES] for k in range(0, len(raw), toxicity.WINDOW_BYTES)]
    setting = zstandard.ZstdCompressionParameters(**toxicity._SETTING)

    def length(content, raw):
        return len(zstandard.ZstdCompressor(compression_params=setting, dict_data=zstandard.ZstdCompressionDict(content)).compress(raw))

    saved = [length(model.ordinary + b"\xff" * len(model.toxic), w) - length(model.ordinary + model.toxic, w) for w in windows]
    x = [1.0, math.log1p(len(saved)), *(math.log1p(sum(s >= level for s in saved)) for level in toxicity.LEVELS)]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.curve)))))), max([0, *saved])


def test_scores_are_the_plain_ones(spark):
    model = toxicity.fit(*corpus(1, 400))
    assert isinstance(model, toxicity.Model)
    texts = corpus(2, 60)[0] + ["", None, "   \n", "x" * 5000, "é" * 3000 + " idiot", "\x0bidiot\x1c moron"]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), model).collect()
    want = sorted((str(i), round(s, 9), m) for (i, t) in rows for s, m in [plain_score(model, t)])
    assert sorted((str(r["doc_id"]), round(r["score"], 9), r["most_saved"]) for r in found) == want


def test_both_dictionaries_are_trained_and_tell_unseen_documents_apart():
    model = toxicity.fit(*corpus(3, 900))
    magic = bytes.fromhex("37a430ec")  # how a trained dictionary begins: a fixed value of the format
    assert model.ordinary.startswith(magic) and model.toxic.startswith(magic)
    assert all(b.encode() in model.toxic for b in BAD)
    texts, labels = corpus(4, 300)
    scores = [plain_score(model, t)[0] for t in texts]
    hit = sum(s >= 0.7 for s, y in zip(scores, labels) if y) / sum(labels)
    wrong = sum(s >= 0.7 for s, y in zip(scores, labels) if not y)
    assert hit > 0.9 and wrong <= 3


def test_telling_words_come_from_toxic_text_alone():
    toxic = [f"good day you idiot number {k}".encode() for k in range(40)]
    ordinary = [f"good day you there number {k}".encode() for k in range(80)]
    assert set(toxicity.telling(toxic, ordinary)) == {b" idiot "}
    assert toxicity.telling([], ordinary) == [] and toxicity.telling(ordinary, ordinary) == []

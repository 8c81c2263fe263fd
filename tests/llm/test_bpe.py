"""Ids from chunks and repaired joins are the library's, whatever the text and wherever it is cut."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from accordant.llm import bpe, common, queries

PATH = queries.tokenizer_file()
LETTERS = ["a", "b", " ", "  ", "\n", "'", "s", "don't", "word", "Ärger", "日本語", "テキスト", "😀", "👩‍👩‍👧", "1", "23", ".", "...", "\t", " \xa0", "é", "ll", "'ll", "　", "x" * 50, "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    coder = Tokenizer.from_file(PATH)
    coder.no_truncation()
    coder.no_padding()
    return coder


def texts(seed, n, most):
    rng = random.Random(seed)
    return rng, ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_joins_are_repaired_wherever_a_text_is_cut(library):
    coder = bpe.Tokenizer(PATH)
    rng, given = texts(1, 3000, 40)
    changed = 0
    for text in given:
        text = text.replace("<|endoftext|>", "")
        at = sorted({0, len(text), *[rng.randrange(len(text) + 1) for _ in range(rng.randint(0, 6))]})
        parts = [np.array(coder.plain(text[a:z]), np.uint32) for a, z in zip(at, at[1:])]
        joiner = bpe.Joiner(coder)
        for p in parts:
            joiner.add(p)
        want = library.encode(text, add_special_tokens=False).ids
        assert joiner.ids().tolist() == want
        changed += sum(map(len, parts)) != len(want)
    assert changed > 1000  # without repairs these would be wrong


def test_chunks_keep_characters_whole_and_are_bounded():
    raw = np.frombuffer(("語" * 30_000 + "a" * 70_000).encode(), np.uint8)
    at = bpe.cuts(raw, np.array([0, len(raw)]))
    assert at[0] == 0 and (np.diff(np.append(at, len(raw))) <= bpe.LONGEST + 3).all()
    assert all(raw[k] & 0xC0 != 0x80 for k in at)
    assert bpe.cuts(raw[:0], np.array([0, 0])).tolist() == []


@pytest.mark.parametrize("words", [1 << 14, 1])
def test_documents_against_the_library(spark, library, monkeypatch, words):
    """Shared passages, texts without blanks, special tokens, emoji, nulls; also with a bitmap that is full."""
    monkeypatch.setattr(common, "FEW_WORDS", words)
    monkeypatch.setattr(common, "MOST_WORDS", words)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 4000)
    _, given = texts(2, 60, 400)
    passage = "".join(texts(3, 4, 900)[1])
    given += [passage, given[0] + passage, passage + given[1], "x" + passage + passage, "日本語" * 4000, "y" * 40_000, "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "", None]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(given)] * 2
    found = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, b"".join(x.to_bytes(4, "little") for x in ids), library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], bytes(r["ids"]), r["decoded"])) for r in found)


def test_a_shared_chunk_is_encoded_once(spark):
    """What the tasks send of a passage that 40 documents share is one row a chunk after the exchange."""
    passage = " ".join(f"word{k}" for k in range(3000))
    docs = spark.createDataFrame([(k, f"own {k} " + passage) for k in range(40)], "doc_id long, text string").repartition(8)
    named = docs.selectExpr("text", "doc_id AS h").mapInArrow(bpe._named(PATH), "h long, high long, low long, size long")
    marks = spark.sparkContext.broadcast(common.bitmap(named.groupBy("high", "low").count().filter("count > 1").selectExpr("high AS h")))
    sent = docs.select("text").mapInArrow(bpe._sent(PATH, marks), "high long, low long, chunk binary").dropDuplicates(["high", "low"])
    n, size = sent.count(), sent.selectExpr("sum(length(chunk))").first()[0]
    assert n > 10 and 0.8 * len(passage) < size <= len(passage)

"""The alignment against byte offsets compared by brute force, with counts over all documents."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from accordant.llm import align, queries

A, B = queries.tokenizer_file(), queries.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    first = Tokenizer.from_file(A)
    first.no_truncation()
    first.no_padding()
    first.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    second = sentencepiece.SentencePieceProcessor(model_file=B)

    def bytes_of(piece):
        return bytes.fromhex(piece[3:5]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    def both(text):
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        return a, [bytes(letters[c] for c in first.id_to_token(i)) for i in a], b, [bytes_of(second.id_to_piece(i)) for i in b]

    return both


def plain(coders, docs):
    """(id, numbers, digest) by the ends of tokens as byte offsets."""
    rows, held = [], Counter()
    for i, text in docs:
        groups = []
        if text:
            a, x, b, y = coders(text)
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ends = [list(itertools.accumulate(map(len, side))) for side in (x, y)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                at = [0, 0]
                for c in cuts:
                    to = [ends[0].index(c, at[0]) + 1, ends[1].index(c, at[1]) + 1]
                    groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                    at = to
        rows.append((i, groups))
        held.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    out = []
    for i, groups in rows:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        best = sum(held[x] == top[x[0]] for x in links)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), best, sum(held[x] for x in links), digest))
    return sorted(out, key=str)


HARD = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n\nc\t "), (5, "▁ stays itself ▁"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"), (7, "日本語のテキスト 🙂🙃 é́"),
    (8, "z" * 3000), (9, "x\xa0y ﬁ \x00 \r\n"), (None, "same text"), (11, "same text"), (11, "same text"), (12, "supercalifragilistic " * 50), (13, "    indented = {'a': 1}\n" * 9),
]


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS slice", "2 AS pair", "3 AS id").repartition(3)
    return sorted(map(tuple, align.align(df, A, B).collect()), key=str)


@pytest.mark.parametrize("size,small", [(2 << 20, 4096), (30, 4096), (2 << 20, 1)])
def test_equals_byte_offsets(spark, coders, monkeypatch, size, small):
    monkeypatch.setattr(align, "SLICE_BYTES", size)
    monkeypatch.setattr(align, "SMALL", small)
    assert found(spark, HARD) == plain(coders, HARD)


def test_query_equals_byte_offsets(spark, coders, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op11_token_alignment(spark, sf)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == plain(coders, docs)


def test_empty_table_and_forgetting(spark, coders, monkeypatch):
    assert found(spark, []) == []
    own = align.Aligner(A, B)
    monkeypatch.setattr(align, "MOST_STATES", 3)
    monkeypatch.setattr(align, "MOST_WORDS", 3)
    texts = [t for _, t in HARD]
    first, again = align.aligned(own, texts), align.aligned(own, texts)
    assert first["digests"] == again["digests"] and first["pairs"].tolist() == again["pairs"].tolist()


def test_words_are_encoded_as_in_their_text(coders):
    own, draw = align.Aligner(A, B), random.Random(3)
    assert own.second.by_words
    parts = ["a", "the", "don't", "'s", "x\n", "\n", "\t", " ", "  ", "\xa0", "\u3000", "\x1c", "\x85", "é", "日本", "1234", "...", "!?", "<s>", "<|endoftext|>", "🙂", "e\u0301", "__", "z" * 60]
    for _ in range(4000):
        text = "".join(draw.choice(parts) + draw.choice(["", " ", " ", "  "]) for _ in range(draw.randrange(1, 12)))
        a, x, b, y = coders(text)
        good = b"".join(x) == b"".join(y) == (" " + text).encode()
        (words,), runs = own.numbers([text]), own.runs
        assert all(runs.good[words]) == good, repr(text)
        if good and text:
            assert runs.totals[:2, words].sum(1).tolist() == [len(a), len(b)]
            said = ";".join(runs.said[w] for w in words).replace(";", "|").split("|")
            assert [",".join(said[::2]), ",".join(said[1::2])] == [",".join(map(str, a)), ",".join(map(str, b))], repr(text)


def test_transducer_follows_either_side():
    own = align.Transducer([b"", b"ab", b"c", b"abc", b"d"], [b"", b"a", b"bcab", b"cd"])
    assert own.ends([3, 1, 2, 4], [1, 2, 3]) == ([2, 4], [2, 3])
    with pytest.raises(ValueError):
        own.ends([4], [1])

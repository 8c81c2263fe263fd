"""Cross-tokenizer alignment by a dangling-suffix transducer, with corpus-wide counts of linked token ids.

1. Two tokenizers encode each text; their tokens spell the same bytes.  The transducer reads the tokens of both sides in
   turn: its state is the side that leads and the bytes by which it leads, and it always reads the side behind.  A
   transition depends on the state and the next token alone, so each worker keeps the ones it has met and follows them
   by lookup.  Where nothing dangles both sides end together and a group closes.
2. Neither tokenizer has a token across a single space between two words, so nothing dangles there: a worker keeps the
   transducer's whole run over a word it has met, with its groups' text and id pairs.  All token occurrences of a group are
   linked.  For a slice of documents (SLICE_BYTES of text) NumPy adds up runs to documents; slices are written to the shared
   folder: a document's totals, and its distinct pairs as numbers into the slice's list of pairs.
3. Spark adds up how many documents hold each pair, and finds the highest count of each first id.
4. Each slice asks once for each of its pairs; pairs that very many slices ask for are sent by a bounded broadcast.  The answers
   meet their slice, and a document's links are weighed by them.

Tokens are A's, the byte-level BPE file's, of a space and the text, and B's, the piece model's, which puts a space
before the text itself.  Strings of special tokens are plain text.  A text that is null or empty, or whose tokens'
bytes differ from the space and the text on either side (the model rewrites some characters), has no tokens: all its
numbers are 0 and its digest is ''.  Repeated rows give a row each and count as a document each.  Columns other than id and text are not
read; an empty table gives an empty result.  A group without an inner boundary may be long: its distinct id pairs, not its
occurrences, are what is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import coder_of
from .common import bounded_batches, materialise, meet
from .kernels import binary_column

#: Bytes of text that a slice of documents holds, about; a longer document is alone.
SLICE_BYTES = 2 << 20
#: States, words and characters of words that a worker keeps, at most, before the next slice; then it starts anew.
MOST_STATES, MOST_WORDS, MOST_CHARS = 200_000, 400_000, 8 << 20
#: Words that the piece model is given at a time.
CALL_WORDS = 64
#: Links of a group whose pairs are written out before they are counted, at most.
SMALL = 4096
#: Pairs that this share of all requests or more ask for are broadcast: at most so many.
OFTEN = 10_000


class Pieces:
    """Ids and token bytes of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [self._bytes(x) for x in names]
        #: Whether no piece goes on behind another character with a space, so that words are encoded one by one.
        self.by_words = not any("▁" in x.lstrip("▁") for x in names)

    def _bytes(self, piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_TOTALS = ["n_a", "n_b", "n_groups", "n_links"]
#: Single spaces between two characters that are no white space.  Neither tokenizer has a token across such a place: A's
#: pattern starts a piece at the space, and B joins none of its pieces over it (`Pieces.by_words`).
_WORDS = re.compile(r"(?<=\S) (?=\S)")


class State:
    """The leading side's dangling bytes, and where each next token of the other side leads."""

    __slots__ = ("reads", "rest", "next")

    def __init__(self, reads: int, rest: bytes):
        self.reads, self.rest, self.next = reads, rest, {}


class Transducer:
    """Closes a group wherever the tokens of both sides end together."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.pieces = (first, second)
        self.begin()

    def begin(self) -> None:
        self.start = State(0, b"")
        self.states = {(0, b""): self.start}

    def _state(self, reads: int, rest: bytes) -> State:
        if not rest:
            return self.start
        held = self.states.get((reads, rest))
        if held is None:
            held = self.states[reads, rest] = State(reads, rest)
        return held

    def _step(self, s: State, token: int) -> State:
        """The state after the side behind has read a token; its bytes must go on as the dangling ones do."""
        own, rest = self.pieces[s.reads][token], s.rest
        if rest.startswith(own):
            to = self._state(s.reads, rest[len(own) :])
        elif own.startswith(rest):
            to = self._state(1 - s.reads, own[len(rest) :])
        else:
            raise ValueError("the sides spell different bytes")
        s.next[token] = to
        return to

    def ends(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """How many tokens of A and of B stand before the end of each group; both sides must spell the same bytes."""
        if len(self.states) > MOST_STATES:
            self.begin()
        start, s, step = self.start, self.start, self._step
        ends, others = [], []
        i = j = 0
        n, m = len(a), len(b)
        while i < n or j < m:
            if s.reads:
                token = b[j]
                j += 1
            else:
                token = a[i]
                i += 1
            s = s.next.get(token) or step(s, token)
            if s is start:
                ends.append(i)
                others.append(j)
        return ends, others


class Runs(NamedTuple):
    """The transducer's runs over words, each from nothing dangling to nothing dangling; a word that a side doesn't spell
    is not good and has none."""

    good: np.ndarray
    totals: np.ndarray  # rows: tokens of A, of B, groups, links
    said: list[str]  # the groups
    wide: np.ndarray  # how many distinct id pairs
    keys: np.ndarray  # the pairs (A << 32 | B), word by word
    times: np.ndarray  # how often each occurs

    @staticmethod
    def none(words: int) -> Runs:
        zeros = np.zeros(words, np.int64)
        return Runs(zeros > 0, np.zeros((4, words), np.int64), [""] * words, zeros, zeros[:0], zeros[:0])

    @staticmethod
    def joined(parts: list[Runs]) -> Runs:
        own = list(zip(*parts))
        return Runs(np.concatenate(own[0]), np.concatenate(own[1], 1), list(chain.from_iterable(own[2])), *[np.concatenate(x) for x in own[3:]])


def _summed(doc: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, sum of n) of the distinct (document, key), in that order."""
    if not len(doc):
        return doc, key, n
    order = np.lexsort((key, doc))
    doc, key, n = doc[order], key[order], n[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    return doc[first], key[first], np.add.reduceat(n, first)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, `size` many, one behind the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of groups of n tokens of A from x on and m of B from y on.  Pairs of small groups may repeat; of
    large ones each distinct pair is there once."""
    small = np.flatnonzero(n * m <= SMALL)
    each = n[small] * m[small]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    group = np.repeat(small, each)
    key = a[x[group] + at // m[group]] << 32 | b[y[group] + at % m[group]]
    parts = [(group, key, np.ones(len(key), np.int64))]
    for g in np.flatnonzero(n * m > SMALL).tolist():
        (p, k), (q, r) = (np.unique(side[z : z + w], return_counts=True) for side, z, w in ((a, x[g], n[g]), (b, y[g], m[g])))
        parts.append((np.full(len(p) * len(q), g), (p[:, None] << 32 | q).ravel(), (k[:, None] * r).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts))


class Aligner:
    """Both tokenizers, the transducer, and its runs over the words met so far."""

    def __init__(self, first: str, second: str):
        self.first, self.second = coder_of(first), Pieces(second)
        self.transducer = Transducer(self.first.pieces, self.second.pieces)
        self.begin()

    def begin(self) -> None:
        self.place: dict[str, int] = {}
        self.runs, self.chars = Runs.none(0), 0

    def words(self, text: str) -> list[str]:
        return _WORDS.split(text) if self.second.by_words else [text]

    def _over(self, words: list[str]) -> Runs:
        """The runs over words that may stand in one text, a space before each."""
        text = " ".join(words)
        raw, pieces = b" " + text.encode(), self.second.pieces
        a = self.first.plain(" " + text)
        b = list(chain.from_iterable(self.second.encode([" ".join(words[k : k + CALL_WORDS]) for k in range(0, len(words), CALL_WORDS)])))
        if b"".join([pieces[t] for t in b]) != raw or self.first.decode(a) != raw:
            half = len(words) // 2
            return Runs.joined([self._over(words[:half]), self._over(words[half:])]) if half else Runs.none(1)
        ends, others = self.transducer.ends(a, b)
        said, i, j = [], 0, 0
        for k, m in zip(ends, others):
            if k - i == 1 == m - j:
                said.append(f"{a[i]}|{b[j]}")
            else:
                said.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        a, b, ends, others = (np.array(x, np.int64) for x in (a, b, ends, others))
        n, m = np.diff(ends, prepend=0), np.diff(others, prepend=0)
        passed = np.cumsum(self.first.widths[a])[ends - 1]  # bytes up to each group's end
        behind = np.cumsum([len(w.encode()) + 1 for w in words])  # and to each word's
        last = np.searchsorted(passed, behind)  # each word's last group
        if not np.array_equal(passed[last], behind):
            raise ValueError("a token reaches over the end of a word")
        groups = np.diff(last + 1, prepend=0)
        word = np.repeat(np.arange(len(words)), groups)
        totals = np.stack([np.bincount(word, x, len(words)).astype(np.int64) for x in (n, m, np.ones(len(n)), n * m)])
        group, key, times = _pairs(a, b, ends - n, n, others - m, m)
        own, key, times = _summed(word[group], key, times)
        stops = np.append(0, last + 1).tolist()
        return Runs(np.ones(len(words), bool), totals, [";".join(said[x:y]) for x, y in zip(stops, stops[1:])], np.bincount(own, minlength=len(words)), key, times)

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The words of each text as numbers into `runs`; those that are new are encoded together where they may stand in one text."""
        if len(self.place) > MOST_WORDS or self.chars > MOST_CHARS:
            self.begin()
        before, place = len(self.place), self.place
        out = [[place.setdefault(w, len(place)) for w in self.words(t)] if t else [] for t in texts]
        new = list(islice(place, before, None))
        alone = [not self.second.by_words or w[0].isspace() or w[-1].isspace() or "▁" in w for w in new]
        order = [k for k, x in enumerate(alone) if not x] + [k for k, x in enumerate(alone) if x]
        together = [new[k] for k in order[: len(new) - sum(alone)]]
        parts = [Runs.none(0), *([self._over(together)] if together else []), *[self._over([new[k]]) for k in order[len(together) :]]]
        for k, w in enumerate([*together, *[new[k] for k in order[len(together) :]]], before):
            place[w] = k
        if sum(alone):  # they were numbered in the order they were met in
            back = np.empty(len(new), np.int64)
            back[order] = np.arange(before, before + len(new))
            moved = back.tolist()
            out = [[w if w < before else moved[w - before] for w in own] for own in out]
        self.runs = Runs.joined([self.runs, *parts])
        self.chars += sum(map(len, new))
        return out


_aligners: dict[tuple, Aligner] = {}


def aligner_of(first: str, second: str) -> Aligner:
    """This worker's aligner of two files."""
    if (first, second) not in _aligners:
        _aligners.clear()
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def aligned(aligner: Aligner, texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """What a slice of texts holds: totals and digest of each, its distinct pairs as numbers into `pairs`, their numbers of
    links, and in how many of the texts each pair is."""
    cut, runs = aligner.numbers(texts), aligner.runs
    size = np.array([len(own) for own in cut], np.int64)
    word = np.fromiter(chain.from_iterable(cut), np.int64, size.sum())
    doc = np.repeat(np.arange(len(texts)), size)
    bad = np.zeros(len(texts), bool)
    bad[doc[~runs.good[word]]] = True
    said = runs.said
    digests = [hashlib.sha256(";".join([said[w] for w in own]).encode()).hexdigest() if own and not no else "" for own, no in zip(cut, bad.tolist())]
    keep = ~bad[doc]
    doc, word, n = _summed(doc[keep], word[keep], np.ones(keep.sum(), np.int64))
    out = {c: np.bincount(doc, n * runs.totals[k][word], len(texts)).astype(np.int64) for k, c in enumerate(_TOTALS)}
    each, first = runs.wide[word], (np.cumsum(runs.wide) - runs.wide)[word]
    at = _ranges(first, each)
    pairs, pair = np.unique(runs.keys[at], return_inverse=True)
    doc, pair, n = _summed(np.repeat(doc, each), pair, np.repeat(n, each) * runs.times[at])
    return out | {
        "digests": digests,
        "pairs": pairs,
        "held": np.bincount(pair, minlength=len(pairs)),
        "ends": np.searchsorted(doc, np.arange(len(texts)), "right"),
        "pair": pair.astype(np.uint32),
        "times": n,
    }


_KEPT = {"ends": np.int64, "pair": np.uint32, "times": np.int64}


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(texts.fill_null("").cast(pa.large_binary()).to_pandas().str.len().to_numpy()) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        low = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, low + SLICE_BYTES, "right")))
        yield at, to
        at = to


def _written(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(first, second)
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi in _slices(b.column(1)):
                found = aligned(aligner, b.column(1).slice(lo, hi - lo).to_pylist())
                row = [pa.array([number]), _list(b.column(0).slice(lo, hi - lo)), *[_list(pa.array(found[c])) for c in _TOTALS], _list(pa.array(found["digests"], pa.string()))]
                row += [_list(pa.array(found[c].astype(np.int64))) for c in ("pairs", "held")]
                row += [binary_column(found[c].astype(kind), np.array([len(found[c])])) for c, kind in _KEPT.items()]
                yield pa.RecordBatch.from_arrays(row, ["slice", "ids", *_TOTALS, "digests", "pairs", "held", *_KEPT])
                number += 1

    return run


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _weighed(slices: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of a slice, with n_best and count_sum from the answers for its pairs."""
    parts = []
    keys = answers["pair"].to_numpy()
    order = np.argsort(keys)
    keys, count, best = keys[order], answers["count"].to_numpy()[order], answers["best"].to_numpy()[order]
    for i in range(slices.num_rows):
        own = np.searchsorted(keys, slices["pairs"][i].values.to_numpy())
        ends, pair, times = (np.frombuffer(slices[c][i].as_buffer(), kind) for c, kind in _KEPT.items())
        weighed = np.stack([times * count[own][pair], times * best[own][pair]]) if len(pair) else np.zeros((2, 0), np.int64)
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(weighed, 1)], 1)
        total = np.diff(np.concatenate([np.zeros((2, 1), np.int64), sums[:, ends]], 1), axis=1)
        columns = [slices["ids"][i].values, *[slices[c][i].values for c in _TOTALS], pa.array(total[1]), pa.array(total[0]), slices["digests"][i].values]
        parts.append(pa.Table.from_arrays(columns, ["id", *_TOTALS, "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(parts)


def pair_counts(slices: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each id pair (A << 32 | B) is linked, and whether no pair of its A has more."""
    rows = slices.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("n"))
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("copies"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most as many rows as B has ids
    return counts.select("pair", "count", (F.col("count") == top).cast("long").alias("best"), "copies")


def align(documents: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    first: a byte-level BPE file (A); second: a sentencepiece model (B).
    """
    bounded_batches(documents.sparkSession)
    kind = documents.select(id_col).schema[0].dataType.simpleString()
    lists = ", ".join(f"{c} array<long>" for c in _TOTALS)
    schema = f"slice long, ids array<{kind}>, {lists}, digests array<string>, pairs array<long>, held array<long>, " + ", ".join(f"{c} binary" for c in _KEPT)
    slices = materialise(documents.select(id_col, text_col).mapInArrow(_written(first, second), schema), "slices")
    counts = materialise(pair_counts(slices), "counts")
    asked = slices.select("slice", F.explode("pairs").alias("pair"))
    answers = meet(asked, counts, ["pair"], most=OFTEN).select(F.col("slice").alias("asking"), F.col("pair"), "count", "best")
    totals = ", ".join(f"{c} long" for c in [*_TOTALS, "n_best", "count_sum"])
    out = slices.drop("held").groupBy("slice").cogroup(answers.groupBy("asking")).applyInArrow(_weighed, f"id {kind}, {totals}, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)

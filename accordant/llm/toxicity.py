"""Toxicity by compression distance: how much better a window compresses with a dictionary of toxic text.

zstandard's trainer makes two dictionaries from labelled text: the ordinary one from windows of ordinary documents,
the toxic one from the words of toxic documents that hold a telling n-gram, one that toxic text has at many times
the rate of ordinary text.  (Nearly all of a toxic document is like ordinary text, so from its whole windows the trainer
picks that, and nothing toxic.)  Windows are compressed with the ordinary dictionary and with both together; in
place of the toxic one the first has bytes that no text has, so that the ordinary part is at the same distances and
a window's compressed length differs only where toxic text serves it.

A document is cut into windows of WINDOW words.  How many of them save at least so many bytes, for each of LEVELS, and how
many windows there are, go (as logarithms) into a logistic curve, fitted on a calibration part of the labelled rows that
no dictionary was trained from: the probability of the label 1.  Its threshold is a parameter of the caller.

Fitting uses a bounded sample of labelled rows: about `most_toxic` and `most_ordinary` documents of at most
`most_chars` characters, taken by hash.  Scoring covers every window of every document, in the tasks that read them;
only the model (some tens of kilobytes) is broadcast.

A null text counts as empty; a text without words has no window and gets the calibration's score for no evidence.
Rows with a null label, or labels of unknown documents, are not used; of several labels of a document the largest
counts.  Without labels of both kinds, or without anything that marks toxic text, every score is the share of toxic
labels (0 without labels).  Too little text for the trainer is a dictionary as it stands.  Repeated rows give a row each.  Only ids, texts and labels are read, and ids only to
match labels; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, share
from .kernels import BLANK_WORDS, LOWER, SPACES, slices, text_bytes, words

#: Words in a window, and the most bytes of one (a longer window is cut).
WINDOW, WINDOW_BYTES = 14, 1024
#: Most bytes of the ordinary and of the toxic dictionary, and the trainer's settings (segment and match length).
ORDINARY, TOXIC, SEGMENTS = 64 << 10, 2 << 10, dict(k=16, d=6)
#: Byte n-grams; in how many toxic documents one must be (at least, and as a share), how many times the rate of ordinary
#: text its rate must be, and how often a document counts at most.
GRAM, LEAST, SHARE, TIMES, OFTEN = 5, 4, 0.03, 12.0, 4
#: Bytes saved from which windows are counted.
LEVELS = (2, 4, 6)
#: Weight decay of the curve.
RIDGE = 0.1
#: One sampled document in so many calibrates instead of training the dictionaries.
CALIBRATES = 3
_SETTING = dict(strategy=7, min_match=5, search_log=4, target_length=16, window_log=17, hash_log=15, chain_log=16, write_content_size=0, write_dict_id=0)


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every window of the documents at the offsets."""
    w = words(raw, offsets, BLANK_WORDS)
    size = np.diff(w.first)
    place = np.arange(len(w.start)) - np.repeat(w.first[:-1], size)
    at = np.flatnonzero(place % WINDOW == 0)
    doc = w.doc[at]
    start, end = w.start[at], w.end[np.minimum(at + WINDOW, w.first[1:][doc]) - 1]
    pieces = -(-(end - start) // WINDOW_BYTES)
    own = np.repeat(np.arange(len(at)), pieces)
    start = start[own] + WINDOW_BYTES * (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return start, np.minimum(start + WINDOW_BYTES, end[own]), doc[own]


class Lengths:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, content: bytes):
        setting = zstandard.ZstdCompressionParameters(**_SETTING)
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(compression_params=setting)
        self.compressor = zstandard.ZstdCompressor(compression_params=setting, dict_data=held)

    def of(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        spans = np.stack([start, end - start], 1).astype(np.uint64)
        out = self.compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, spans.tobytes()))
        return np.fromiter(map(len, out), np.int64, len(out))


class Model:
    """The two dictionaries and the logistic curve: what is broadcast."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.curve = np.zeros(len(LEVELS) + 2)
        self._lengths = None

    def __getstate__(self):
        return self.__dict__ | {"_lengths": None}

    def savings(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes saved by the toxic dictionary, document) of each window."""
        if self._lengths is None:
            self._lengths = Lengths(self.ordinary + b"\xff" * len(self.toxic)), Lengths(self.ordinary + self.toxic)
        start, end, doc = windows(raw, offsets)
        if not len(start):
            return np.zeros(0, np.int64), doc
        low = LOWER[raw].tobytes()
        ordinary, toxic = (x.of(low, start, end) for x in self._lengths)
        return ordinary - toxic, doc

    def evidence(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The curve's inputs for each document, and the most bytes that a window of it saves (0 without windows)."""
        n = len(offsets) - 1
        most, counts = np.zeros(n, np.int64), np.zeros((n, len(LEVELS) + 1))
        for lo, hi in slices(offsets):
            saved, doc = self.savings(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            np.maximum.at(most, doc + lo, saved)
            for j, level in enumerate((None, *LEVELS)):
                counts[lo:hi, j] = np.bincount(doc if level is None else doc[saved >= level], minlength=hi - lo)
        return np.concatenate([np.ones((n, 1)), np.log1p(counts)], 1), most

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve, -30, 30)))


def _gram_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams inside words, the documents that hold each, and how often they do (a document up to OFTEN), by slices."""
    keys, docs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo, hi in slices(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        h, doc = _grams(part, own)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        often = np.minimum(np.diff(np.append(at, len(h))), OFTEN)
        keys, at = np.unique(np.concatenate([keys, h[first]]), return_inverse=True)
        docs = np.bincount(at, weights=np.concatenate([docs, np.ones(len(often))]), minlength=len(keys)).astype(np.int64)
        counts = np.bincount(at, weights=np.concatenate([counts, often]), minlength=len(keys)).astype(np.int64)
    return keys, docs, counts


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number that GRAM bytes make at each place where they fit in the document, and the document.

    White space counts only before or behind a word, so no n-gram reaches into two words; 0 stands where none is.
    """
    n = max(0, len(raw) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = (h << np.uint64(8)) | raw[j : n + j].astype(np.uint64)
    doc = np.searchsorted(offsets, np.arange(n), "right") - 1
    fits = np.arange(n) + GRAM <= offsets[1:][doc] if n else np.zeros(0, bool)
    space = SPACES[raw]
    for j in range(1, GRAM - 1):
        fits &= ~space[j : n + j]
    return np.where(fits, h, 0), doc


def telling(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Of each toxic text its distinct words with a telling n-gram: what the toxic dictionary is trained from."""
    (raw, offsets), (other, other_offsets) = (text_bytes(pa.array(x, pa.large_binary())) for x in (toxic, ordinary))
    keys, docs, counts = _gram_counts(raw, offsets)
    against, _, against_counts = _gram_counts(other, other_offsets)
    if not len(keys):
        return []
    at = np.minimum(np.searchsorted(against, keys), max(0, len(against) - 1))
    found = np.where(against[at] == keys, against_counts[at], 0) if len(against) else np.zeros(len(keys), np.int64)
    much = counts / max(1, len(raw)) >= TIMES * (found + 1) / max(1, len(other))
    good = keys[(keys > 0) & (docs >= max(LEAST, SHARE * len(toxic))) & much]
    out = []
    for lo, hi in slices(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        spot = np.flatnonzero(np.isin(_grams(part, own)[0], good))
        w = words(part, own, BLANK_WORDS)
        middle = spot + GRAM // 2  # inside a word: white space stands only at an n-gram's ends
        hit = np.unique(np.searchsorted(w.start, middle, "right") - 1)
        by_doc: dict[int, dict[bytes, None]] = {}
        for i in hit.tolist():
            by_doc.setdefault(int(w.doc[i]), {})[part[w.start[i] : min(w.end[i], w.start[i] + 64)].tobytes()] = None
        out += [b" " + b" ".join(x) + b" " for x in by_doc.values()]
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """The trainer's dictionary of the samples; the samples themselves where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, **SEGMENTS).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(texts: list[str], labels: list[int], prior: float | None = None) -> Model | float:
    """A model of the labelled texts, or the share of toxic labels where there is nothing to learn from.

    prior: share of toxic labels among the documents to be scored, where the texts are not a fair sample of them.
    """
    raws = [bytes(LOWER[np.frombuffer((t or "").encode(), np.uint8)]) for t in texts]
    kind = np.array(labels, bool)
    share = float(kind.mean()) if len(kind) else 0.0
    prior = share if prior is None else prior
    part = np.arange(len(raws)) % CALIBRATES == 0
    toxic = [r for r, k, p in zip(raws, kind, part) if k and not p]
    ordinary = [r for r, k, p in zip(raws, kind, part) if not k and not p]
    if not toxic or not ordinary or len(set(kind[part])) < 2:
        return prior
    special = telling(toxic, ordinary)
    if not special:
        return prior
    raw, offsets = text_bytes(pa.array(ordinary, pa.large_binary()))
    start, end, _ = windows(raw, offsets)
    step = max(1, len(start) // 20_000)
    model = Model(trained([raw[a:z].tobytes() for a, z in zip(start[::step], end[::step])], ORDINARY), trained(special, TOXIC))

    x, _ = model.evidence(*text_bytes(pa.array([r for r, p in zip(raws, part) if p], pa.large_binary())))
    kind = kind[part]
    model.curve = logistic(x, kind.astype(float))
    model.curve[0] += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6) * (1 - kind.mean()) / kind.mean())
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, lightly regularised (not the first, which is the intercept's)."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [RIDGE] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for b in batches:
            score, most = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            if isinstance(known, float):
                score[:] = known
            else:
                x, most = known.evidence(*text_bytes(b.column(1)))
                score = known.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(most)], ["id", "score", "most_saved"])

    return run


def labelled_sample(documents: DataFrame, labels: DataFrame, usable: Column, most_toxic: int = 2000, most_ordinary: int = 5000, most_chars: int = 16_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int], float]:
    """Texts and labels of the bounded sample (about so many rows), and the share of label 1 among all usable labels."""
    given = labels.filter(F.col(label_col).isNotNull() & usable).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in given.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    most = {1: most_toxic, 0: most_ordinary}
    part = [F.when(F.col("_label") == k, F.lit(min(1.0, most[k] / n))) for k, n in counts.items() if k in most]
    if not part:
        return [], [], 0.0
    chosen = given.filter(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1_000_000)) < 1_000_000 * F.coalesce(*part))
    most_rows = 2 * (most_toxic + most_ordinary)
    chosen = F.broadcast(chosen.limit(most_rows))  # bounded by the sample's size, so the texts need no shuffle
    own = documents.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).filter(F.char_length("text") <= most_chars)
    found = own.join(chosen, F.col("_doc") == F.col("_id")).select("text", "_label")
    rows = found.orderBy(F.xxhash64("text"), "text").limit(most_rows).toArrow()
    return rows["text"].to_pylist(), rows["_label"].to_pylist(), counts.get(1, 0) / sum(counts.get(k, 0) for k in most)


def score(documents: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (probability of the label 1) and most_saved (bytes, of its best window)."""
    bounded_batches(documents.sparkSession)
    shared = share(documents.sparkSession, model)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_scored(shared), f"id {docs.schema['id'].dataType.simpleString()}, score double, most_saved long").withColumnRenamed("id", id_col)

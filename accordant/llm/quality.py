"""Quality by ordinal regression: shared weights of hashed text, ordered thresholds between the grades.

The cumulative-link (proportional odds) model P(grade > k) = logistic(s - t_k), t_0 < t_1 < ..., has one score s for
all thresholds: a weighted mean over the text's byte trigrams, hashed to BITS bits, and over marks of words that
repeat the word before them or one WORDS_APART words before.  A text's expected grade is the sum of its tail
probabilities; selection keeps documents whose tail probability at a chosen grade reaches a threshold.
The mean is taken over SHORT more places than the text has, so a short text stays close to the prior.

Fitting uses a bounded sample of rated rows: about `most` documents of at most `most_chars`
characters each, by hash, all grades at the same rate.  Scoring covers all bytes of every document in the tasks that read them; only the weights
(4 * 2**BITS bytes) are broadcast.

A null text counts as empty and gets the prior.  Rows with a null grade or of unknown documents are not used; of
several ratings of a document the smallest counts.  With fewer than two grades in the sample every tail
probability is 1.  Repeated rows give a row each.  Only ids, texts and ratings are read, and ids only to match
ratings; other columns are handed on whatever their names (`grade` replaces those of its own two names).  An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, share
from .kernels import BLANK_WORDS, slices, text_bytes, words

BITS = 16
SHORT = 40
#: Gaps at which repeated words are marked, and how many places a mark counts for.
WORDS_APART, MARK = (1, 2), 6
#: Rounds and step of the fit (Adam), and the weight decay.
ROUNDS, STEP, DECAY = 150, 0.5, 1e-5
_SCALE = 30.0


def places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every place of the documents at the offsets."""
    n = max(0, len(raw) - 2)
    h = (raw[:n].astype(np.uint32) << 16) | (raw[1 : n + 1].astype(np.uint32) << 8) | raw[2 : n + 2]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)[:n]
    inside = np.arange(n) + 3 <= offsets[1:][doc] if n else np.zeros(0, bool)
    h, doc = [h[inside]], [doc[inside]]
    w = words(raw, offsets, BLANK_WORDS)
    for k in WORDS_APART:
        again = np.flatnonzero((w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k]))
        h.append(np.full(len(again) * MARK, k - 1, np.uint32))
        doc.append(np.repeat(w.doc[k:][again], MARK))
    return np.concatenate(h), np.concatenate(doc)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights and thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for lo, hi in slices(offsets):
            h, doc = places(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            total[lo:hi] = np.bincount(doc, weights=self.weights[h], minlength=hi - lo)
            count[lo:hi] = np.bincount(doc, minlength=hi - lo)
        return _SCALE * total / (count + SHORT)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each document and threshold k."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(texts: list[str], grades: list[int]) -> Ordinal | None:
    """The model of the rated texts (grades 0, 1, ...); None with fewer than two grades."""
    grade = np.array(grades, np.int64)
    if len(np.unique(grade)) < 2:
        return None
    steps = int(grade.max())
    raw, offsets = text_bytes(pa.array(texts, pa.large_string()))
    feature, doc, value = [], [], []
    for lo, hi in slices(offsets):
        h, d = places(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        count = np.bincount(d, minlength=hi - lo)
        pair, times = np.unique((d.astype(np.int64) << BITS) | h, return_counts=True)
        own = pair >> BITS
        feature.append(pair & ((1 << BITS) - 1))
        doc.append(own + lo)
        value.append(_SCALE * times / (count[own] + SHORT))
    feature, doc, value = np.concatenate(feature), np.concatenate(doc), np.concatenate(value)

    above = (grade[:, None] > np.arange(steps)[None, :]).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    first, gaps = -np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 1e-2))
    theta = np.concatenate([np.zeros(1 << BITS), [first], gaps])  # thresholds: the first, then logs of the gaps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    w = slice(0, 1 << BITS)
    for k in range(1, ROUNDS + 1):
        score = np.bincount(doc, weights=value * theta[w][feature], minlength=len(grade))
        t = theta[1 << BITS] + np.concatenate([[0.0], np.cumsum(np.exp(theta[(1 << BITS) + 1 :]))])
        # Log-likelihood of a grade: log(P(> g-1) - P(> g)), with P(> -1) = 1 and P(> last) = 0.
        tail = _sigmoid(score[:, None] - t[None, :])
        full = np.concatenate([np.ones((len(grade), 1)), tail, np.zeros((len(grade), 1))], 1)
        slope = full * (1 - full)
        rows = np.arange(len(grade))
        mass = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-9)
        g_score = (slope[rows, grade] - slope[rows, grade + 1]) / mass
        g_t = np.zeros((len(grade), steps + 2))
        g_t[rows, grade] -= slope[rows, grade] / mass
        g_t[rows, grade + 1] += slope[rows, grade + 1] / mass
        g_t = g_t[:, 1:-1].mean(0)
        grad = np.empty_like(theta)
        grad[w] = np.bincount(feature, weights=value * g_score[doc], minlength=1 << BITS) / len(grade) - DECAY * theta[w]
        grad[1 << BITS] = g_t.sum()
        grad[(1 << BITS) + 1 :] = [g_t[j + 1 :].sum() * np.exp(theta[(1 << BITS) + 1 + j]) for j in range(steps - 1)]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta += STEP * (1 - k / (ROUNDS + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    t = theta[1 << BITS] + np.concatenate([[0.0], np.cumsum(np.exp(theta[(1 << BITS) + 1 :]))])
    return Ordinal(theta[w].astype(np.float32), t)


def rated_sample(documents: DataFrame, labels: DataFrame, grade: Column, most: int = 6000, most_chars: int = 16_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and grades of the bounded sample: about `most` rows, all grades at the same rate."""
    given = labels.select(F.col(id_col).alias("_id"), grade.cast("int").alias("_grade")).filter("_grade IS NOT NULL").groupBy("_id").agg(F.min("_grade").alias("_grade"))
    total = given.count()
    rate = min(1.0, most / max(1, total))
    chosen = given.filter(F.pmod(F.xxhash64(F.lit("rated"), "_id"), F.lit(1_000_000)) < int(1_000_000 * rate))
    chosen = F.broadcast(chosen.limit(2 * most))  # bounded by the sample's size, so the texts need no shuffle
    own = documents.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).filter(F.char_length("text") <= most_chars)
    found = own.join(chosen, F.col("_doc") == F.col("_id")).select("text", "_grade")
    rows = found.orderBy(F.xxhash64("text"), "text").limit(2 * most).toArrow()
    return rows["text"].to_pylist(), rows["_grade"].to_pylist()


def _graded(documents: DataFrame, model: Ordinal | None, at: int, text_col: str) -> Column:
    """(expected, tail) of the text."""
    bounded_batches(documents.sparkSession)
    held = share(documents.sparkSession, model)

    def run(text: pa.Array) -> pa.Array:
        known: Ordinal | None = held.value
        if known is None:
            expected = tail = np.ones(len(text))
        else:
            tails = known.tails(known.scores(*text_bytes(text)))
            expected, tail = tails.sum(1), tails[:, min(at, tails.shape[1]) - 1]
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(tail)], ["expected", "tail"])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<expected: double, tail: double>")(F.col(text_col))


def grade(documents: DataFrame, model: Ordinal | None, at_least: int = 1, text_col: str = "text") -> DataFrame:
    """The documents with the columns _expected_grade and _tail, the probability of the grade `at_least` or a higher one."""
    own = ("_expected_grade", "_tail")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in own]).alias("row"), _graded(documents, model, at_least, text_col).alias("found"))
    return rows.select("row.*", F.col("found.expected").alias(own[0]), F.col("found.tail").alias(own[1]))


def select(documents: DataFrame, model: Ordinal | None, at_least: int = 1, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose tail probability reaches the threshold, with all their columns."""
    return documents.filter(_graded(documents, model, at_least, text_col)["tail"] >= threshold)

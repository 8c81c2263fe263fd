"""Ranked lexical search over document-sharded CSR postings with integer impacts.

1. One pass counts terms: N, the documents with at least one, and L, all of them.
2. Another builds the index.  A shard is a few megabytes of neighbouring documents, as one row: their ids, the sorted
   64-bit hashes of their terms, row pointers, and per posting the document's number in the shard and its impact, the integer
   1000000000 * tf div (1000 * tf + 20 * m).  A term's weight depends on its document frequency alone, so it is multiplied in
   when a term is looked up and the index needs no join.  The index is written to the shared folder.
3. A query set's document frequencies come from the row pointers of all shards, summed in Spark.
4. Each task takes its shards one after the other and each item term at a time: postings are added up in a dense NumPy
   array over the shard's documents, argpartition finds the best, and all documents that tie with the last are
   weighed by id, so the selection is exact.  A task keeps k rows an item over all its shards; two rounds merge
   the tasks' rows, the first in MERGERS groups, so that no item's candidates meet in one task.

Items are searched in blocks of about ITEM_BYTES, which is what is broadcast; the index is read once a block.

Terms are maximal runs of ASCII letters, digits and characters outside ASCII; only A-Z is lower-cased.  A null or
empty text has no terms: it is never found and finds nothing.  Repeated documents are found each; repeated items get
their rows each.  Equal scores go by ascending id, null ids last.  Other columns are not read.  Scores and impacts
are 64-bit integers; two terms of the same 64-bit hash would be taken for one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, share
from .kernels import ALNUM_WORDS, Words, binary_column, text_bytes, words

#: Bytes of text that a shard holds, about; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of the items that are searched at a time, about: what is collected, broadcast and held in every task.
ITEM_BYTES = 8 << 20
#: Groups in which the tasks' candidates of an item are merged before they meet.
MERGERS = 256
#: The ranking's constants (fixed values): m = 100 - FLAT + FLAT * n * N div L; impact = SCALE * tf div (UNIT * tf + SLOPE * m).
FLAT, SCALE, UNIT, SLOPE = 50, 1_000_000_000, 1000, 20


def weight(n: int, df: int) -> int:
    """A term's weight from N and its document frequency."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _slices(text: pa.Array) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = text_bytes(text)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHARD_BYTES, "right")) - 1))
        yield at, to, words(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], ALNUM_WORDS)
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for b in batches:
        for _, _, w in _slices(b.column(0)):
            documents += int(np.count_nonzero(np.diff(w.first)))
            terms += len(w.hash)
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])


def corpus_counts(documents: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(N, L): documents with at least one term, and all their terms with repeats."""
    found = documents.select(text_col).mapInArrow(_counted, "documents long, terms long")
    n, total = found.agg(F.sum("documents"), F.sum("terms")).first()
    return n or 0, total or 0


def postings(w: Words, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row pointers, documents, impacts) of a shard's words."""
    order = np.argsort(w.hash, kind="stable")  # documents stay in order within a term
    term, doc = w.hash[order], w.doc[order]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(term)))
    term, doc = term[first], doc[first]
    length = np.diff(w.first).astype(np.int64)
    m = 100 - FLAT + (FLAT * length * n) // max(1, total)
    impact = SCALE * tf // (UNIT * tf + SLOPE * m[doc])
    start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    return term[start], np.append(start, len(term)).astype(np.uint32), doc.astype(np.uint32), impact.astype(np.uint32)


_ARRAYS = {"terms": np.uint64, "pointers": np.uint32, "docs": np.uint32, "impacts": np.uint32}


def _built(n: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _slices(b.column(1)):
                arrays = [binary_column(a, np.array([len(a)])) for a in postings(w, n, total)]
                ids = b.column(0).slice(lo, hi - lo)
                held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([held, *arrays], ["ids", *_ARRAYS])

    return run


def build(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(index, N): one row a shard: ids, and terms, pointers, docs and impacts as binary arrays."""
    bounded_batches(documents.sparkSession)
    n, total = corpus_counts(documents, text_col)
    kind = documents.select(id_col).schema[0].dataType.simpleString()
    schema = f"ids array<{kind}>, " + ", ".join(f"{a} binary" for a in _ARRAYS)
    return materialise(documents.select(id_col, text_col).mapInArrow(_built(n, total), schema), "postings"), n


class Items:
    """The distinct terms of a block of items: their sorted hashes, and each item's places among them."""

    def __init__(self, texts: list[str | None]):
        column = pa.array(texts, pa.large_string())
        raw, offsets = text_bytes(column)
        w = words(raw, offsets, ALNUM_WORDS)
        self.terms, place = np.unique(w.hash, return_inverse=True)
        self.own = [np.unique(place[a:z]) for a, z in zip(w.first[:-1], w.first[1:])]


def _array(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.frombuffer(b.column(name)[i].as_buffer(), _ARRAYS[name])


def _spots(b: pa.RecordBatch, i: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of the wanted terms a shard holds, where their postings start, where they end)."""
    terms, pointers = _array(b, "terms", i), _array(b, "pointers", i)
    at = np.searchsorted(terms, wanted)
    held = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == wanted) if len(terms) else np.zeros(0, np.int64)
    return held, pointers[at[held]].astype(np.int64), pointers[at[held] + 1].astype(np.int64)


def _frequencies(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(items.value.terms), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                held, start, end = _spots(b, i, items.value.terms)
                df[held] += end - start
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], ["term", "df"])

    return run


def best(score: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal ones at the edge those with the smallest ids, nulls last."""
    above = np.flatnonzero(score > 0)
    if len(above) <= k:
        return above
    own = score[above]
    edge = own[np.argpartition(own, len(own) - k)[len(own) - k]]
    sure, ties = above[own > edge], above[own == edge]
    left = k - len(sure)
    if len(ties) > left:
        order = pc.sort_indices(ids.take(pa.array(ties)), null_placement="at_end").to_numpy()
        ties = ties[order[:left]]
    return np.concatenate([sure, ties])


class Ranking:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(items)]
        self.ids: list[pa.Array | None] = [None] * items

    def add(self, item: int, score: np.ndarray, ids: pa.Array) -> None:
        held = self.scores[item]
        if len(held) == self.k and score.max() < held.min():
            return
        own = best(score, ids, self.k)
        if not len(own):
            return
        new_ids = ids.take(pa.array(own))
        both, names = np.concatenate([held, score[own]]), new_ids if self.ids[item] is None else pa.concat_arrays([self.ids[item], new_ids])
        keep = best(both, names, self.k)
        self.scores[item], self.ids[item] = both[keep], names.take(pa.array(keep))


def _ranked(items, weights: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, own = items.value.terms, items.value.own
        ranking = Ranking(len(own), k)
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values
                docs, impacts = _array(b, "docs", i), _array(b, "impacts", i).astype(np.int64)
                held, start, end = _spots(b, i, terms)
                at = np.full(len(terms), -1)
                at[held] = np.arange(len(held))
                total = np.zeros(len(ids), np.int64)
                for item, places in enumerate(own):
                    found = at[places]
                    found = found[found >= 0]
                    if not len(found):
                        continue
                    total[:] = 0
                    for f in found.tolist():
                        run_of = slice(start[f], end[f])
                        total[docs[run_of]] += weights[held[f]] * impacts[run_of]
                    ranking.add(item, total, ids)
        full = [j for j, s in enumerate(ranking.scores) if len(s)]
        if full:
            sizes = [len(ranking.scores[j]) for j in full]
            columns = [pa.array(np.repeat(full, sizes), pa.int32()), pa.concat_arrays([ranking.ids[j] for j in full]), pa.array(np.concatenate([ranking.scores[j] for j in full]))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return run


def _top(rows: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def search(index: DataFrame, n: int, queries: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): each item's k highest-scoring documents with a score above 0, under the columns'
    names item_col, rank, id and score.  index, n: what `build` returns."""
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    own = materialise(queries.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter(F.octet_length("text") > 0), "items")
    size = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    out = None
    for block in range(blocks):
        part = own if blocks == 1 else own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        asked = part.toArrow()
        items = share(spark, Items(asked["text"].to_pylist()))
        df = np.zeros(len(items.value.terms), np.int64)
        found = index.select("terms", "pointers").mapInArrow(_frequencies(items), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df[found["term"].to_numpy()] = found["df"].to_numpy()
        weights = np.array([weight(n, d) for d in df.tolist()], np.int64)
        ranked = index.mapInArrow(_ranked(items, weights, k), f"item int, id {kind}, score long").withColumn("group", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
        best_rows = materialise(_top(_top(ranked, ["item", "group"], k, "rank"), ["item"], k, "rank").select("item", "rank", "id", "score"), "ranked")
        names = spark.createDataFrame(asked.select(["item_id"]).append_column("item", pa.array(np.arange(asked.num_rows), pa.int32())))
        rows = best_rows.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), "rank", "id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out

"""Line dedup with a sharded minimal perfect hash over the distinct line hashes.

1. One pass over the texts gives each document's 128-bit line keys, in blocks of documents, written once.
2. Each block sends its distinct keys with their document counts to the shard that the key belongs to; a line
   that stands in every document reaches its shard once a block.  A shard builds a minimal perfect hash over its
   distinct keys, and writes it as arrays: the hash's bits, a fingerprint and a count at each key's slot.  Keys are
   not kept, so only the hash tells where a line's count stands.
3. In a second pass the documents' keys go to the shards, again once a block, and probe the arrays; keys whose
   fingerprint agrees and whose count reaches `min_docs` go back to their blocks.  A shard's arrays stay in the task
   that probes them, so memory follows the shard, not the corpus, and nothing is broadcast.
4. Each block marks its documents' lines; the texts meet their marks by id and content once.

A line's key is the line without white space [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased.  Keys of at least
`min_chars` code points count once a document (row); repeated rows count each.  A null or empty text is one
empty line.  A document that loses all lines keeps an empty text.  Only the id and text columns are read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, same
from .kernels import mix

#: Keys that a shard gets, about.
KEYS_PER_SHARD = 400_000
_SPACE = b" \t\n\x0b\x0c\r"
_MOST = np.iinfo(np.uint32).max


class PerfectHash:
    """A minimal perfect hash: at each level the keys alone in their cell are placed, the rest go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = []  # a bit for each cell, and the slots before each cell
        placed = 0
        for alone in levels:
            self.levels.append((alone, placed + np.cumsum(alone) - alone))
            placed += int(alone.sum())
        self.size = placed

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, spread: float = 2.0) -> PerfectHash:
        """Over distinct keys."""
        levels: list[np.ndarray] = []
        while len(high):
            cell = cls._cell(high, low, len(levels), max(64, int(spread * len(high))))
            alone = np.bincount(cell, minlength=max(64, int(spread * len(high)))) == 1
            levels.append(alone)
            high, low = high[~alone[cell]], low[~alone[cell]]
        return cls(levels)

    @staticmethod
    def _cell(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(high + low * np.uint64(2 * level + 1) + np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's slot; a key that isn't a member gets some slot or -1."""
        out = np.full(len(high), -1, np.int64)
        todo = np.arange(len(high))
        for level, (alone, rank) in enumerate(self.levels):
            cell = self._cell(high[todo], low[todo], level, len(alone))
            hit = alone[cell]
            out[todo[hit]] = rank[cell[hit]]
            todo = todo[~hit]
        return out


class LineIndex:
    """A shard: fingerprints and counts at the slots of a minimal perfect hash."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.hash, self.prints, self.counts = hash_, prints, counts

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, docs: np.ndarray) -> LineIndex:
        """Over keys that may repeat; docs: in how many documents each row found its key."""
        order = np.lexsort((low, high))
        high, low, docs = high[order], low[order], docs[order]
        first = np.ones(len(high), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(first)
        total = np.add.reduceat(docs, at) if len(at) else np.zeros(0, np.int64)
        high, low = high[at], low[at]
        hash_ = PerfectHash.of(high, low)
        slot = hash_.slots(high, low)
        prints, counts = np.zeros(hash_.size, np.uint32), np.zeros(hash_.size, np.uint32)
        prints[slot] = cls._print(low)
        counts[slot] = np.minimum(total, _MOST)
        return cls(hash_, prints, counts)

    @staticmethod
    def _print(low: np.ndarray) -> np.ndarray:
        return (low >> np.uint64(32)).astype(np.uint32)

    def arrays(self) -> dict:
        """The shard as it is written: cells of each level, their bits, fingerprints and counts."""
        bits = [alone for alone, _ in self.hash.levels]
        packed = np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)
        return {"cells": [len(b) for b in bits], "bits": packed.tobytes(), "prints": self.prints.tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def read(cls, cells: list[int], bits: bytes, prints: bytes, counts: bytes) -> LineIndex:
        whole = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(cells)).astype(bool)
        return cls(PerfectHash(np.split(whole, np.cumsum(cells)[:-1]) if cells else []), np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint32))

    def documents(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """In how many documents each key stands; 0 for keys that the index hasn't."""
        slot = self.hash.slots(high, low)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == self._print(low[known])
        out = np.zeros(len(high), np.int64)
        out[known] = self.counts[slot[known]]
        return out


def line_keys(text: bytes, min_chars: int) -> bytes:
    """16 bytes a line: the hash of its key, or zeros if the key is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_SPACE).lower()
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars)
        out.append(bytes(16) if short or not key else xxhash.xxh3_128_digest(key))
    return b"".join(out)


def _keyed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            keys = [line_keys(t.encode() if t else b"", min_chars) for t in b.column(1).to_pylist()]
            block = pa.array(np.full(b.num_rows, (part << 24) + k, np.int64))
            yield pa.RecordBatch.from_arrays([block, b.column(0), b.column(2), pa.array(keys, pa.binary())], ["block", "id", "content", "keys"])

    return run


def _halves(keys: bytes) -> np.ndarray:
    return np.frombuffer(keys, ">u8").astype(np.uint64).reshape(-1, 2)


def _sent(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = b.column(0).to_numpy()
            keys = [_halves(k) for k in b.column(1).to_pylist()]
            for block in np.unique(blocks):
                own = []
                for i in np.flatnonzero(blocks == block):
                    own.append(np.unique(keys[i], axis=0))
                every = np.concatenate(own)
                every = every[every.any(axis=1)]
                distinct, docs = np.unique(every, axis=0, return_counts=True)
                high, low = distinct[:, 0], distinct[:, 1]
                shard = (mix(high) % np.uint64(shards)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(np.full(len(docs), block, np.int64)), pa.array(docs.astype(np.int64))],
                    ["shard", "high", "low", "block", "docs"],
                )

    return run


_ARRAYS = "shard int, cells array<long>, bits binary, prints binary, counts binary"


def _built(group: pa.Table) -> pa.Table:
    high, low = (group[c].to_numpy().view(np.uint64) for c in ("high", "low"))
    index = LineIndex.of(high, low, group["docs"].to_numpy())
    own = {k: pa.array([v], pa.list_(pa.int64()) if k == "cells" else pa.binary()) for k, v in index.arrays().items()}
    return pa.table({"shard": group["shard"][:1], **own})


def _probed(min_docs: int):
    def run(keys: pa.Table, shard: pa.Table) -> pa.Table:
        high, low = (keys[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        index = LineIndex.read(*(shard[c][0].as_py() for c in ("cells", "bits", "prints", "counts")))
        return keys.select(["block", "high", "low"]).filter(pa.array(index.documents(high, low) >= min_docs))

    return run


def _marked(lines: pa.Table, common: pa.Table) -> pa.Table:
    gone = {bytes(k) for k in np.stack([common[c].to_numpy().view(np.uint64) for c in ("high", "low")], 1).astype(">u8").view("S16").ravel().tolist()} if common.num_rows else set()
    gone = {k.ljust(16, b"\0") for k in gone}
    marks, lost, count = [], [], []
    for keys in lines["keys"].to_pylist():
        own = [keys[i : i + 16] in gone for i in range(0, len(keys), 16)]
        n = sum(own)
        marks.append(own if n else None)
        lost.append(n)
        count.append(len(own))
    return pa.table({"_id": lines["id"], "_content": lines["content"], "n_lines": pa.array(count, pa.int64()), "n_dropped": pa.array(lost, pa.int64()), "_marks": pa.array(marks, pa.list_(pa.bool_()))})


def dedup_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines (before), n_dropped, and the text that is left (`kept_text`)."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("content", F.unhex(F.sha2("text", 256)))
    kind = docs.schema["id"].dataType.simpleString()
    lines = materialise(docs.select("id", "text", "content").mapInArrow(_keyed(min_chars), f"block long, id {kind}, content binary, keys binary"), "lines")
    total = lines.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    shards = max(64, total // 16 // KEYS_PER_SHARD)
    sent = lines.select("block", "keys").mapInArrow(_sent(shards), "shard int, high long, low long, block long, docs long")
    index = materialise(sent.select("shard", "high", "low", "docs").groupBy("shard").applyInArrow(_built, _ARRAYS), "index")
    keys = sent.select("shard", "high", "low", "block")
    common = keys.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probed(min_docs), "block long, high long, low long")
    marks = (
        lines.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(_marked, f"_id {kind}, _content binary, n_lines long, n_dropped long, _marks array<boolean>")
    ).dropDuplicates(["_id", "_content"])
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.col("_marks")[i]), "\n")
    return docs.join(marks, same(docs, marks, {"id": "_id", "content": "_content"}), "left").select(
        F.col("id").alias(id_col), "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, left).otherwise(F.col("text")).alias("kept_text")
    )

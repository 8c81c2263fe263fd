"""Byte-level BPE encoding and decoding that reuses content-defined chunks.

1. A rolling hash over the bytes cuts each text into chunks whose borders depend on the content alone, so documents
   that share passages share chunks.  One pass names every chunk by 128 bits of hash; names that occur twice or more
   make a bitmap of bounded size.
2. Chunks in the bitmap are sent once a task and encoded once each.
3. Another pass encodes all other text where it stands, and leaves marks for the shared chunks.  Documents are dealt
   into blocks of about BLOCK_BYTES; each block asks once for each chunk that it holds, and puts its documents together.
4. A border may fall inside what the tokenizer takes as one piece, so each join is repaired: the text from the last two
   pieces before it on is encoded anew, together with more and more of what follows, until the new ids agree exactly
   with the ones at hand over a whole piece.  From there on the old ids hold, as the pattern never looks back.
   Ids say what their text is, so the repairs need no texts.

A full bitmap (too many shared chunks for its bound) makes every chunk a shared one: more is shuffled, nothing changes.
A chunk wanted by very many blocks is sent to them by a bounded broadcast.

The tokenizer file is a parameter.  Its special tokens, where they stand in a text, become their own ids, as
in the tokenizers library.  A null text counts as empty: no ids, decoded to "".  Repeated rows each give a
row.  Only the id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bounded_batches, in_bitmap, materialise, meet, share
from .kernels import mix, slices, text_bytes

#: The rolling hash looks at so many bytes, and cuts where its low bits are all ones; no chunk is longer than LONGEST.
ROLLING, MASK, LONGEST = 32, np.uint64(0x3FF), 16 << 10
#: Bytes of text that a block of documents holds, about.
BLOCK_BYTES = 1 << 20
#: Chunks wanted by this share of the blocks or more are broadcast: at most so many, of LONGEST bytes each.
OFTEN = 1000
#: The pattern that byte-level BPE splits texts by: a fixed value, published with its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids of a byte-level BPE vocabulary file, computed by its ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._ranks = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max([*ranks.values(), *special.values()]) + 1
        self.pieces = [b""] * size
        for t, i in ranks.items():
            self.pieces[i] = t
        for t, i in special.items():
            self.pieces[i] = t.encode()
        self.widths = np.array([len(p) for p in self.pieces])
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")  # what ids are kept as between the steps
        self.pattern = regex.compile(PATTERN)

    def plain(self, text: str) -> list[int]:
        """Ids of a text, special tokens taken as ordinary text."""
        return self._ranks.encode_ordinary(text)

    def starts(self, text: str) -> list[int]:
        """Where the pieces of a text start, in characters."""
        return [m.start() for m in self.pattern.finditer(text)]

    def decode(self, ids) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


def _whole(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions moved on to where a character starts; those at the end are left out."""
    at = at[at < len(raw)]
    inside = (raw[at] & 0xC0) == 0x80
    while inside.any():
        at = at + inside
        at = at[at < len(raw)]
        inside = (raw[at] & 0xC0) == 0x80
    return at


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where chunks start (never inside a character), each document's start included."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    gear = _GEAR[raw]
    h = gear.copy()  # h[i]: sum over the last ROLLING bytes, each rotated by its distance, by doubling
    step = 1
    while step < ROLLING:
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    at = np.flatnonzero((mix(h) & MASK) == MASK) + 1
    at = at[at - offsets[np.searchsorted(offsets, at, "left") - 1] >= ROLLING]  # not where the text before reaches in
    at = np.unique(np.concatenate([_whole(raw, at), offsets[:-1][np.diff(offsets) > 0]]))
    long = np.diff(np.append(at, n)) // LONGEST
    if long.any():
        more = np.repeat(at, long) + LONGEST * (np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + 1)
        at = np.unique(np.concatenate([at, _whole(raw, more)]))
    return at


def chunks(coder: Tokenizer, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, kind) of every chunk: kind -1 for text, -2 for text before which a join is none (a document's
    start, and what follows a special token), else the id of the special token that it is."""
    at = cuts(raw, offsets)
    end = np.append(at[1:], len(raw))
    doc = np.searchsorted(offsets, at, "right") - 1
    kind = np.where(at == offsets[doc], -2, -1)
    text = raw.tobytes() if coder.special else b""
    if any(t.encode() in text for t in coder.special):
        known = {t.encode(): i for t, i in coder.special.items()}
        spots = [(m.start(), m.end(), known[m[0]]) for m in re.finditer(b"|".join(map(re.escape, known)), text)]
        own = np.searchsorted(offsets, [s for s, _, _ in spots], "right") - 1
        spots = [x for x, d in zip(spots, own) if x[1] <= offsets[d + 1]]
        edges = {s: i for s, _, i in spots}
        after = {e for _, e, _ in spots}
        inside = np.zeros(len(raw) + 1, bool)
        for s, e, _ in spots:
            inside[s + 1 : e] = True
        at = np.unique(np.concatenate([at[~inside[at]], [s for s, _, _ in spots], [e for _, e, _ in spots if e < len(raw)]])).astype(np.int64)
        end = np.append(at[1:], len(raw))
        doc = np.searchsorted(offsets, at, "right") - 1
        kind = np.array([edges.get(int(a), -2 if int(a) in after or a == offsets[d] else -1) for a, d in zip(at, doc)], np.int64)
    return at, end, doc, kind


def names(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each chunk's 128-bit name."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(start.tolist(), end.tolist())]), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].view(np.int64) if len(both) else np.zeros(0, np.int64), np.ascontiguousarray(both[:, 1]).view(np.int64)


class Part:
    """A stretch of text by its ids, encoded on its own."""

    def __init__(self, coder: Tokenizer, ids: np.ndarray):
        self.coder, self.ids = coder, ids
        self.ends = np.cumsum(coder.widths[ids])  # bytes up to each id's end

    def raw(self, a: int, z: int) -> bytes:
        return self.coder.decode(self.ids[a:z].tolist())

    def at(self, width: int) -> int:
        """How many ids cover the first `width` bytes; -1 if no id ends there."""
        if not width:
            return 0
        k = int(np.searchsorted(self.ends, width))
        return k + 1 if self.ends[k] == width else -1

    def last_pieces(self) -> int:
        """How many ids stand before the last two pieces of the text: what follows may still change these (as in 'l + l)."""
        n, take = len(self.ids), 24
        while True:
            low = max(0, n - take)
            raw = self.raw(low, n)
            skip = next((k for k in range(min(4, len(raw))) if raw[k] & 0xC0 != 0x80), 0)
            text = raw[skip:].decode("utf-8")
            begin = 0
            if low:  # behind visible ASCII, ASCII white space always starts a piece
                begin = next((m.end() for m in _SYNC.finditer(text)), -1)
            if begin >= 0:
                base = (int(self.ends[low - 1]) if low else 0) + skip
                for s in reversed(self.coder.starts(text[begin:])[:-1]):
                    k = self.at(base + len(text[: begin + s].encode()))
                    if k >= 0:
                        return k
            if not low:
                return 0
            take *= 4


_SYNC = re.compile("[!-~](?=[ \t\n\x0b\x0c\r])")


class Joiner:
    """Puts the parts of one text together, with the joins repaired."""

    def __init__(self, coder: Tokenizer):
        self.coder = coder
        self.out: list[np.ndarray] = []
        self.open = ""  # the last two pieces of the text so far, which what follows may change

    def settle(self) -> None:
        if self.open:
            self.out.append(np.array(self.coder.plain(self.open), np.uint32))
            self.open = ""

    def special(self, i: int) -> None:
        self.settle()
        self.out.append(np.array([i], np.uint32))

    def add(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        part = Part(self.coder, ids)
        held = self.joined(part) if self.open else 0
        if held < 0:
            return
        last = max(held, part.last_pieces())
        self.out.append(ids[held:last])
        self.open = part.raw(last, len(ids)).decode("utf-8")

    def joined(self, part: Part) -> int:
        """Encodes the open text with more and more of the part, until the ids agree; how many of its ids are passed by then.

        -1: they never do; then all of the part is put behind the open text, and all but the last pieces of that are settled.
        """
        coder, n, take = self.coder, len(part.ids), 12
        while True:
            take = min(take, n)
            raw = part.raw(0, take)
            text = raw.decode("utf-8", "ignore") if take < n else raw.decode("utf-8")  # a character may be cut at the end
            own, new = coder.starts(text)[:-1], coder.starts(self.open + text)[:-1]  # the last pieces may change
            both = sorted(set(own) & {s - len(self.open) for s in new})
            for b, c in zip(both, both[1:]):
                low, high = (part.at(len(text[:x].encode())) for x in (b, c))
                if low >= 0 and high >= 0:
                    again = np.array(coder.plain(self.open + text[:c]), np.uint32)
                    if np.array_equal(again[len(again) - (high - low) :], part.ids[low:high]):
                        self.out.append(again)
                        self.open = ""
                        return high
            if take == n:
                whole = self.open + text
                at = [0, *coder.starts(whole)[1:-1]]
                for a, z in zip(at, at[1:]):  # one by one: white space at the end of a text makes other pieces
                    self.out.append(np.array(coder.plain(whole[a:z]), np.uint32))
                self.open = whole[at[-1] :]
                return -1
            take *= 4

    def ids(self) -> np.ndarray:
        self.settle()
        return np.concatenate(self.out) if self.out else np.zeros(0, np.uint32)


_coders: dict[str, Tokenizer] = {}


def coder_of(path: str) -> Tokenizer:
    """This worker's tokenizer of a file."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = Tokenizer(path)
    return _coders[path]


def _cut(coder: Tokenizer, text: pa.Array) -> Iterator[tuple]:
    """(first document, end, bytes, chunks, names of chunks) of a batch, a few documents at a time."""
    raw, offsets = text_bytes(text)
    for lo, hi in slices(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end, doc, kind = chunks(coder, part, own)
        held = part.tobytes()
        yield lo, hi, held, start, end, doc, kind, *names(held, start, end)


def _named(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(1).to_numpy()
            for lo, _, _, start, end, doc, kind, high, low in _cut(coder_of(path), b.column(0)):
                text = kind < 0
                yield pa.RecordBatch.from_arrays([pa.array(x[text]) for x in (h[lo + doc], high, low, end - start)], ["h", "high", "low", "size"])

    return run


def _wanted(marks, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, high, low = (b.column(k).to_numpy() for k in range(3))
            keep = in_bitmap(marks.value, high)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.mod(h, blocks), high, low)], ["block", "high", "low"])

    return run


def _sent(path: str, marks):
    """Rows (high, low, chunk) of the shared chunks, each once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, raw, start, end, _, kind, high, low in _cut(coder_of(path), b.column(0)):
                own = np.flatnonzero((kind < 0) & in_bitmap(marks.value, high))
                own = own[np.unique(np.stack([high[own], low[own]], 1), axis=0, return_index=True)[1]] if len(own) else own
                yield pa.RecordBatch.from_arrays([pa.array(high[own]), pa.array(low[own]), pa.array([raw[start[i] : end[i]] for i in own], pa.binary())], ["high", "low", "chunk"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for b in batches:
            ids = [np.array(coder.plain(c.decode("utf-8")), coder.kind).tobytes() for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["high", "low", "ids"])

    return run


_PARTS = "array<struct<kind: int, high: long, low: long, ids: binary>>"
_PART = pa.list_(pa.struct([("kind", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("ids", pa.binary())]))


def _parted(path: str, marks, blocks: int):
    """Rows (block, id, parts): of each document the text that it has for itself as ids, and marks of shared chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for b in batches:
            h = b.column(2).to_numpy()
            for lo, hi, raw, start, end, doc, kind, high, low in _cut(coder, b.column(1)):
                shared = (kind < 0) & in_bitmap(marks.value, high)
                parts: list[list] = [[] for _ in range(hi - lo)]
                i, n = 0, len(start)
                while i < n:
                    z = i + 1
                    if kind[i] < 0 and not shared[i]:
                        while z < n and kind[z] == -1 and not shared[z]:
                            z += 1
                        ids = np.array(coder.plain(raw[start[i] : end[z - 1]].decode("utf-8")), coder.kind).tobytes()
                        parts[doc[i]].append((int(kind[i]), None, None, ids))
                    else:
                        parts[doc[i]].append((int(kind[i]), int(high[i]), int(low[i]), None))
                    i = z
                yield pa.RecordBatch.from_arrays([pa.array(np.mod(h[lo:hi], blocks)), b.column(0).slice(lo, hi - lo), pa.array(parts, _PART)], ["block", "id", "parts"])

    return run


def _assembled(path: str):
    def run(documents: pa.Table, known: pa.Table) -> pa.Table:
        coder = coder_of(path)
        ids_of = {k[:2]: np.frombuffer(k[2], coder.kind) for k in zip(*(known[c].to_pylist() for c in ("high", "low", "ids")))}
        ids, texts = [], []
        for parts in documents["parts"].to_pylist():
            text = Joiner(coder)
            for p in parts:
                if p["kind"] >= 0:
                    text.special(p["kind"])
                    continue
                if p["kind"] == -2:
                    text.settle()
                text.add((ids_of[p["high"], p["low"]] if p["ids"] is None else np.frombuffer(p["ids"], coder.kind)).astype(np.uint32))
            own = text.ids()
            ids.append(own.astype("<u4").tobytes())
            texts.append(coder.decode(own.tolist()).decode("utf-8", "replace"))
        return pa.table({"id": documents["id"], "ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())})

    return run


def encode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (binary: little-endian unsigned 32-bit) and the text decoded from them."""
    spark = documents.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("h"))
    kind = docs.schema["id"].dataType.simpleString()
    named = materialise(docs.select("text", "h").mapInArrow(_named(tokenizer), "h long, high long, low long, size long"), "named")
    blocks = max(1, (named.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES)
    marks = share(spark, bitmap(named.groupBy("high", "low").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("high").alias("h"))))
    sent = docs.select("text").mapInArrow(_sent(tokenizer, marks), "high long, low long, chunk binary").dropDuplicates(["high", "low"])
    coded = sent.mapInArrow(_encoded(tokenizer), "high long, low long, ids binary")
    wanted = materialise(named.mapInArrow(_wanted(marks, blocks), "block long, high long, low long").distinct(), "wanted")
    copies = wanted.groupBy("high", "low").agg(F.count("*").alias("copies"))
    coded = materialise(coded.join(copies, ["high", "low"]), "coded")
    answers = meet(wanted, coded, ["high", "low"], most=OFTEN).select("block", "high", "low", "ids")
    parted = docs.mapInArrow(_parted(tokenizer, marks, blocks), f"block long, id {kind}, parts {_PARTS}")
    out = parted.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assembled(tokenizer), f"id {kind}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)

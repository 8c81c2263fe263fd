"""Benchmark decontamination with suffix arrays over the training text.

The training text is cut into shards of a few megabytes inside the tasks.  A shard's words become numbers of
the benchmark's vocabulary (0: a word that no benchmark item has, which also ends every document), and its
suffixes are sorted by their first words.  Every benchmark suffix is then binary-searched in every shard; the
range it finds holds all places where a window of the item stands verbatim, and runs of such places are the
longest verbatim matches.  A bucket table over the leading words of a shard's suffixes says first for which benchmark
suffixes that range is empty, so the search itself is for those whose leading words stand in the shard (collisions
of buckets only add searches).  Suffixes that meet a 0 before the shortest window ends can't hold a window and are
left out of the array, which changes no result.

The documents are read in one pass without a shuffle.  The benchmark is broadcast; one of more than PART_BYTES of
text in parts of about that size, one after the other: each part is a job of its own, whose findings (only of texts
with a hit) are written to the shared folder before its broadcast is given up.  So the driver, the executors and
each task hold one part at a time, for a benchmark of any size.  The parts' findings of a text are put together at the end.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window.  Null or empty texts have no words, no
windows and no hits.  Repeated items count each; items with a null id can hit words but are not listed.  Only
the texts are read; other columns are handed on whatever their names (`search` replaces those that have the names of
its results).  An empty benchmark hits nothing and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, same, share
from .kernels import ALNUM_WORDS, mix, slices, text_bytes, words

#: Most bytes of benchmark text that are broadcast at once.
PART_BYTES = 8 << 20
#: Buckets of a shard's table over the leading words of its suffixes.
BUCKETS = 1 << 22


def _bucket(leading: np.ndarray) -> np.ndarray:
    return (mix(leading.astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Windows:
    """The windows of some benchmark items as word numbers, ready for searching."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        raw, offsets = text_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
        w = words(raw, offsets, ALNUM_WORDS)
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(w.hash)
        self.base = len(self.vocabulary) + 2  # 0 ends a document, the last number stands above every word
        per = max(1, int(63 // np.log2(self.base)))  # words in one 64-bit key
        size = np.diff(w.first)
        self.length_of = np.minimum(size, window)
        number = np.searchsorted(self.vocabulary, w.hash) + 1
        starts, item = [], []
        for i in range(len(items)):
            if size[i]:
                own = np.arange(w.first[i], w.first[i + 1] - self.length_of[i] + 1)
                starts.append(own)
                item.append(np.full(len(own), i))
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.length = self.length_of[self.item] if len(self.item) else np.zeros(0, np.int64)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        self.depth = -(-window // per)
        self.per = per
        padded = np.concatenate([number, np.zeros(window + per, np.int64)])
        low, high = [], []
        for k in range(self.depth):
            a = np.zeros(len(self.start), np.int64)
            z = np.zeros(len(self.start), np.int64)
            for j in range(k * per, (k + 1) * per):
                inside = j < self.length
                a = a * self.base + np.where(inside, padded[self.start + j], 0)
                z = z * self.base + np.where(inside, padded[self.start + j], self.base - 1)
            low.append(a)
            high.append(z)
        self.low, self.high = low, high
        self.bucket = np.where(low[0] == high[0], _bucket(low[0]), BUCKETS)  # the last one: too short to have one bucket

    def find(self, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (word position, window) with the window at that position of the documents (hashes, words each)."""
        n = len(hashes)
        none = np.zeros(0, np.int64)
        if not n or not len(self.start):
            return none, none
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        number = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        pad = self.depth * self.per + 1
        left = np.minimum(np.repeat(np.cumsum(size), size) - np.arange(n), pad)  # words up to the document's end
        known = number > 0
        upto = np.concatenate([np.flatnonzero(~known), [n]])
        reach = np.minimum(left, upto[np.searchsorted(upto, np.arange(n))] - np.arange(n))
        suffix = np.flatnonzero(reach >= self.shortest)
        if not len(suffix):
            return none, none
        padded = np.concatenate([number, np.zeros(pad, np.int64)])
        keys = []
        for k in range(self.depth):
            key = np.zeros(len(suffix), np.int64)
            for j in range(k * self.per, (k + 1) * self.per):
                key = key * self.base + np.where(left[suffix] > j, padded[suffix + j], 0)
            keys.append(key)
        filled = np.zeros(BUCKETS + 1, bool)
        filled[_bucket(keys[0])] = filled[BUCKETS] = True
        asked = np.flatnonzero(filled[self.bucket])
        if not len(asked):
            return none, none
        order = np.lexsort(keys[::-1])
        suffix, keys = suffix[order], [k[order] for k in keys]
        first, last = _bound(keys, [x[asked] for x in self.low], False), _bound(keys, [x[asked] for x in self.high], True)
        many = np.maximum(last - first, 0)
        found = np.flatnonzero(many)
        many = many[found]
        window = np.repeat(asked[found], many)
        place = np.repeat(first[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return suffix[place], window


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once in the sorted suffixes: the first place not below (or above)."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(keys[0]), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less = np.zeros(len(open_), bool)
        equal = np.ones(len(open_), bool)
        for have, want in zip(keys, wanted):
            h, w = have[middle], want[open_]
            less |= equal & (h < w)
            equal &= h == w
        if after:
            less |= equal
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def _found(windows: Windows, text: pa.Array) -> dict[str, list]:
    """n_words, hits (a bit per word), items, longest, longest_item and longest_at of each text; null: none."""
    n = len(text)
    out = {k: [None] * n for k in ("hits", "items", "longest", "longest_item", "longest_at")}
    raw, offsets = text_bytes(text)
    n_words = np.zeros(n, np.int64)
    for lo, hi in slices(offsets):
        w = words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM_WORDS)
        size = np.diff(w.first)
        n_words[lo:hi] = size
        place, window = windows.find(w.hash, size)
        if not len(place):
            continue
        doc = w.doc[place]
        item = windows.item[window]
        order = np.lexsort((place, place - windows.start[window], item, doc))
        place, window, doc, item = place[order], window[order], doc[order], item[order]
        length = windows.length[window]
        cut = np.ones(len(place), bool)
        cut[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(place - windows.start[window]) != 0) | (np.diff(place) != 1)
        runs = np.flatnonzero(cut)
        ends = np.append(runs[1:], len(place)) - 1
        run_doc, run_at, run_item = doc[runs], place[runs], item[runs]
        run_length = place[ends] + length[ends] - run_at
        for d in np.unique(run_doc):
            mine = slice(*np.searchsorted(run_doc, [d, d + 1]))
            at, long, which = run_at[mine] - w.first[d], run_length[mine], run_item[mine]
            mark = np.zeros(size[d] + 1, np.int64)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + long, -1)
            best = np.lexsort((at, -long))[0]
            out["hits"][lo + d] = np.packbits(np.cumsum(mark)[:-1] > 0).tobytes()
            out["items"][lo + d] = sorted({windows.ids[k] for k in which.tolist()} - {None})
            out["longest"][lo + d], out["longest_item"][lo + d], out["longest_at"][lo + d] = int(long[best]), windows.ids[which[best]], int(at[best])
    return {"n_words": n_words.tolist()} | out


_NAMES = ["_n_words", "_hits", "_items", "_longest", "_longest_item", "_longest_at"]


def _kind(item: str) -> str:
    return f"struct<_n_words: long, _hits: binary, _items: array<{item}>, _longest: long, _longest_item: {item}, _longest_at: long>"


def _column(windows, kind: str, text: Column) -> Column:
    """What `_found` says of the text, as a struct."""
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
    if "string" in kind:
        types[2], types[4] = pa.list_(pa.string()), pa.string()

    def run(text: pa.Array) -> pa.Array:
        found = _found(windows.value, text)
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types)], _NAMES)

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _kind(kind))(text)


def _together(found: DataFrame, kind: str) -> DataFrame:
    """One row per digest: the findings of all parts of the benchmark in one, the bits of the hits joined."""

    def run(parts: pa.Array) -> pa.Array:
        out = []
        for own in parts.to_pylist():
            bits = np.bitwise_or.reduce([np.frombuffer(x["_hits"], np.uint8) for x in own])
            best = min(own, key=lambda x: (-x["_longest"], x["_longest_at"], str(x["_longest_item"])))
            out.append(best | {"_hits": bits.tobytes(), "_items": sorted({i for x in own for i in x["_items"]})})
        return pa.array(out, parts.type.value_type)

    run.__annotations__ = {"parts": pa.Array, "return": pa.Array}
    return found.groupBy("_digest").agg(F.collect_list("_found").alias("p")).select("_digest", F.arrow_udf(run, _kind(kind))("p").alias("_found"))


def _parts(benchmark: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, str, int]:
    """The items (id: long or string), the kind of their ids, and how many parts they make."""
    kind = "long" if dict(benchmark.dtypes)[item_col] in ("tinyint", "smallint", "int", "bigint") else "string"
    items = benchmark.select(F.col(item_col).cast(kind).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, kind, 1 if total <= PART_BYTES else -(-2 * total // PART_BYTES)


def search(documents: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with the columns _n_words, _hits (bit per word; null: none), _items, _longest, _longest_item, _longest_at."""
    spark = documents.sparkSession
    bounded_batches(spark)
    items, kind, parts = _parts(benchmark, item_col, item_text)
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in _NAMES]
    if parts == 1:
        windows = share(spark, Windows([tuple(r) for r in items.collect()], window))
        rows = documents.select(F.struct(*rest).alias("_row"), _column(windows, kind, F.col(text_col)).alias("_found"))
        return rows.select("_row.*", "_found.*")
    # A result depends on the text alone, so the parts' findings go by the texts' digests.
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    findings = None
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], window))
        own = documents.select(digest.alias("_digest"), _column(windows, kind, F.col(text_col)).alias("_found"))
        own = materialise(own.filter("_found._hits IS NOT NULL").dropDuplicates(["_digest"]), "part")
        windows.destroy()
        findings = own if findings is None else findings.unionByName(own)
    none = Windows([], window)
    count = _column(share(spark, none), kind, F.col(text_col))
    rows = documents.select(F.struct(*rest).alias("_row"), digest.alias("_own"), count.alias("_none"))
    found = _together(findings, kind)
    joined = rows.join(found, same(rows, found, {"_own": "_digest"}), "left")
    return joined.select("_row.*", F.col("_none._n_words").alias("_n_words"), *[F.col(f"_found.{c}").alias(c) for c in _NAMES[1:]])


def hit_words(hits: Column) -> Column:
    """How many words are hit, counted from the bits of _hits (null: none)."""
    ones = F.translate(F.hex(hits), "0123456789ABCDEF", "0112122312232334")  # bits set in each hexadecimal digit
    count = lambda d: F.length(ones) - F.length(F.replace(ones, F.lit(str(d)), F.lit("")))
    return F.coalesce(count(1) + 2 * count(2) + 3 * count(3) + 4 * count(4), F.lit(0)).cast("long")


def remove(documents: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    items, kind, parts = _parts(benchmark, item_col, item_text)
    if parts == 1:
        bounded_batches(documents.sparkSession)
        windows = share(documents.sparkSession, Windows([tuple(r) for r in items.collect()], window))
        return documents.filter(_column(windows, kind, F.col(text_col))["_hits"].isNull())
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(text_col).alias("text"))
    return search(rows, benchmark, window, "text", item_col, item_text).filter("_hits IS NULL").select("row.*")

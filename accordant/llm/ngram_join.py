"""N-gram Jaccard join by grouped prefixes: which documents are linked, and their components.

Documents with the same shingle set form one class, named by 96 bits of digest of the set and its size; the join works
on one representative of each class.

1. A pass over the texts gives each document's set size and digest, and each task's frequent shingles.  The
   frequent shingles (at most FREQUENT, by count) only order the sets: they come last.  Any order gives the
   same links; a good one keeps the lists below short.
2. A set's prefix is its first n - ceil(t n) + 1 shingles: two sets with Jaccard similarity t or more share a
   prefix shingle.  Classes with identical prefixes and sizes are collapsed into one group, and only groups
   meet.  A list is cut into bands of set sizes, two bands apart of which can't link.  In short bands (up to
   SHORT_LIST groups) and between neighbouring ones groups meet as pairs that pass the filters of size, of position
   and of how many prefix shingles they share;
   in a long band as a chain through its smallest group, so a band of n groups never makes n*n rows.
3. Groups that meet, directly or not, are one family.  A family's groups are expanded to their members, whose
   whole sets go once to the task that verifies the family: exact intersection sizes by an inverted list over
   the family's shingles, one member against all.  A family above UNIT_SHINGLES is cut into blocks by set size
   and hash, and each pair of blocks whose sizes can link is a task of its own.
4. The links found (a forest of each task's) are joined to components.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased.  A text of fewer words than k is one shingle; a text without
words (or null) has no shingle and is linked with nothing.  Shingles are compared by 64-bit hashes, classes by 96
bits.  Repeated rows are one class and get a row each.  A null id sorts last and names a component only if all its
ids are null.  Only ids and texts are read, and `keep_one` hands other columns on whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, bounded_batches, components, in_bitmap, keep_marked, materialise, meet, row_key, share
from .kernels import BLANK_WORDS, binary_column, mix, shingles, slices, text_bytes, words

#: Most shingles whose frequency orders the sets (16 bytes each in every task), and the count in one task from
#: which a shingle is told.
FREQUENT, TOLD_FROM = 200_000, 4
#: Groups in a band of a list whose pairs are made one by one.
SHORT_LIST = 64
#: Shingles that one verifying task holds, about.
UNIT_SHINGLES = 2_000_000


def _sets(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, sorted distinct shingles, where each document's begin) for slices of a batch."""
    raw, offsets = text_bytes(text)
    for lo, hi in slices(offsets):
        h, d = shingles(words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], BLANK_WORDS), k)
        first = np.searchsorted(d, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            h[first[i] : first[i + 1]].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[keep], d[keep]
        yield lo, hi, h, np.searchsorted(d, np.arange(hi - lo + 1))


def _digest(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and another 32-bit digest of each set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x51ED270B, 0xA24BAED4)]
    size = np.diff(first).astype(np.uint64)
    one, two = (mix((s[first[1:]] - s[first[:-1]]) ^ (size * np.uint64(0x9E3779B97F4A7C15))) for s in sums)
    return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _described(k: int):
    """Rows (_id, _h, _g, size, class, check, shingle, count): of documents (count null) and of frequent shingles (size null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, int] = {}
        held, n_held, kind = [], 0, None
        names = ["_id", "_h", "_g", "size", "class", "check", "shingle", "count"]

        def count(hashes: list[np.ndarray]) -> None:
            u, c = np.unique(np.concatenate(hashes), return_counts=True)
            for s, n in zip(u[c >= TOLD_FROM].tolist(), c[c >= TOLD_FROM].tolist()):
                told[s] = told.get(s, 0) + n
            if len(told) > 2 * FREQUENT:  # keep the most frequent: only the order depends on it
                for s, _ in sorted(told.items(), key=lambda x: x[1])[: len(told) - FREQUENT]:
                    del told[s]

        for b in batches:
            size, one, two = (np.zeros(b.num_rows, t) for t in (np.int64, np.int64, np.int32))
            for lo, hi, h, first in _sets(b.column(3), k):
                size[lo:hi] = np.diff(first)
                one[lo:hi], two[lo:hi] = _digest(h, first)
                held.append(h)
                n_held += len(h)
                if n_held > 4_000_000:
                    count(held)
                    held, n_held = [], 0
            none = pa.nulls(b.num_rows, pa.int64())
            kind = b.schema.field(0).type
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(size), pa.array(one), pa.array(two), none, none], names)
        if held:
            count(held)
        if told:
            none, no_check = pa.nulls(len(told), pa.int64()), pa.nulls(len(told), pa.int32())
            s, c = np.array(list(told), np.uint64).view(np.int64), np.array(list(told.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(told), kind), none, none, none, none, no_check, pa.array(s), pa.array(c)], names)

    return run


def _prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size + (-percent * size // 100) + 1


class _Order:
    """The shared order of shingles: rare ones by hash, then frequent ones by rising count."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray):
        order = np.argsort(shingle)
        self.shingle, self.count = shingle[order], count[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[shingle & np.uint64((1 << 22) - 1)] = True

    def counts(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if len(self.shingle):
            maybe = np.flatnonzero(self.bits[h & np.uint64((1 << 22) - 1)])
            at = np.searchsorted(self.shingle, h[maybe])
            at[at == len(self.shingle)] = 0
            out[maybe] = np.where(self.shingle[at] == h[maybe], self.count[at], 0)
        return out


def _prefixed(k: int, percent: int, order):
    """Rows (shingle, grp, at, size, class, check) of every class that the task has not met yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Order = order.value
        met: set[tuple[int, int]] = set()
        for b in batches:
            for _, _, h, first in _sets(b.column(0), k):
                name, check = _digest(h, first)
                size = np.diff(first)
                doc = np.repeat(np.arange(len(size)), size)
                count = known.counts(h)
                rare = count == 0
                before = np.cumsum(rare) - rare
                at = before - before[first[:-1][doc]] if len(h) else before
                length = _prefix_length(size, percent)
                keep = rare & (at < length[doc])
                some = np.add.reduceat(rare, first[:-1][size > 0]) if (size > 0).any() else np.zeros(0, np.int64)
                rares = np.zeros(len(size), np.int64)
                rares[size > 0] = some
                for i in np.flatnonzero((rares < length) & (size > 0)):  # the rest of the prefix from the frequent ones
                    own = np.arange(first[i], first[i + 1])[~rare[first[i] : first[i + 1]]]
                    own = own[np.lexsort((h[own], count[own]))][: length[i] - rares[i]]
                    keep[own] = True
                    at[own] = rares[i] + np.arange(len(own))
                fresh = np.zeros(len(size), bool)
                for i in range(len(size)):
                    if size[i] and (c := (int(name[i]), int(check[i]))) not in met:
                        met.add(c)
                        fresh[i] = True
                keep &= fresh[doc]
                own = np.flatnonzero(keep)
                total = np.zeros(len(size), np.uint64)
                np.add.at(total, doc[own], mix(h[own]))
                grp = mix(total ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h[own].view(np.int64), grp[doc[own]], at[own].astype(np.int64), size[doc[own]], name[doc[own]], check[doc[own]])], ["shingle", "grp", "at", "size", "class", "check"]
                )

    return run


def _whole(k: int, marks):
    """Rows (class, check, size, shingles) of the texts whose mark is set, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for b in batches:
            set_ = pa.array(in_bitmap(marks.value, b.column(1).to_numpy()))
            for _, _, h, first in _sets(b.column(0).filter(set_), k):
                one, two = _digest(h, first)
                fresh = np.zeros(len(one), bool)
                for i, c in enumerate(zip(one.tolist(), two.tolist())):
                    if c not in met:
                        met.add(c)
                        fresh[i] = True
                h = h[np.repeat(fresh, np.diff(first))]
                one, two, first = one[fresh], two[fresh], np.concatenate([[0], np.cumsum(np.diff(first)[fresh])])
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.diff(first)), binary_column(h, first[1:])], ["class", "check", "size", "shingles"])

    return run


def links(name: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members whose sets reach the similarity, one member against all the later ones at a time.

    side: block of each member; with two blocks only pairs across them count.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    name, sets = name[order], [sets[i] for i in order]
    side = None if side is None else side[order]
    size = np.array([len(s) for s in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    doc = np.repeat(np.arange(len(sets)), size)
    first = np.concatenate([[0], np.cumsum(size)])
    by = np.argsort(token, kind="stable")
    posting = doc[by]
    begin = np.concatenate([[0], np.cumsum(np.bincount(token))])
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    src, dst = [], []
    up = np.arange(len(sets))
    for i in range(len(sets)):
        own = slice(first[i], first[i + 1])
        low, high = place[own] + 1, begin[token[own] + 1]  # members after i in each list
        many = high - low
        use = many > 0
        low, many = low[use], many[use]
        if not len(low):
            continue
        at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        both = np.bincount(posting[at], minlength=len(sets))
        j = np.flatnonzero(both)
        ok = 100 * both[j] >= percent * (size[i] + size[j] - both[j])
        if side is not None:
            ok &= side[j] != side[i]
        j = j[ok]
        j = j[up[j] != up[i]]
        for k in j:  # only links that join two parts
            if up[k] != up[i]:
                src.append(name[i])
                dst.append(name[k])
                up[up == up[k]] = up[i]
    return np.array(src, np.int64), np.array(dst, np.int64)


def _verified(percent: int):
    def run(unit: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"].to_pylist()]
        block = unit["block"].to_numpy()
        src, dst = links(unit["node"].to_numpy(), sets, percent, block if len(np.unique(block)) > 1 else None)
        return pa.table({"src": pa.array(src), "dst": pa.array(dst)})

    return run


def _grouped(documents: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: row, _id, _h, _g, size and, of its component, the best (none, id, row); null without words."""
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()
    both = docs.mapInArrow(_described(k), f"_id {kind}, _h long, _g long, size long, class long, check int, shingle long, count long")
    both = materialise(both.withColumn("row", F.monotonically_increasing_id()), "described")
    described = both.filter("size IS NOT NULL").drop("shingle", "count")
    frequent = both.filter("size IS NULL").groupBy("shingle").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "shingle").limit(FREQUENT).toPandas()
    order = share(spark, _Order(frequent["shingle"].to_numpy(np.int64).view(np.uint64), frequent["count"].to_numpy(np.int64)))

    entries = docs.select("text").mapInArrow(_prefixed(k, percent, order), "shingle long, grp long, at long, size long, class long, check int")
    # A list of one entry is of no further use; tasks may have met the same class, so entries count once.
    listed = Window.partitionBy("shingle")
    several = entries.withColumn("n", F.count("*").over(listed)).filter("n > 1").drop("n").distinct()
    band = F.floor(-F.ln("size") / F.ln(F.lit(percent / 100 - 0.005))).cast("long")
    counted = several.withColumns({"n": F.count("*").over(listed), "band": band}).filter("n > 1").drop("n")
    own = Window.partitionBy("shingle", "band")
    lists = materialise(counted.withColumns({"m": F.count("*").over(own), "least": F.min("grp").over(own), "low": F.min("size").over(own), "high": F.max("size").over(own)}), "lists")
    short = lists.filter(f"m <= {SHORT_LIST}").select("shingle", "band", "grp", "at", "size").distinct()
    other = short.select("shingle", F.explode(F.array("band", F.col("band") - 1)).alias("band"), *[F.col(c).alias(f"{c}_2") for c in ("band", "grp", "at", "size")])
    need = f"(({percent} * (size + size_2) + {99 + percent}) div {100 + percent})"
    # What two sets share stands in both prefixes, or all beyond the prefix that ends first.  Where no long band has
    # both, the shared part of the prefixes is counted whole, and with what is beyond them bounds the intersection.
    beyond = f"(({percent} * greatest(size, size_2) + 99) div 100 - 1)"
    pairs = (
        short.join(other, ["shingle", "band"])
        .filter(f"(band <> band_2 OR grp < grp_2) AND grp <> grp_2 AND 100 * least(size, size_2) >= {percent} * greatest(size, size_2)")
        .groupBy("grp", "grp_2", "size", "size_2")
        .agg(F.count("*").alias("both"), F.min("at").alias("at"), F.min("at_2").alias("at_2"))
        .filter(f"both + {beyond} >= {need} AND least(size - at, size_2 - at_2) >= {need}")
        .select("grp", "grp_2")
    )
    # A long part of a list is chained through its smallest group, and so are the groups of the bands beside it
    # that are of a size to link with one of the part.
    long = lists.filter(f"m > {SHORT_LIST}").select("shingle", "band", "least", "low", "high").distinct()
    beside = lists.select("shingle", "grp", "size", F.explode(F.array("band", F.col("band") - 1, F.col("band") + 1)).alias("band"))
    chains = beside.join(long, ["shingle", "band"]).filter(f"100 * high >= {percent} * size AND 100 * size >= {percent} * low").select("grp", F.col("least").alias("grp_2"))
    named = F.struct("class", "check")
    twins = lists.groupBy("grp").agg(F.min(named).alias("c"), F.max(named).alias("d")).filter("c <> d").select("grp", F.col("grp").alias("grp_2"))
    family = components(pairs.union(chains).union(twins).distinct().toDF("src", "dst"))

    # Members: the classes of each family's groups, numbered, as two digests don't fit in one number.
    classes = described.filter("size > 0").groupBy("class", "check").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "row")).alias("best"), F.min_by("_h", "row").alias("h"), F.count("*").alias("copies"))
    member = lists.select("grp", "class", "check").distinct().join(family.withColumnRenamed("node", "grp"), "grp").select("class", "check", F.col("root").alias("family"))
    member = materialise(member.distinct().join(classes, ["class", "check"]).withColumn("node", F.monotonically_increasing_id()), "members")
    # Texts stay where they are: a bitmap picks one row of each class in the scan, and what it lets through besides
    # goes in the join with the members.
    marks = share(spark, bitmap(member.select("h")))
    sets = docs.select("text", "_h").mapInArrow(_whole(k, marks), "class long, check int, size long, shingles binary")
    sets = sets.join(member.select("class", "check", "family", "node"), ["class", "check"]).dropDuplicates(["class", "check"])
    sets = materialise(sets.select("node", "family", "size", "shingles"), "sets")

    # Blocks: a band of set sizes (sizes two bands apart can't link), cut by hash where a band is large.
    sized = sets.select("node", "family", "size", band.alias("band"))
    total = sized.groupBy("family").agg(F.sum("size").alias("whole"))
    parts = sized.groupBy("family", "band").agg(F.ceil(F.sum("size") / (UNIT_SHINGLES // 2)).cast("long").alias("cut"))
    parts = parts.join(total, "family").filter(f"whole > {UNIT_SHINGLES}")
    near = parts.select("family", F.col("band").alias("band_2"), F.col("cut").alias("cut_2"))
    plan = parts.select("family", "band", "cut").join(near, "family").filter("abs(band - band_2) <= 1")
    placed = sets.withColumn("band", band).join(plan, ["family", "band"], "left")
    sub = F.pmod(F.xxhash64("node"), F.col("cut"))
    block = F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.col("band") * 1_000_000 + sub)
    against = F.when(F.col("cut").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("cut_2") - 1), lambda s: F.col("band_2") * 1_000_000 + s))
    units = (
        placed.select("family", "node", "shingles", block.cast("long").alias("block"), F.explode(against).alias("with"))
        .withColumns({"a": F.least("block", "with"), "z": F.greatest("block", "with")})
        .select("family", "a", "z", "node", "shingles", "block")
    )
    linked = units.groupBy("family", "a", "z").applyInArrow(_verified(percent), "src long, dst long")
    part = components(linked).join(member.select("node", "class", "check", "best"), "node")
    joined = part.withColumn("smallest", F.min("best").over(Window.partitionBy("root"))).select("class", "check", "smallest")
    by_class = classes.join(joined, ["class", "check"], "left").select("class", "check", "copies", F.coalesce("smallest", "best").alias("best"))
    found = meet(described.filter("size > 0"), materialise(by_class, "classes"), ["class", "check"]).drop("copies")
    return found.unionByName(described.filter("size = 0"), allowMissingColumns=True)


def similar(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id that links reach (its own included)."""
    component = F.when(F.col("size") > 0, F.col("best._id")).otherwise(F.col("_id"))
    return _grouped(documents, k, percent, id_col, text_col).select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns: one with the smallest id.  All documents without words stay."""
    found = _grouped(documents, k, percent, id_col, text_col)
    marked = found.select("_id", "_h", "_g", F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"))
    return keep_marked(documents, materialise(marked, "marked"), id_col, text_col)

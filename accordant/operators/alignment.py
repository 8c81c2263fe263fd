"""Two runs as ordered lists, aligned by a longest common subsequence; what is left is the edit script."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.operators.joins import lookup
from accordant.operators.numbering import numbered
from accordant.scratch import materialise

#: Rows of a block that one task aligns: two or three numbers each.
MOST = 1 << 22
#: Bytes of the bit masks that are kept while a block is split.
_MASKS = 64 << 20


def _by_places(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as places in both, by the longest increasing run of equal pairs."""
    places: dict[int, list[int]] = {}
    for j, code in enumerate(b):
        places.setdefault(code, []).append(j)
    ends: list[int] = []  # the smallest last place of a run of each length
    chain: list = []
    for i, code in enumerate(a):
        for j in reversed(places.get(code, ())):
            k = bisect_left(ends, j)
            link = (i, j, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    out, link = [], chain[-1] if chain else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a with each prefix of b, a bit for each place of b."""
    full = (1 << len(b)) - 1
    row, masks = full, {}
    for code in a.tolist():
        mask = masks.get(code)
        if mask is None:
            if len(masks) * len(b) > 8 * _MASKS:
                masks.clear()
            mask = masks[code] = int.from_bytes(np.packbits(b == code, bitorder="little").tobytes(), "little")
        both = row & mask
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def longest_common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence, in order.

    Equal pairs are listed where they are few; otherwise a is halved, and the best place to cut b is read off the lengths for
    both halves, so memory stays in proportion to the lists however often a code occurs.
    """
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        lo, hi, low, high = open_.pop()
        n = min(hi - lo, high - low)
        head = np.flatnonzero(a[lo : lo + n] != b[low : low + n])
        head = int(head[0]) if len(head) else n
        out += [(lo + k, low + k) for k in range(head)]
        lo, low = lo + head, low + head
        x, y = a[lo:hi], b[low:high]
        if not len(x) or not len(y):
            continue
        codes, times = np.unique(y, return_counts=True)
        at = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
        if int(np.where(codes[at] == x, times[at], 0).sum()) <= 8 * (len(x) + len(y)):
            out += [(lo + i, low + j) for i, j in _by_places(x.tolist(), y.tolist())]
            continue
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        open_ += [(lo + half, hi, low + cut, high), (lo, lo + half, low, low + cut)]
    return sorted(out)


def _aligned(block: pa.Table) -> pa.Table:
    """(_s, _p, _q) of one block's members (_side, _p, _code, _s, _k)."""
    block = block.sort_by([("_side", "ascending"), ("_p", "ascending")])
    side, code, k = (block.column(c).to_numpy() for c in ("_side", "_code", "_k"))
    n = int(np.searchsorted(side, 1))
    pairs = np.array(longest_common(code[:n], code[n:]), np.int64).reshape(-1, 2)
    start = np.full(len(pairs), block.column("_s")[0].as_py(), np.int64)
    return pa.table({"_s": start, "_p": k[:n][pairs[:, 0]], "_q": k[n:][pairs[:, 1]]})


def _carried(rows: DataFrame, value: str, add, backwards: bool = False) -> Column:
    """What `add` (max or min) makes of `value` over all partitions before (or after) a row's own `_part`: a number each, which
    the driver puts together; null if there is none."""
    own = dict(rows.groupBy("_part").agg(getattr(F, add.__name__)(value)).collect())
    parts = sorted(own, reverse=backwards)
    together = lambda x, y: y if x is None else x if y is None else add(x, y)
    before = dict(zip(parts, accumulate([None, *[own[p] for p in parts]], together)))
    known = [F.lit(x).cast(kind) for p in parts if before[p] is not None for x, kind in ((p, "int"), (before[p], "long"))]
    return F.create_map(*known)[F.col("_part")] if known else F.lit(None).cast("long")


def _blocks(a: DataFrame) -> DataFrame:
    """a: (_p, _low, _high): a row's place and the first and last place of its item in the other list.  The rows with `_block`.

    A block ends where no equal pair crosses: all partners so far stand before all partners still to come.  So a longest
    common subsequence of the whole is one of each block, put together.
    """
    ranges = materialise(a.repartitionByRange("_p").withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part").orderBy("_p")
    before = F.greatest(F.max("_high").over(own.rowsBetween(Window.unboundedPreceding, -1)), _carried(ranges, "_high", max))
    back = Window.partitionBy("_part").orderBy(F.desc("_p"))  # frames that grow; Spark computes ones that shrink anew for each row
    after = F.least(F.min("_low").over(back.rowsBetween(Window.unboundedPreceding, 0)), _carried(ranges, "_low", min, True))
    cuts = materialise(ranges.withColumn("_cut", F.when(before.isNull() | (before < after), F.col("_p"))), "cuts")
    block = F.coalesce(F.max("_cut").over(own.rowsBetween(Window.unboundedPreceding, 0)), _carried(cuts, "_cut", max))
    return cuts.withColumn("_block", block).drop("_part", "_cut", "_high")


def _equal_places(rows: DataFrame, place: Column) -> DataFrame:
    """(_s, _run): up to which place both lists of a group are equal; groups that are equal throughout are left out."""
    item = lambda side: F.max(F.when(F.col("_side") == side, F.struct("_item")))
    spots = rows.groupBy("_s", place.alias("_place")).agg(item(0).alias("a"), item(1).alias("b"))
    return spots.filter("NOT (a <=> b)").groupBy("_s").agg(F.min("_place").alias("_run"))


def _numbered_in_groups(a: DataFrame, b: DataFrame, group: list[str], order: list[str], item: str) -> tuple[DataFrame, DataFrame]:
    """(_s, _side, _item, _p, _k, _a, _b) of both lists' rows, and their groups (group, _s, _a, _b, copies); _k: place in its list."""
    sides = [df.select(*group, F.lit(k).alias("_side"), F.col(item).alias("_item"), *[F.col(c).alias(f"_by{n}") for n, c in enumerate(order)]) for k, df in enumerate((a, b))]
    rows = numbered(sides[0].unionByName(sides[1]), [*group, "_side", *[f"_by{n}" for n in range(len(order))]], "_p")
    groups = rows.groupBy(*group).agg(F.min("_p").alias("_s"), F.count_if(F.col("_side") == 0).alias("_a"), F.count_if(F.col("_side") == 1).alias("_b"), F.count("*").alias("copies"))
    groups = materialise(groups, "groups")
    place = F.col("_p") - F.col("_s") - F.when(F.col("_side") == 1, F.col("_a")).otherwise(0)
    return materialise(lookup(rows, groups, group).select("_s", "_side", "_item", "_p", place.alias("_k"), "_a", "_b"), "rows"), groups


def _pairs(rows: DataFrame, most: int) -> DataFrame:
    """(_s, _p, _q): places that stay, of a longest common subsequence of each group's two lists."""
    until = lambda place: lookup(rows, _equal_places(rows, place).join(rows.groupBy("_s").agg(F.count("*").alias("copies")), "_s"), ["_s"], how="left")
    begun = until(F.col("_k")).withColumn("_head", F.coalesce("_run", "_a")).drop("_run")
    head = begun.filter("_side = 0 AND _k < _head").select("_s", F.col("_k").alias("_p"), F.col("_k").alias("_q"))
    rows = materialise(begun.filter("_k >= _head"), "begun")
    size = F.when(F.col("_side") == 0, F.col("_a")).otherwise(F.col("_b"))
    ended = until(size - 1 - F.col("_k")).withColumn("_tail", F.coalesce("_run", F.col("_a") - F.col("_head"))).withColumn("_left", size - F.col("_k")).drop("_run")
    tail = ended.filter("_side = 0 AND _left <= _tail").select("_s", F.col("_k").alias("_p"), (F.col("_b") - F.col("_left")).alias("_q"))
    rows = materialise(ended.filter("_left > _tail").select("_s", "_side", "_item", "_p", "_k"), "middle")

    place = F.when(F.col("_side") == 1, F.col("_p"))
    items = rows.groupBy("_s", "_item").agg(F.min(place).alias("_low"), F.max(place).alias("_high"), F.min("_side").alias("_first"), F.count("*").alias("copies"))
    shared = lookup(rows, items.filter("_low IS NOT NULL AND _first = 0").drop("_first"), ["_s", "_item"])
    shared = materialise(shared.select("_s", "_side", "_p", "_k", "_low", "_high"), "shared")
    a = materialise(_blocks(shared.filter("_side = 0")), "blocks")
    of_item = a.groupBy("_low").agg(F.min("_block").alias("_block"), F.count("*").alias("copies"))
    b = lookup(shared.filter("_side = 1").drop("_high"), of_item, ["_low"])
    members = materialise(a.unionByName(b).withColumnRenamed("_low", "_code"), "members")

    on = lambda side, c: F.when(F.col("_side") == side, F.col(c))
    sizes = members.groupBy("_block").agg(F.count("*").alias("copies"), F.min("_s").alias("_s"), *[f(on(k, c)).alias(n + str(k)) for k in (0, 1) for f, c, n in ((F.min, "_p", "_from"), (F.max, "_p", "_to"), (F.min, "_k", "_at"))])
    sizes = materialise(sizes, "sizes")
    alone = sizes.filter("copies = 2").select("_s", F.col("_at0").alias("_p"), F.col("_at1").alias("_q"))
    larger = sizes.filter("copies > 2").withColumn("_pieces", F.ceil(F.col("copies") / most)).drop("_s", "_at0", "_at1")
    met = lookup(members, larger, ["_block"])
    first, last = (F.when(F.col("_side") == 0, F.col(n + "0")).otherwise(F.col(n + "1")) for n in ("_from", "_to"))
    piece = F.floor((F.col("_p") - first) * F.col("_pieces") / (last - first + 1))
    met = met.select("_block", piece.alias("_piece"), "_side", "_p", "_code", "_s", "_k")
    solved = met.groupBy("_block", "_piece").applyInArrow(_aligned, "_s long, _p long, _q long")
    return head.unionByName(tail).unionByName(alone).unionByName(solved)


def edit_script(a: DataFrame, b: DataFrame, group: list[str], order: list[str], item: str, most: int = MOST) -> DataFrame:
    """(group, kind, a_from, a_to, b_from, b_to): how each group's list of a becomes that of b.

    A list is a group's items in the order given (nulls first).  A hunk puts the places [b_from, b_to) of b, from 0, in place of
    [a_from, a_to) of a; `kind` is change, or insert or delete if one of the two is empty.  All other places stay, and they are as
    many as can: a longest common subsequence, in which null items are equal.  Equal lists have no hunk, a list of
    one side alone has one.  Rows equal in group and order come in any order.

    Both lists are numbered by range.  What they begin and end with in common is taken off by counts of equal places; the rest
    is cut wherever no equal pair crosses; a block of one pair is done, and only larger blocks go to tasks, as numbers.
    So the work of a task depends on how far items move, not on how long the lists are.  A block of more than `most` rows
    is cut into pieces of about as many rows in proportion on both sides: its hunks are right, but may not be the shortest.
    """
    rows, groups = _numbered_in_groups(a, b, group, order, item)
    pairs = _pairs(rows, most).withColumn("_size", F.lit(1))
    zero = F.lit(0).cast("long")
    edges = [groups.select("_s", p.alias("_p"), q.alias("_q"), F.lit(0).alias("_size")) for p, q in ((zero, zero), (F.col("_a"), F.col("_b")))]
    at = materialise(numbered(pairs.unionByName(edges[0]).unionByName(edges[1]), ["_s", "_p", "_q", "_size"], "_at"), "kept")
    after = at.select((F.col("_at") - 1).alias("_at"), F.col("_s").alias("_t"), F.col("_p").alias("a_to"), F.col("_q").alias("b_to"))
    gaps = at.join(after, "_at").filter("_s = _t").select("_s", (F.col("_p") + F.col("_size")).alias("a_from"), "a_to", (F.col("_q") + F.col("_size")).alias("b_from"), "b_to")
    hunks = gaps.filter("a_to > a_from OR b_to > b_from")
    kind = F.when(F.col("a_to") == F.col("a_from"), "insert").when(F.col("b_to") == F.col("b_from"), "delete").otherwise("change")
    return lookup(hunks, groups.drop("_a", "_b"), ["_s"]).select(*group, kind.alias("kind"), "a_from", "a_to", "b_from", "b_to")


def changed(a: DataFrame, b: DataFrame, group: list[str], order: list[str], item: str) -> DataFrame:
    """(group, kept, removed, added) of every group: how many places stay, go and come."""
    script = edit_script(a, b, group, order, item)
    parts = [
        a.select(*group, F.lit(1).alias("kept"), F.lit(0).alias("removed"), F.lit(0).alias("added")),
        b.select(*group, *[F.lit(0).alias(c) for c in ("kept", "removed", "added")]),
        script.select(*group, (F.col("a_from") - F.col("a_to")).alias("kept"), (F.col("a_to") - F.col("a_from")).alias("removed"), (F.col("b_to") - F.col("b_from")).alias("added")),
    ]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return all_.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "added")])

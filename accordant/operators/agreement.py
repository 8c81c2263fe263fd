"""Agreement of two raters: set metrics by granularity, Krippendorff's alpha, votes, kappa."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators.joins import distinct_keys, lookup
from accordant.scratch import materialise

#: Labels from least to most divergent (fixed values).
LABELS = ["aligned", "partial", "divergent", "contradictory"]
#: Lowest kappa of each band (fixed values).
BANDS = [(0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"), (0.0, "slight")]
LOWEST_BAND = "poor (< chance)"
#: Sets in a block, and their items, of which pairs are compared in one task; a set goes to as many tasks as there are blocks.
SETS_PER_BLOCK, ITEMS_PER_BLOCK = 32768, 1 << 22
#: Partitions of the comparison at most; there is one for each pair of blocks up to then.
PAIRS_AT_ONCE = 10_000
#: Words of a tile and sets that are compared with it at a time, so that a call has enough to do; words and codes of a tile at most.
WORDS, STRIP, CELLS = 600, 64, 1 << 20
#: Operations that a word of 64 sets may take for all counts that may occur; beyond it each set's count is taken apart.
OPERATIONS = 400
#: What the two lowest bits, or one of them, add to what a count without them is worth: (count, sign) each.
GAINS = {0: [(0, 1)], 1: [(1, 1), (0, -1)], 2: [(2, 1), (0, -1)], 3: [(3, 1), (2, -1), (1, -1), (0, 1)]}



def shared_items(elements: DataFrame) -> DataFrame:
    """elements: (granularity, unit, side, item), not nec. distinct.  (granularity, unit, item, a, b): which sides have an item."""
    return elements.filter("item IS NOT NULL").groupBy("granularity", "unit", "item").agg(F.max(F.when(F.col("side") == "A", 1).otherwise(0)).alias("a"), F.max(F.when(F.col("side") == "B", 1).otherwise(0)).alias("b"))


def overlaps(sides: DataFrame) -> DataFrame:
    """Rows of shared_items to (granularity, unit, a, b, both): set sizes of each unit."""
    return sides.groupBy("granularity", "unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("both"))


def rated(elements: DataFrame) -> DataFrame:
    """Elements to (granularity, unit, a, b): the sets of both sides, in which hashes stand for the items."""
    item = F.xxhash64("item")
    chosen = [F.array_sort(F.collect_set(F.when(F.col("side") == side, item))).alias(side.lower()) for side in "AB"]
    return elements.filter("item IS NOT NULL").groupBy("granularity", "unit").agg(*chosen)


def set_metrics(elements: DataFrame, places: int = 6, granularities: list[str] | None = None) -> DataFrame:
    """Macro and micro Jaccard and Dice by granularity; 1 where there is nothing to compare, as in a granularity without elements."""
    return _set_metrics(overlaps(shared_items(elements)), places, granularities)


def _set_metrics(sizes: DataFrame, places: int, granularities: list[str] | None) -> DataFrame:
    union = F.col("a") + F.col("b") - F.col("both")
    found = (
        sizes.groupBy("granularity")
        .agg(F.avg(F.when(union > 0, F.col("both") / union)).alias("m"), F.sum("both").alias("i"), F.sum(union).alias("u"), F.sum(F.col("a") + F.col("b")).alias("s"))
    )
    return every(found, granularities).select(
        "granularity",
        F.round(F.coalesce("m", F.lit(1.0)), places).alias("jaccard_macro"),
        F.round(F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(1.0), places).alias("jaccard_micro"),
        F.round(F.when(F.col("s") > 0, 2 * F.col("i") / F.col("s")).otherwise(1.0), places).alias("dice"),
    )


def every(found: DataFrame, granularities: list[str] | None) -> DataFrame:
    """One row for each of the granularities, with nulls where nothing was found; as it is if none are given."""
    if granularities is None:
        return found
    named = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, granularities))).alias("granularity"))
    return named.join(found, "granularity", "left")


def masi(a: Column, b: Column, both: Column) -> Column:
    """MASI distance from two set sizes and their intersection: 1 - Jaccard * monotonicity (1, 2/3, 1/3, 0)."""
    m = F.when((both == a) & (both == b), 1.0).when((both == a) | (both == b), 2 / 3).when(both > 0, 1 / 3).otherwise(0.0)
    return F.when((a == 0) & (b == 0), 0.0).when((a == 0) | (b == 0), 1.0).otherwise(1 - both / (a + b - both) * m)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in columns of one length, and that length."""
    first = np.arange(len(columns[0])) == 0
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(first), len(first))


def _near(shared: np.ndarray | float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - MASI distance of sets of sizes a and b that share so many items."""
    steps = np.where((shared == a) & (shared == b), 1.0, np.where((shared == a) | (shared == b), 2 / 3, np.where(np.greater(shared, 0), 1 / 3, 0.0)))
    return shared / np.maximum(1, a + b - shared) * steps


class _Sets:
    """Some sets of a block in a given order: codes of their items one set after the other (`token`, from `begin`), how many, size, times."""

    def __init__(self, token: np.ndarray, begin: np.ndarray, held: np.ndarray, size: np.ndarray, times: np.ndarray, order: np.ndarray):
        self.held, self.size, self.times = held[order], size[order].astype(float), times[order]
        self.begin = np.concatenate([[0], np.cumsum(self.held)])
        self.token = token[np.repeat(begin[order] - self.begin[:-1], self.held) + np.arange(self.begin[-1])]

    def codes(self, start: int, stop: int, none: int) -> np.ndarray:
        """A row of codes for each of the sets, filled up with `none`."""
        out = np.full((stop - start, int(self.held[start:stop].max())), none)
        out[np.arange(out.shape[1]) < self.held[start:stop, None]] = self.token[self.begin[start] : self.begin[stop]]
        return out


def _tiles(other: _Sets, place: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of words (from, to), the codes that their sets have, and for each code a row of bits, 1 where a set has it, and in
    the end a row of zeros.  place: each set's bit; ends: the first set of each word.  With many codes a stretch is halved."""
    cuts = np.linspace(0, len(ends) - 1, -(-(len(ends) - 1) // WORDS) + 1).astype(int).tolist()
    left = list(zip(cuts[:-1], cuts[1:]))
    while left:
        low, high = left.pop()
        first, last = ends[low], ends[high]
        codes, row = np.unique(other.token[other.begin[first] : other.begin[last]], return_inverse=True)
        if len(codes) * (high - low) > CELLS and high - low > 1:
            left += [(low, (low + high) // 2), ((low + high) // 2, high)]
            continue
        bits = np.zeros((len(codes) + 1, high - low), np.uint64)
        word, bit = (np.repeat(x, other.held[first:last]) for x in (place[first:last] // 64 - low, place[first:last] % 64))
        np.bitwise_or.at(bits, (row, word), np.uint64(1) << bit.astype(np.uint64))
        yield low, high, codes, bits


def _planes(bits: np.ndarray, listed: np.ndarray, spare: list[np.ndarray]) -> list[np.ndarray]:
    """Of the rows of bits that are listed for each set, how many are 1 at each place: plane k has the bits 2**k of these numbers.
    spare: arrays of this shape that are free; those that become free are put there, as new ones cost more than the operations."""
    levels: list[list[np.ndarray]] = [[]]

    def carry(level: int) -> None:
        """Two or three planes of a level to one of it and one of the next."""
        a, b, *more = levels[level]
        both = np.bitwise_xor(a, b, out=_free(spare, a))
        np.bitwise_and(a, b, out=a)
        for c in more:
            np.bitwise_and(both, c, out=b)
            np.bitwise_or(a, b, out=a)
            np.bitwise_xor(both, c, out=both)
        spare.extend([b, *more])
        levels[level] = [both]
        if level + 1 == len(levels):
            levels.append([])
        levels[level + 1].append(a)

    rows = np.ascontiguousarray(listed.T)
    shape = np.broadcast_to(np.uint64(0), (len(listed), bits.shape[1]))
    for row in rows:
        levels[0].append(bits.take(row, axis=0, out=_free(spare, shape), mode="clip"))
        level = 0
        while len(levels[level]) == 3:
            carry(level)
            level += 1
    level = 0
    while level < len(levels):
        if len(levels[level]) > 1:
            carry(level)
        level += 1
    return [have[0] for have in levels]


def _free(spare: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    return spare.pop() if spare else np.empty(like.shape, like.dtype)


def _counts(planes: list[np.ndarray], spare: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(n, more, places): where the planes hold n to n + 3 (more 0), and of these places the ones with the lowest bit (1), the next
    one (2) or both (3), for each multiple n of 4 that occurs.  Places are good until the next ones are asked for."""
    lowest = [(k + 1, x) for k, x in enumerate(planes[:2])]
    if len(lowest) == 2:
        lowest.append((3, np.bitwise_and(*planes[:2], out=_free(spare, planes[0]))))
    left: list[tuple[int, int, np.ndarray | None]] = [(0, len(planes), None)]
    while left:
        number, level, places = left.pop()
        if level <= 2:
            if number:
                yield number, 0, places
            for bits, plane in lowest:
                if places is None:
                    yield number, bits, plane
                    continue
                both = np.bitwise_and(places, plane, out=_free(spare, plane))
                yield number, bits, both
                spare.append(both)
            if places is not None:
                spare.append(places)
            continue
        plane = planes[level - 1]
        one = np.bitwise_and(plane if places is None else places, plane, out=_free(spare, plane))
        zero = np.invert(one, out=_free(spare, plane)) if places is None else np.bitwise_xor(places, one, out=places)
        for value, part in ((number, zero), (number | 1 << level - 1, one)):
            if part.view(bool).any():
                left.append((value, level - 1, part))
            else:
                spare.append(part)
    spare.extend(planes + [x for _, x in lowest[2:]])


def _numbers(planes: list[np.ndarray]) -> np.ndarray:
    """The numbers that planes hold, one for each place."""
    kind = np.uint8 if len(planes) <= 8 else np.int32
    return sum(np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little").astype(kind, copy=False) << k for k, x in enumerate(planes))


def _met(mine: _Sets, other: _Sets, codes: int, inside: bool) -> float:
    """Sum of times * times * (1 - MASI distance) over the pairs of two lists of sets, or over all ordered pairs of one (inside).

    Sets of one size and times share words, so what a set shares with 64 of them is counted by operations on bits, and
    each count that occurs is worth the same for all places of a word.  Where words would be nearly empty, counts are very
    many or few sets have the same size, words hold any sets and their counts are taken apart."""
    runs = _runs(other.size, other.times)
    each = np.diff(runs)
    classes = _runs(mine.size)
    mixed = len(classes) * 8 > len(mine.size)
    full = len(other.size) / (64 * (-(-each // 64)).sum())
    alone = mixed or min(mine.held.max(), other.held.max()) > OPERATIONS * full
    first = np.concatenate([[0], np.cumsum(-(-each // 64))[:-1]]) * 64
    place = np.arange(len(other.size)) + (0 if alone else np.repeat(first - runs[:-1], each))
    ends = np.searchsorted(place, 64 * np.arange(place[-1] // 64 + 2))
    if mixed:
        classes = np.array([0, len(mine.size)])
    total, times = 0.0, mine.times
    whole = (times == np.floor(times)).all() and times.max() * 64 * STRIP < 1 << 24
    kind = np.float32 if whole else np.float64  # sums of whole numbers are exact
    for low, high, found, bits in _tiles(other, place, ends):
        known = np.full(codes + 1, len(found))
        known[found] = np.arange(len(found))
        use = slice(ends[low], ends[high]) if alone else ends[low:high]
        size, weight = other.size[use], other.times[use]
        sizes, kinds = np.unique(size, return_inverse=True)
        # Inside, larger ones stand for both orders.  What a bit adds to n, and both together add to what each adds.
        worth = lambda n, a: _near(n, a, size) * weight * (np.where(size > a, 2, size == a) if inside else 1)  # noqa: B023, E731
        gain = lambda n, more, a: sum(sign * worth(n + k, a) for k, sign in GAINS[more])  # noqa: B023, E731
        for start, stop in zip(classes[:-1].tolist(), classes[1:].tolist()):
            if inside and size[-1] < mine.size[start]:
                continue
            sums: dict[tuple[int, int], np.ndarray] = {}
            spare: list[np.ndarray] = []
            table = None
            if alone:
                most = np.arange(min(mine.size[start], size[-1]) + 1)[:, None]
                if not mixed and len(most) * len(sizes) <= (stop - start) * len(size):  # what each count of each size is worth is looked up
                    table = _near(most, mine.size[start], sizes) * (np.where(sizes > mine.size[start], 2, sizes == mine.size[start]) if inside else 1)
            at = start
            while at < stop:
                to = min(at + STRIP, stop)
                while to - at > 1 and (to - at) * mine.held[at:to].max() > CELLS:
                    to = (at + to) // 2
                if spare and len(spare[0]) != to - at:
                    spare.clear()
                listed = known[mine.codes(at, to, codes)]
                listed.sort(axis=1)  # what no set of the tile has goes to the end
                planes = _planes(bits, listed[:, : max(1, (listed < len(found)).sum(axis=1).max())], spare)
                own, at = slice(at, to), to
                if alone:
                    for k in range(at - len(planes[0]), at, 8):
                        few = slice(k, min(k + 8, at))
                        counts = _numbers([x[few.start - own.start : few.stop - own.start] for x in planes])[:, place[use] - 64 * low]
                        if table is None:
                            total += float(times[few] @ worth(counts, mine.size[few, None]).sum(axis=1))
                        else:
                            total += float(times[few] @ (table.take(counts.astype(np.intp) * len(sizes) + kinds) @ weight))
                    spare.extend(planes)
                    continue
                for n, more, places in _counts(planes, spare):
                    many = np.bitwise_count(places).astype(kind)
                    met = times[own].astype(kind, copy=False) @ many
                    sums[n, more] = sums[n, more] + met if (n, more) in sums else met.astype(float)
            total += sum(float(x @ gain(n, more, mine.size[start])) for (n, more), x in sums.items())
    return total


def _closeness(block: pa.Table) -> pa.Table:
    """Sum of times * times * (1 - MASI distance) over the pairs of sets of two blocks, or of all ordered pairs of one.  Sets are
    as large as `size` says; of what they share only `items` counts here."""
    side, times, size = (block[c].to_numpy() for c in ("side", "times", "size"))
    items = block["items"].combine_chunks()
    begin, held = items.offsets.to_numpy()[:-1], np.diff(items.offsets.to_numpy())
    coded = items.values.dictionary_encode()
    sets = lambda which, *by: _Sets(coded.indices.to_numpy(), begin, held, size, times, (o := np.lexsort(by))[((side == which) & (held > 0))[o]])
    mine, inside = sets(0, held, size), not (side == 1).any()
    other = sets(0 if inside else 1, times, size)
    total = _met(mine, other, len(coded.dictionary), inside) * (1 if inside else 2) if len(mine.size) and len(other.size) else 0.0
    return pa.table({"granularity": block["granularity"][:1], "close": pa.array([total])})


def _packed(block: pa.Table) -> pa.Table:
    """The sets of a block (times, items, size) as one row."""
    items = block["items"].combine_chunks()
    listed = pa.ListArray.from_arrays(items.offsets, items.values.dictionary_encode())
    sets, sink = pa.table({"times": block["times"].combine_chunks(), "items": listed, "size": block["size"].combine_chunks()}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, sets.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(sets)
    return pa.table({c: block[c][:1] for c in ("granularity", "own", "blocks")} | {"sets": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _compared(pair: pa.Table) -> pa.Table:
    """_closeness of one or two blocks, each as `_packed` makes it."""
    blocks = []
    for side, sets in enumerate(pair["sets"]):
        block = pa.ipc.open_stream(sets.as_buffer()).read_all()
        items = block["items"].combine_chunks()
        items = pa.ListArray.from_arrays(items.offsets, items.values.dictionary_decode())
        blocks.append(pa.table({"times": block["times"], "items": items, "size": block["size"], "side": pa.array(np.full(len(block), side, np.int32))}))
    both = pa.concat_tables(blocks)
    return _closeness(both.append_column("granularity", pa.array([pair["granularity"][0].as_py()] * len(both), pa.string())))


#: An item that so many distinct sets hold or fewer is a light one: its sets meet as rows.
LIGHT = 32


def closeness(kinds: DataFrame, light: int = LIGHT) -> DataFrame:
    """(granularity, close): the sum of times * times * (1 - MASI distance) over all ordered pairs of sets, with themselves.

    kinds: (granularity, items, times), distinct sets that aren't empty.  Only pairs that share an item count.  Items that at
    most `light` sets hold are inverted: the pairs of sets in their lists are rows, at most `light` for each element.  By the
    other items alone, sets with the same ones and the same size are one; these are dealt into blocks of about
    SETS_PER_BLOCK, and a task compares all sets of two blocks.  Pairs from the lists then replace what the
    blocks made of them.  So work grows with the square only of the number of different heavy parts.
    """
    return _close(_numbered(kinds.select("granularity", "times", F.array_sort(F.transform("items", lambda x: F.xxhash64(x))).alias("items"))), light)


def _numbered(kinds: DataFrame) -> DataFrame:
    """Distinct sets of hashes, written, with their size and an id."""
    return materialise(kinds.withColumn("size", F.size("items")).withColumn("id", F.monotonically_increasing_id()), "kinds")


def _close(own: DataFrame, light: int) -> DataFrame:
    """closeness of sets as `_numbered` makes them."""
    keys = ["granularity", "item"]
    elements = own.select("granularity", "id", F.explode("items").alias("item"))
    counted = materialise(distinct_keys(elements, keys), "items")
    if counted.filter(F.col("copies") <= light).isEmpty():  # every set is its heavy part
        return _dense(own.select("granularity", "times", "items", "size")).groupBy("granularity").agg(F.sum("close").alias("close"))
    weighed = lookup(elements, counted.withColumn("n", F.col("copies")), keys)
    rare = materialise(weighed.filter(F.col("n") <= light).select("granularity", "item", "id"), "rare")
    lists = rare.groupBy("granularity", "id").agg(F.collect_list("item").alias("_rare"))
    heavy = F.when(F.col("_rare").isNull(), F.col("items")).otherwise(F.array_except("items", "_rare"))
    sets = materialise(own.join(lists, ["granularity", "id"], "left").select("granularity", "id", "times", "size", heavy.alias("heavy")), "sets")
    other = rare.select("granularity", "item", F.col("id").alias("with"))
    pairs = rare.join(other, ["granularity", "item"]).filter(F.col("id") <= F.col("with")).groupBy("granularity", "id", "with").agg(F.count("*").alias("both"))
    first = sets.select("granularity", "id", F.col("size").alias("a"), F.col("times").alias("x"), F.col("heavy").alias("h"))
    second = sets.select("granularity", F.col("id").alias("with"), F.col("size").alias("b"), F.col("times").alias("y"), F.col("heavy").alias("g"))
    met = pairs.join(first, ["granularity", "id"]).join(second, ["granularity", "with"]).withColumn("_h", F.size(F.array_intersect("h", "g")))
    gained = masi(F.col("a"), F.col("b"), F.col("_h")) - masi(F.col("a"), F.col("b"), F.col("_h") + F.col("both"))
    gained = met.select("granularity", (F.col("x") * F.col("y") * F.when(F.col("id") == F.col("with"), 1).otherwise(2) * gained).alias("close"))
    alike = materialise(sets.filter(F.size("heavy") > 0).groupBy("granularity", F.col("heavy").alias("items"), "size").agg(F.sum("times").alias("times")), "alike")
    return _dense(alike).unionByName(gained).groupBy("granularity").agg(F.sum("close").alias("close"))


def _dense(alike: DataFrame) -> DataFrame:
    """(granularity, close) of each pair of blocks of written sets (granularity, times, items, size).  A block is written
    as one row, and such rows are what goes to the tasks that compare it with the others."""
    held = alike.groupBy("granularity").agg(F.greatest(F.count("*") / SETS_PER_BLOCK, F.sum(F.size("items")) / ITEMS_PER_BLOCK).alias("n"))
    blocks = materialise(held.select("granularity", F.ceil("n").cast("int").alias("blocks")), "blocks")
    at_once = blocks.agg(F.sum(F.expr("blocks * (blocks + 1L) div 2"))).first()[0]
    dealt = alike.join(F.broadcast(blocks), "granularity").withColumn("own", F.pmod(F.xxhash64("items", "size"), F.col("blocks")).cast("int"))
    dealt = dealt.select("granularity", "own", "blocks", "times", "items", "size")
    rows = materialise(dealt.groupBy("granularity", "own").applyInArrow(_packed, "granularity string, own int, blocks int, sets binary"), "packed")
    both = rows.select("granularity", "sets", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    both = both.select("granularity", "sets", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("z"))
    both = both.repartition(max(1, min(at_once or 0, PAIRS_AT_ONCE)), "granularity", "a", "z")
    return both.groupBy("granularity", "a", "z").applyInArrow(_compared, "granularity string, close double")


def alpha(elements: DataFrame, units: DataFrame, places: int = 6, granularities: list[str] | None = None) -> DataFrame:
    """Krippendorff's alpha with MASI distance, by granularity, for all `units` (unit); (granularity, n, observed, expected, alpha).

    Expected disagreement runs over all ordered pairs of the 2n sets.  Equal sets are one with a multiplicity; their pairs are
    summed up by `closeness`.
    """
    return _alpha(rated(elements), units, places, granularities)


def _alpha(sides: DataFrame, units: DataFrame, places: int, granularities: list[str] | None) -> DataFrame:
    n = units.select("unit").distinct().agg(F.count("*").alias("n"))
    apart = masi(F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b")))
    # A unit's distance goes with the first of its sets, so that what is grouped is read once.
    sets = sides.withColumn("d", apart).select("granularity", F.posexplode(F.filter(F.array("a", "b"), lambda x: F.size(x) > 0)).alias("at", "items"), "d")
    kinds = sets.groupBy("granularity", "items").agg(F.count("*").cast("double").alias("times"), F.sum(F.when(F.col("at") == 0, F.col("d")).otherwise(0.0)).alias("d"))
    kinds = _numbered(kinds)
    held = kinds.groupBy("granularity").agg(F.sum("times").alias("filled"), F.sum("d").alias("d"))
    out = every(held.join(_close(kinds, LIGHT), "granularity"), granularities).na.fill(0.0, ["d", "close", "filled"]).join(F.broadcast(n))
    empty = 2 * F.col("n") - F.col("filled")  # sets without items: at distance 0 from each other, 1 from the rest
    pairs = 2 * F.col("n") * (2 * F.col("n") - 1)
    # All ordered pairs with themselves, minus closeness, minus pairs of empty sets.
    far = 4 * F.col("n") * F.col("n") - F.col("close") - empty * empty
    expected = F.when(pairs > 0, far / pairs).otherwise(0.0)
    observed = F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(0.0)
    return out.select(
        "granularity",
        "n",
        F.round(observed, places).alias("observed"),
        F.round(expected, places).alias("expected"),
        F.round(F.when(F.abs(expected) < 1e-12, 1.0).otherwise(1 - observed / expected), places).alias("alpha"),
    )


def agreement_report(elements: DataFrame, units: DataFrame, places: int = 6, granularities: list[str] | None = None) -> DataFrame:
    """Macro and micro Jaccard, Dice, observed and expected disagreement and alpha by granularity: elements are shuffled to
    their units once, and both kinds of metrics read what is written then."""
    sides = materialise(rated(elements), "sides")
    sizes = sides.select("granularity", "unit", F.size("a").alias("a"), F.size("b").alias("b"), F.size(F.array_intersect("a", "b")).alias("both"))
    return _set_metrics(sizes, places, granularities).join(_alpha(sides, units, places, granularities), "granularity")


def majority(votes: DataFrame, by: list[str], label: str, rank: Column) -> DataFrame:
    """The most frequent label of each group, of equally frequent ones the highest by rank: (by, label, n, votes)."""
    n = votes.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"), F.max(rank).alias("_rank"))
    return n.groupBy(*by).agg(F.max_by(F.struct(label, "n"), F.struct("n", "_rank")).alias("m"), F.sum("n").alias("votes")).select(*by, F.col(f"m.{label}").alias(label), F.col("m.n").alias("n"), "votes")


def _most(counts: Column) -> Column:
    """Of (n, rank, label) structs the label of the most frequent, of equally frequent ones the highest by rank; null of none."""
    return F.array_max(F.filter(counts, lambda x: x["n"] > 0))["label"]


def verdicts(manifest: DataFrame, given: DataFrame, labels: list[str], key: str = "cid") -> DataFrame:
    """The manifest (key, unit, ordering, provider) with label, confidence and error of each request; error `missing` without a verdict."""
    own = given.select(F.col(key).alias("_key"), "label", "confidence", "error")
    joined = manifest.join(own, F.col(key) == F.col("_key"), "left")
    error = F.coalesce("error", F.when(F.col("_key").isNull(), "missing"))
    return joined.select(*manifest.columns, F.when(F.col("label").isin(labels), F.col("label")).alias("label"), "confidence", error.alias("error"))


def aggregate_verdicts(votes: DataFrame, labels: list[str], severe: list[str] | None = None) -> DataFrame:
    """One row per unit of votes (unit, ordering 0 or 1, provider, label, confidence); labels from least to most divergent.

    final: majority of the valid votes, ties upward; order0, order1: majority of each ordering; model_labels: of each
    provider, as a map; label_counts as a map; flag_reason: why a person should look, flagged: whether.  Orderings disagree
    if both have valid votes and differ; confidence is low if half of the valid votes or more say so; labels in `severe` (the
    upper half) and failed votes flag a unit too.  Without valid votes all else is null.

    Votes are counted by unit and provider before they meet, so a unit's row is made from one short row a provider.
    """
    severe = labels[len(labels) // 2 :] if severe is None else severe
    number = [[F.count_if((F.col("label") == v) & (F.col("ordering") == o)).alias(f"n{k}_{o}") for o in (0, 1)] for k, v in enumerate(labels)]
    by = votes.groupBy("unit", "provider").agg(F.count("*").alias("votes"), F.count_if(F.col("label").isin(labels)).alias("valid"), F.count_if(F.col("label").isin(labels) & (F.col("confidence") == "low")).alias("low"), *[c for x in number for c in x])
    counted = lambda n: F.array(*[F.struct(n(k).alias("n"), F.lit(k).alias("rank"), F.lit(v).alias("label")) for k, v in enumerate(labels)])
    own = _most(counted(lambda k: F.col(f"n{k}_0") + F.col(f"n{k}_1")))
    sums = [F.sum(f"n{k}_{o}").alias(f"n{k}_{o}") for k in range(len(labels)) for o in (0, 1)]
    unit = by.groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("votes", "valid", "low")], *sums, F.sort_array(F.collect_list(F.when(own.isNotNull(), F.struct("provider", own.alias("label"))))).alias("models"))
    total = counted(lambda k: F.col(f"n{k}_0") + F.col(f"n{k}_1"))
    order = [_most(counted(lambda k, o=o: F.col(f"n{k}_{o}"))) for o in (0, 1)]
    some = F.col("valid") > 0
    row = unit.select(
        "unit",
        _most(total).alias("final"),
        *[x.alias(f"order{o}") for o, x in enumerate(order)],
        F.when(some, F.coalesce(order[0] != order[1], F.lit(False))).alias("order_disagreement"),
        F.when(some, F.map_from_entries("models")).alias("model_labels"),
        F.when(some, F.size(F.array_distinct(F.transform("models", lambda m: m["label"]))) > 1).alias("model_disagreement"),
        F.when(some, F.map_from_entries(F.transform(F.filter(total, lambda x: x["n"] > 0), lambda x: F.struct(x["label"], x["n"])))).alias("label_counts"),
        "votes",
        "valid",
        (2 * F.col("low") >= F.col("valid")).alias("_low"),
    )
    why = F.concat_ws(
        "; ",
        F.when(F.col("model_disagreement"), "cross-model disagreement"),
        F.when(F.col("order_disagreement"), "order-swap disagreement"),
        F.when(F.col("final").isin(severe), F.concat(F.lit("final="), F.col("final"))),
        F.when(F.col("_low"), "low confidence"),
        F.when(F.col("valid") < F.col("votes"), F.concat((F.col("votes") - F.col("valid")).cast("string"), F.lit(" verdict(s) failed"))),
    )
    reason = F.when(F.col("valid") == 0, "no valid verdicts").otherwise(why)
    return row.withColumns({"flag_reason": reason, "flagged": reason != ""}).drop("_low")


def vote_lists(votes: DataFrame) -> DataFrame:
    """(unit, votes): every vote of a unit, failed ones too, by ordering and provider; a unit has a few votes a juror."""
    vote = F.struct("ordering", "provider", "label", "confidence", "error")
    return votes.groupBy("unit").agg(F.sort_array(F.collect_list(vote)).alias("votes"))


def verdict_summary(aggregated: DataFrame) -> DataFrame:
    """(kind, name, n): units by final label, and how many are flagged or split."""
    kinds = F.array(
        F.struct(F.lit("final").alias("kind"), F.col("final").alias("name")),
        *[F.when(F.col(c), F.struct(F.lit("signal").alias("kind"), F.lit(c).alias("name"))) for c in ("flagged", "model_disagreement", "order_disagreement")],
    )
    return aggregated.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def judged_pairs(sheet: DataFrame, report: DataFrame, labels: list[str]) -> DataFrame:
    """sheet (unit, human) against report (unit, final): (unit, human, judge, skipped); skipped says `unlabeled`, `missing` or is null.

    A human label outside the list is an error of the sheet and raises.
    """
    human = F.lower(F.trim(F.coalesce("human", F.lit(""))))
    joined = sheet.select("unit", human.alias("human")).join(report.select(F.col("unit").alias("_unit"), "final"), F.col("unit") == F.col("_unit"), "left")
    checked = F.when(F.col("human").isin("", *labels), F.col("human")).otherwise(F.raise_error(F.concat(F.lit("invalid human label: "), F.col("human"))))
    judge = F.when(F.col("final").isin(labels), F.col("final"))
    return joined.select("unit", checked.alias("human"), judge.alias("judge"), F.when(F.col("human") == "", "unlabeled").when(judge.isNull(), "missing").alias("skipped"))


def cost(instances: int, jurors: int, tokens_in: int = 900, tokens_out: int = 500, price_in: float = 5.0, price_out: float = 25.0) -> dict[str, float]:
    """Requests of each juror (two orderings) and of all, and their rough cost; prices are for a million tokens."""
    calls = 2 * instances
    return {"calls_per_juror": calls, "requests": jurors * calls, "cost": jurors * calls * (tokens_in * price_in + tokens_out * price_out) / 1e6}


def confusion(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: (h, j) with labels 0..k-1.  (h, j, n) for the whole grid."""
    grid = pairs.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("h"), (F.col("id") % k).cast("int").alias("j"))
    seen = pairs.groupBy(F.col("h").cast("int").alias("h"), F.col("j").cast("int").alias("j")).agg(F.count("*").alias("n"))
    return grid.join(seen, ["h", "j"], "left").select("h", "j", F.coalesce("n", F.lit(0)).alias("n"))


def kappa(grid: DataFrame, k: int, weighted: bool, places: int = 6) -> DataFrame:
    """Cohen's kappa of a confusion grid, with linear weights or none: (n, agreement, kappa); 1 without expected disagreement."""
    d = F.abs(F.col("h") - F.col("j")) / (k - 1) if weighted else (F.col("h") != F.col("j")).cast("double")
    rows = grid.groupBy("h").agg(F.sum("n").alias("r"))
    cols = grid.groupBy("j").agg(F.sum("n").alias("c"))
    full = grid.join(F.broadcast(rows), "h").join(F.broadcast(cols), "j")
    total = full.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("h") == F.col("j"), F.col("n"))).alias("same"), F.sum(d * F.col("n")).alias("o"), F.sum(d * F.col("r") * F.col("c")).alias("e"))
    share = F.when(F.col("e") == 0, 1.0).otherwise(1 - F.col("o") * F.col("n") / F.col("e"))
    return total.select("n", F.round(F.col("same") / F.col("n"), places).alias("agreement"), F.round(share, places).alias("kappa"))


def band(x: Column) -> Column:
    out = F.when(x >= BANDS[0][0], BANDS[0][1])
    for low, name in BANDS[1:]:
        out = out.when(x >= low, name)
    return out.otherwise(LOWEST_BAND)


def per_class(grid: DataFrame, places: int = 6) -> DataFrame:
    """(label, support_h, support_j, recall, precision) for labels that either side uses; null where there is nothing to divide by."""
    h = grid.groupBy(F.col("h").alias("label")).agg(F.sum("n").alias("support_h"), F.sum(F.when(F.col("h") == F.col("j"), F.col("n"))).alias("hit"))
    j = grid.groupBy(F.col("j").alias("label")).agg(F.sum("n").alias("support_j"))
    return h.join(j, "label").filter("support_h + support_j > 0").select(
        "label",
        "support_h",
        "support_j",
        F.round(F.when(F.col("support_h") > 0, F.col("hit") / F.col("support_h")), places).alias("recall"),
        F.round(F.when(F.col("support_j") > 0, F.col("hit") / F.col("support_j")), places).alias("precision"),
    )

"""Joins whose hot keys are split: lookups of distinct keys, points in spans, nearest equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.scratch import materialise

#: A key that this share of all rows or more have is matched by a broadcast: there can be at most so many such keys.
FREQUENT = 10_000
#: A span of 2**k positions is at home in two bins of level k at most; more than so many levels can't be.
LEVELS = 63
#: Rows of a task whose stage sorts them several times, or joins and lists them by a key.
ROWS_AT_ONCE = 100_000


def pieces(*tables: DataFrame) -> int:
    """How many partitions the largest of the tables should be dealt to, so that a task's share, and with it the memory of its
    sorts, doesn't grow with the input.  Spark neither joins such partitions again nor holds itself to the session's number."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, *[-(-t.count() // ROWS_AT_ONCE) for t in tables])


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str], nulls: bool = True) -> Column:
    """Equality on pairs of columns, as a join condition: null-safe, for which Spark sorts by two columns a key, or not."""
    condition = F.lit(True)
    for a, b in pairs.items():
        condition = condition & (left[a].eqNullSafe(right[b]) if nulls else left[a] == right[b])
    return condition


def lookup(rows: DataFrame, keyed: DataFrame, keys: list[str], copies: str = "copies", how: str = "inner", nulls: bool = True) -> DataFrame:
    """The rows with what `keyed` (one row a key) says of them, nulls in keys being equal (or, without `nulls`, equal to
    nothing); how: inner or left.

    copies: the column of `keyed` with the number of rows that have the key.  Keys of one row in FREQUENT or more are matched
    by a broadcast, which can hold FREQUENT rows at most, so that their rows stay where they are; all others by a join.
    """
    more = [c for c in keyed.columns if c not in (*keys, copies)]
    keyed = materialise(keyed, "keyed")  # read three times
    total, most = keyed.agg(F.sum(copies), F.max(copies)).first()
    held = keyed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*more).alias("_said"), (F.col(copies) * FREQUENT >= (total or 0)).alias("_often"))
    names = {k: f"_k_{k}" for k in keys}
    said = [F.col(f"_said.{c}").alias(c) for c in more]
    if not most or most * FREQUENT < total:  # no key is that frequent
        return rows.join(held, same(rows, held, names, nulls), how).select(*[rows[c] for c in rows.columns], *said)
    often = F.broadcast(held.filter("_often"))
    first = rows.join(often, same(rows, often, names, nulls), "left").select(*[rows[c] for c in rows.columns], F.col("_often").isNotNull().alias("_met"), "_said")
    left = first.filter("NOT _met").drop("_met", "_said")
    rare = held.filter("NOT _often")
    rest = left.join(rare, same(left, rare, names, nulls), how).select(*[left[c] for c in rows.columns], "_said")
    return first.filter("_met").drop("_met").unionByName(rest).select(*rows.columns, *said)


def distinct_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with `copies`, counted before they are shuffled."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies"))


def _level(start: Column, end: Column) -> Column:
    """The smallest k with 2**k positions or more in the span."""
    return F.greatest(F.lit(0), F.ceil(F.log2((end - start + 1).cast("double")))).cast("int")


def containing(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "line", more: list[str] | None = None) -> DataFrame:
    """Each point with the first span (by start, then end) of its keys that contains it; nulls if none does.

    points: (keys, at, ...); spans: (keys, start, end, ...), both ends included; `more`: columns of the spans to hand on.
    Points are looked up once for each distinct position.  A span is put into the bins of width 2**k that it touches, k by its
    length, which are two at most; a position asks one bin of each level that occurs.  So spans and points meet in
    an equality join whose keys name a short stretch of a file, whatever a file holds.  A span with a null end or
    one that ends before it starts contains nothing; null keys contain nothing.
    """
    more = more or []
    spots = materialise(distinct_keys(points.select(*keys, at), [*keys, at]), "spots")
    return lookup(points, first_spans(spots, spans, keys, at, more), [*keys, at]).select(*points.columns, "start", "end", *more)


def first_spans(spots: DataFrame, spans: DataFrame, keys: list[str], at: str, more: list[str]) -> DataFrame:
    """Distinct positions (keys, at, ...) with start, end and `more` of the first span that contains each, as in `containing`."""
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    whole = spans.select(*keys, F.struct(start.alias("start"), end.alias("end"), *more).alias("_span"), _level(start, end).alias("_level")).filter("_span.start <= _span.end")
    bins = F.expr("sequence(shiftright(_span.start, _level), shiftright(_span.end, _level))")
    homes = materialise(whole.select(*keys, "_span", "_level", F.explode(bins).alias("_bin")), "spans")
    levels = [r[0] for r in homes.select("_level").distinct().collect()]  # LEVELS at most
    asked = spots.select(*keys, at, F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level"))
    asked = asked.withColumn("_bin", F.expr(f"shiftright(cast(`{at}` AS bigint), _level)"))
    met = asked.join(homes, [*keys, "_level", "_bin"]).filter((F.col("_span.start") <= F.col(at)) & (F.col(at) <= F.col("_span.end")))
    best = met.groupBy(*keys, at).agg(F.min_by("_span", F.struct("_span.start", "_span.end")).alias("_span"))
    kinds = {c: spans.schema[c].dataType for c in ("start", "end")}
    own = [F.col(f"_span.{c}").cast(kinds[c]).alias(c) if c in kinds else F.col(f"_span.{c}").alias(c) for c in ("start", "end", *more)]
    return spots.join(best, [*keys, at], "left").select(*spots.columns, *own)


def nearest(points: DataFrame, rows: DataFrame, keys: list[str], at: str, position: str, within: int) -> DataFrame:
    """(keys, at, distance): for each distinct point the nearest other row of the same keys at most `within` positions away, the
    earlier one of two; points without one are left out.

    Positions are cut into bins of 2 * within + 1, of which a point asks two at most; so however many rows share the keys, a
    point meets only those nearby.
    """
    width = 2 * within + 1
    spots = points.select(*keys, at).distinct()
    bins = F.array_distinct(F.array(F.floor((F.col(at) - within) / width), F.floor((F.col(at) + within) / width)))
    asked = spots.select("*", F.explode(bins).alias("_bin"))
    held = rows.select(*keys, F.col(position).alias("_position"), F.floor(F.col(position) / width).alias("_bin"))
    far = (F.col("_position") - F.col(at)).cast("int")
    met = asked.join(held, [*keys, "_bin"]).withColumn("_far", far).filter((F.abs("_far") <= within) & (F.col("_far") != 0))
    return met.groupBy(*keys, at).agg(F.min_by("_far", F.struct(F.abs("_far"), "_far")).alias("distance"))

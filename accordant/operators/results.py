"""Evaluation results: matrices, pivots, roll-ups, overlap regions, test runs, validation samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators.numbering import numbered


def result_matrix(results: DataFrame, instances: DataFrame, models: list[str]) -> DataFrame:
    """results: (model, instance, resolved).  One row per instance, a column per model: True, False or missing."""
    cells = results.groupBy("instance").pivot("model", models).agg(F.max("resolved"))
    said = [F.coalesce(F.initcap(F.col(f"`{m}`").cast("string")), F.lit("missing")).alias(m) for m in models]
    return instances.select("instance").distinct().join(cells, "instance", "left").select("instance", *said)


def count_pivot(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts as text, `-` for none; rows without any count don't appear."""
    out = df.groupBy(row).pivot(column, values).count()
    return out.select(row, *[F.coalesce(F.col(f"`{v}`").cast("string"), F.lit("-")).alias(v) for v in values])


#: Most columns that a pivot may get.
MOST_NAMES = 1000


def by_count(df: DataFrame, column: str) -> list[str]:
    """The column's values, the most frequent first, ties by name: names for columns, so more than MOST_NAMES are an error."""
    found = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"{column} has more than {MOST_NAMES} values, too many for columns")
    return [r[0] for r in found]


def ordered_pivot(df: DataFrame, row: str, column: str, prefix: str = "") -> DataFrame:
    """count_pivot with the column's values by falling count; the prefix is left out of the rows' names."""
    out = count_pivot(df, row, column, by_count(df.filter(F.col(column).isNotNull()), column))
    return out.withColumn(row, T.without_prefix(row, prefix))


def exit_of(runs: DataFrame, messages: DataFrame) -> DataFrame:
    """(model, instance, status) of each run without a report: the exit status of its last message of the role `exit`, `unknown` where
    that has none, no_exit_message, no_trajectory or no_instance_dir.

    runs: (model, instance, has_dir, has_trajectory); messages: (model, instance, pos, role, exit_status).
    """
    last = messages.filter("role = 'exit'").groupBy(F.col("model").alias("_m"), F.col("instance").alias("_i")).agg(F.max_by(F.struct("exit_status"), "pos").alias("last"))
    said = F.when(~F.col("has_dir"), "no_instance_dir").when(~F.col("has_trajectory"), "no_trajectory").when(F.col("last").isNull(), "no_exit_message")
    joined = runs.join(last, (F.col("model") == F.col("_m")) & (F.col("instance") == F.col("_i")), "left")
    return joined.select("model", "instance", F.coalesce(said, F.col("last.exit_status"), F.lit("unknown")).alias("status"))


def missing_reports(statuses: DataFrame) -> DataFrame:
    """(model, missing): of each model a JSON object of its instances without a report and their exit status, by instance."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("instance", "status"))), lambda x: F.struct(x["instance"], x["status"]))
    return statuses.groupBy("model").agg(F.to_json(F.map_from_entries(entries)).alias("missing"))


def resolved_sets(results: DataFrame) -> DataFrame:
    """(model, resolved): the instances that each model resolved, sorted."""
    return results.filter("resolved").groupBy("model").agg(F.array_sort(F.collect_set("instance")).alias("resolved"))


def coverage(region_counts: DataFrame, groups: list[str]) -> DataFrame:
    """(name, n) of regions: the union's size, and for each group the items that only it has."""
    only = F.when(F.length(F.replace("mask", F.lit("0"), F.lit(""))) == 1, F.get(F.array(*map(F.lit, groups)), F.instr("mask", "1") - 1))
    names = F.array(F.lit("union"), F.concat(F.lit("only "), only))
    return region_counts.select("n", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("name")).groupBy("name").agg(F.sum("n").alias("n"))


def rollup(df: DataFrame, by: str, resolved: str, places: int = 6) -> DataFrame:
    """Total, evaluated (not null), resolved (true), and the rate over the total."""
    return df.groupBy(by).agg(F.count("*").alias("total"), F.count(resolved).alias("evaluated"), F.count_if(resolved).alias("resolved")).withColumn("rate", F.round(F.col("resolved") / F.col("total"), places))


def regions(members: DataFrame, item: str, group: str, groups: list[str]) -> DataFrame:
    """(mask, n): how many items belong to exactly the groups marked 1, in the order of `groups`."""
    own = members.groupBy(item).agg(*[F.max(F.when(F.col(group) == g, 1).otherwise(0)).cast("string").alias(f"m{k}") for k, g in enumerate(groups)])
    return own.select(F.concat(*[F.col(f"m{k}") for k in range(len(groups))]).alias("mask")).filter(F.col("mask").contains("1")).groupBy("mask").agg(F.count("*").alias("n"))


def last_where(df: DataFrame, by: str, order: str, condition: Column, value: str) -> DataFrame:
    """Per group the value of the last row that fits, null if none does."""
    return df.groupBy(by).agg(F.max_by(F.when(condition, F.col(value)), F.when(condition, F.col(order))).alias(value))


def categorize(decisive: Column, message: Column) -> Column:
    """Bucket of a test case from its first decisive child (failure, error, skipped or null) and that child's message."""
    said = F.lower(F.coalesce(message, F.lit("")))
    expected = said.contains("expected test failure") | said.contains("xfail")
    unexpected = said.contains("unexpectedly passing") | said.contains("xpass")
    skipped = F.when(expected, "xfailed").when(unexpected, "passed").otherwise("skipped")
    return F.when(decisive.isin("failure", "error"), "failed").when(decisive == "skipped", skipped).otherwise("passed")


def node_id(classname: Column, file: Column, name: Column) -> Column:
    """file::Class::name where the class is below the file's module, file::name where it is the module or none, class::name
    elsewhere; the file or the name alone where the rest is missing."""
    classname, file, name = (F.coalesce(x, F.lit("")) for x in (classname, file, name))
    module = F.regexp_replace(F.replace(file, F.lit("/"), F.lit(".")), r"\.[^.]*$", "")
    joined = lambda *x: F.concat_ws("::", *x)
    below = joined(file, F.substr(classname, F.char_length(module) + 2), name)
    alone = F.when(classname == "", name).otherwise(joined(classname, name))
    return (
        F.when(file == "", alone)
        .when((classname == "") | (classname == module), F.when(name == "", file).otherwise(joined(file, name)))
        .when(F.startswith(classname, F.concat(module, F.lit("."))), below)
        .otherwise(joined(classname, name))
    )


#: Buckets of test cases (fixed values).
BUCKETS = ["passed", "failed", "skipped", "xfailed"]


def test_buckets(cases: DataFrame) -> DataFrame:
    """cases: (run, pos, bucket, node).  One row a run with its cases of each bucket as a list in document order."""
    own = lambda b: F.transform(F.sort_array(F.collect_list(F.when(F.col("bucket") == b, F.struct("pos", "node")))), lambda x: x["node"])
    return cases.groupBy("run").agg(*[own(b).alias(b) for b in BUCKETS])


def in_buckets(cases: DataFrame) -> DataFrame:
    """(run, bucket, pos, node) with the place inside the bucket, from 0: how runs are compared."""
    place = F.row_number().over(Window.partitionBy("run", "bucket").orderBy("pos")) - 1
    return cases.select("run", "bucket", place.alias("pos"), "node")


def flaky(cases: DataFrame) -> DataFrame:
    """(node, buckets): tests that are in different buckets in different runs."""
    return cases.groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("buckets")).filter(F.size("buckets") > 1)


def run_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, only_a, only_b): rows that one run has more often than the other; runs are equal if there is none."""
    both = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    n = both.groupBy(*keys).agg(F.sum("in_a").alias("x"), F.sum("in_b").alias("y")).filter("x <> y")
    return n.select(*keys, F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("only_a"), F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("only_b"))


def consecutive(events: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """The rows of each run's base, the run before it in the table, and those of the run itself, both with `run` and `base`; for
    any number of runs.  The first run, which has no base, and rows without a run are left out."""
    at = numbered(events.select(F.col(run).alias("run")).filter("run IS NOT NULL").distinct(), ["run"])
    pairs = at.join(at.select(F.col("run").alias("base"), (F.col("at") + 1).alias("at")), "at").select("run", "base")
    own = events.select(*[c for c in events.columns if c not in ("run", "base")], F.col(run).alias("_run"))
    return tuple(own.join(pairs, F.col("_run") == F.col(c)).drop("_run") for c in ("base", "run"))


def as_text(wide: DataFrame, row: str) -> DataFrame:
    """(row, cells): the other columns of a wide table as `name=cell`, comma-joined in the columns' order."""
    cells = [F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in wide.columns if c != row]
    return wide.select(row, F.concat_ws(",", *cells).alias("cells"))


def sample_rank(key: Column, seed: int) -> Column:
    """A number that orders whole-number keys at random, the same in any engine: a multiplicative hash modulo 2**31 - 1."""
    return F.pmod((F.pmod(key, F.lit(2147483647)) + seed) * F.lit(48271), F.lit(2147483647))


def validation_sheet(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n sampled rows with the column swap: whether the two texts change places."""
    drawn = rows.orderBy(sample_rank(F.col(key), seed), key).limit(n)
    return drawn.withColumn("swap", F.pmod(sample_rank(F.col(key), seed + 1), F.lit(2)) == 0)


def request_grid(instances: DataFrame, providers: list[str], instance: str = "instance", limit: int = 0) -> DataFrame:
    """Two orderings for each provider and instance, numbered c0, c1, ... in order of instance, ordering, provider.

    limit: only the first so many instances, 0 for all.
    """
    if not providers:
        raise ValueError("no jurors are left")
    ids = instances.select(F.col(instance).alias("instance")).distinct()
    ranked = numbered(ids, ["instance"])
    ranked = ranked.filter(F.col("at") < limit) if limit else ranked
    names = F.array(*[F.struct(F.lit(k).alias("p"), F.lit(v).alias("provider")) for k, v in enumerate(providers)])
    grid = ranked.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordering")).select("*", F.explode(names).alias("x"))
    return grid.select(F.concat(F.lit("c"), ((F.col("at") * 2 + F.col("ordering")) * len(providers) + F.col("x.p")).cast("string")).alias("cid"), "instance", "ordering", F.col("x.provider").alias("provider"))


def chosen(providers: list[str], asked: str | None) -> list[str]:
    """The providers that a comma list names, in their own order; all without a list; an error if none is left."""
    names = None if asked is None else {x.strip() for x in asked.split(",")}
    found = [p for p in providers if names is None or p in names]
    if not found:
        raise ValueError(f"none of {asked!r} is one of {providers}")
    return found


def fields_long(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key and field: (key, field, content), null contents as ''."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("content")) for f in fields])
    return df.select(key, F.explode(parts).alias("x")).select(key, "x.*")


def with_status(statuses: DataFrame, *status: str, limit: int = 0) -> DataFrame:
    """(at, unit): the units that have one of the statuses, numbered from 0 by id; limit: only the first so many, 0 for all."""
    found = numbered(statuses.filter(F.col("status").isin(*status)).select("unit"), ["unit"]).select("at", "unit")
    return found.filter(F.col("at") < limit) if limit else found


def members(instances: DataFrame, pilot: DataFrame, key: str = "instance") -> DataFrame:
    """The instances whose id a list of pilots (key) has, as often as they stand; Spark sends the list around if it is short."""
    return instances.join(pilot.select(key).distinct(), key, "left_semi").select(*instances.columns)


def first_seen_counts(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(at, column, n): how often each value occurs, the most frequent first, of equally frequent ones the first seen in the order."""
    found = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return numbered(found.withColumn("_less", -F.col("n")), ["_less", "_first"]).select("at", column, "n")


def flagged(aggregated: DataFrame) -> DataFrame:
    """The flagged units numbered from 0 by id, with final, order0, order1 and flag_reason: what a person looks at."""
    return numbered(aggregated.filter("flagged").select("unit", "final", "order0", "order1", "flag_reason"), ["unit"])

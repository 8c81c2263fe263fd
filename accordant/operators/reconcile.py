"""Matching two raters' locations in several passes, and what follows from the matches.

Every pass pairs locations that agree on a key, the i-th of one side with the i-th of the other, in order; what is
left goes to the next pass.  All keys hold the file, so the whole operator needs one shuffle by unit and file: a
location is matched in a pass if its place in its class is not beyond the other side's count, and pairs are put
together by a last aggregation on the same keys.  A unit with very many locations is split by file.  The sorts of all
passes stand in one stage and keep their memory to its end, so its tasks get a fixed share of the rows (`pieces`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators.joins import pieces

#: Largest line shift that counts as minor.
TOLERANCE = 10


def match(locs: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """locs: (unit, side 'A' or 'B', idx, file, line, stmt), compared as given (normalise before).

    Returns (unit, file, step, type, severity, a_idx, b_idx, line_delta, same_file): step 1 to 4 for pairs, 5 for
    locations of one side only; same_file says whether the other side has any location in that file.  Null lines
    equal each other; a null line on either side has no delta and blocks.
    """
    rows = locs.select("unit", "side", "idx", "file", "line", "stmt", T.loose_stmt("stmt").alias("loose")).repartition(pieces(locs), "unit", "file")
    rows = rows.withColumns({"step": F.lit(None).cast("int"), "place": F.lit(None).cast("long"), "k_line": F.lit(None).cast(rows.schema["line"].dataType), "k_text": F.lit(None).cast("string")})
    peers = None
    for step, (line, words) in enumerate((("line", "stmt"), (None, "stmt"), ("line", None), (None, "loose")), 1):
        # One sort a pass: by key, side and place.  The i-th of B stands behind all of A, and counts need no order.
        # Keys are columns, as Spark sorts again for each window whose key holds an expression.
        rows = rows.withColumn("_free", F.col("step").isNull())
        key = ["unit", "file", "_free", *[c for c in (words, line) if c]]
        cls = Window.partitionBy(*key)
        rows = rows.withColumn("_rank", F.row_number().over(cls.orderBy("side", "idx")).cast("long"))
        rows = rows.withColumns({"_a": F.count_if(F.col("side") == "A").over(cls), "_all": F.count("*").over(cls)})
        if peers is None:
            whole = Window.partitionBy("unit", "file")
            peers = F.when(F.col("side") == "A", F.count_if(F.col("side") == "B").over(whole)).otherwise(F.count_if(F.col("side") == "A").over(whole))
            rows = rows.withColumn("peers", peers)
        first = F.col("side") == "A"
        place = F.when(first, F.col("_rank")).otherwise(F.col("_rank") - F.col("_a"))
        hit = F.col("step").isNull() & (place <= F.when(first, F.col("_all") - F.col("_a")).otherwise(F.col("_a")))
        changes = {"step": F.when(hit, step).otherwise(F.col("step")), "place": F.when(hit, place).otherwise(F.col("place"))}
        if line:
            changes["k_line"] = F.when(hit, F.col(line)).otherwise(F.col("k_line"))
        if words:
            changes["k_text"] = F.when(hit, F.col(words)).otherwise(F.col("k_text"))
        rows = rows.withColumns(changes).drop("_free", "_a", "_all", *(["_rank"] if step < 4 else []))
    # What no pass took is a pair of one: its rank in the last pass, whose class has no other such row, tells it apart.
    alone = F.col("step").isNull()
    rows = rows.withColumns({"step": F.coalesce("step", F.lit(5)), "place": F.when(alone, F.col("_rank")).otherwise(F.col("place")), "k_text": F.when(alone, F.col("loose")).otherwise(F.col("k_text"))})
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("idx", "line", "loose")))
    pairs = rows.groupBy("unit", "file", "step", "k_line", "k_text", "place").agg(side("A").alias("a"), side("B").alias("b"), F.max("peers").alias("peers"))
    pairs = pairs.select(
        "unit", "file", "step", F.col("a.idx").alias("a_idx"), F.col("b.idx").alias("b_idx"), F.abs(F.col("a.line") - F.col("b.line")).alias("line_delta"),
        F.coalesce(F.col("a.loose") == F.col("b.loose"), F.lit(False)).alias("_loose"), ((F.col("step") < 5) | (F.col("peers") > 0)).alias("same_file"),
    )
    near = F.coalesce(F.col("line_delta") <= tolerance, F.lit(False))
    kind = F.when(F.col("step") == 1, "agreed").when(F.col("step") == 2, "line_mismatch").when((F.col("step") == 3) & F.col("_loose"), "statement_formatting")
    kind = kind.when(F.col("step") == 3, "statement_mismatch").when(F.col("step") == 4, "line_and_formatting_mismatch").otherwise("extra_location")
    severity = F.when(F.col("step") == 1, "none").when(F.col("step").isin(2, 4) & near, "minor").when((F.col("step") == 3) & F.col("_loose"), "minor").otherwise("blocking")
    return pairs.select("unit", "file", "step", kind.alias("type"), severity.alias("severity"), "a_idx", "b_idx", "line_delta", "same_file")


def _dealt(parts: int | None, *tables: DataFrame) -> list[DataFrame]:
    """The tables dealt by unit to `parts` partitions, where they are grouped and joined without another shuffle; None: as they are."""
    return [t.repartition(parts, "unit") for t in tables] if parts else list(tables)


def status(units: DataFrame, matches: DataFrame, parts: int | None = None) -> DataFrame:
    """(unit, status): conflict with any blocking match, minor_conflict with any minor one, else agree.

    units may be the matches themselves.  parts: how many partitions to deal units to (`pieces`), else the session's number.
    """
    (own,) = _dealt(parts, matches.select("unit", "severity"))
    worst = own.groupBy("unit").agg(F.max(F.when(F.col("severity") == "blocking", 2).when(F.col("severity") == "minor", 1).otherwise(0)).alias("worst"))
    named = F.when(F.col("worst") == 2, "conflict").when(F.col("worst") == 1, "minor_conflict").otherwise("agree")
    if units is not matches:
        (asked,) = _dealt(parts, units.select("unit"))
        worst = asked.distinct().join(worst, "unit", "left")
    return worst.select("unit", named.alias("status"))


def counts(matches: DataFrame, parts: int | None = None) -> DataFrame:
    """(kind, name, n, share): units by status and matches by type, of one pass over the matches; parts as in `status`."""
    types = ["agreed", "line_mismatch", "statement_formatting", "statement_mismatch", "line_and_formatting_mismatch", "extra_location"]
    worst = F.max(F.when(F.col("severity") == "blocking", 2).when(F.col("severity") == "minor", 1).otherwise(0))
    (own,) = _dealt(parts, matches.select("unit", "severity", "type"))
    unit = own.groupBy("unit").agg(worst.alias("worst"), *[F.count_if(F.col("type") == t).alias(t) for t in types])
    named = F.when(F.col("worst") == 2, "conflict").when(F.col("worst") == 1, "minor_conflict").otherwise("agree")
    row = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"))
    found = unit.select(F.explode(F.array(row("status", named, F.lit(1)), *[row("type", F.lit(t), F.col(t)) for t in types])).alias("x")).groupBy("x.kind", "x.name").agg(F.sum("x.n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("kind"))
    return found.filter("n > 0").select("kind", "name", "n", F.round(F.col("n") / whole, 6).alias("share"))


def field_diffs(pairs: DataFrame, key: str, always: dict[str, tuple[str, str]], if_both: dict[str, tuple[str, str]]) -> DataFrame:
    """Long-form differences (key, field, a, b): `always` fields compare nulls as values, `if_both` only where neither is null."""
    tests = [(k, a, b, ~F.col(a).eqNullSafe(F.col(b))) for k, (a, b) in always.items()]
    tests += [(k, a, b, F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))) for k, (a, b) in if_both.items()]
    found = F.array(*[F.when(t, F.struct(F.lit(k).alias("field"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))) for k, a, b, t in tests])
    return pairs.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def call_site_diffs(sites: DataFrame) -> DataFrame:
    """sites: (unit, side, file, line, stmt), compared as given (normalise before).  (unit, a, b) of the units whose sorted lists
    differ: nulls stand last inside a file, repeated sites count, and a side without sites has an empty list."""
    site = F.struct(F.coalesce("file", F.lit("")).alias("file"), F.col("line").isNull().alias("none"), F.coalesce("line", F.lit(0)).alias("at"), F.coalesce("stmt", F.lit("")).alias("stmt"))
    own = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, site)))
    shown = lambda c: F.transform(c, lambda x: F.concat(x["file"], F.lit(":"), F.when(x["none"], "None").otherwise(x["at"].cast("string")), F.lit("  "), x["stmt"]))
    both = sites.groupBy("unit").agg(own("A").alias("a"), own("B").alias("b"))
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("unit", shown("a").alias("a"), shown("b").alias("b"))


def resolve(statuses: DataFrame, resolutions: DataFrame, names: dict[str, str] | None = None, include_minor: bool = False, parts: int | None = None) -> DataFrame:
    """(unit, status, final, choice, mergeable) under a table (unit, choice): A or B in either case, skip, or a rater's name; blanks
    around it don't count, others say nothing.

    final: skipped_by_resolution, resolved (also where both agreed) or the status; mergeable: agreed, resolved, or minor if asked for.
    parts as in `status`.
    """
    said = F.trim("choice")
    choice = F.when(F.upper(said).isin("A", "B"), F.upper(said)).otherwise(said)
    for name, side in (names or {}).items():
        choice = F.when(said == name, side).otherwise(choice)
    statuses, resolutions = _dealt(parts, statuses, resolutions)
    known = resolutions.select("unit", choice.alias("choice")).filter(F.col("choice").isin("A", "B", "skip")).groupBy("unit").agg(F.max("choice").alias("choice"))
    final = F.when(F.col("choice") == "skip", "skipped_by_resolution").when(F.col("choice").isNotNull(), "resolved").otherwise(F.col("status"))
    good = ["agree", "resolved"] + (["minor_conflict"] if include_minor else [])
    return statuses.join(known, "unit", "left").select("unit", "status", final.alias("final"), "choice", final.isin(*good).alias("mergeable"))


def views(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocking and the minor matches."""
    return matches.filter("severity = 'blocking'"), matches.filter("severity = 'minor'")


def merged(resolved: DataFrame, matches: DataFrame, documents: DataFrame, diffs: DataFrame, primary: str = "A") -> DataFrame:
    """One row for each unit of `resolved` that isn't skipped: the document of the side that won (else the primary one) and
    `merge_metadata`.

    documents: (unit, side, document, reasoning, n_locations: raw entries, odd ones too).  The metadata has the status, the
    primary side, the exact matches and the raw entries of both, the other side's reasoning, the conflicts (under
    unresolved_conflicts or, with a resolution, resolved_conflicts) and the other differences (diffs: unit, field, a, b).

    Matches are counted and read, so they should be a written table.  All tables are dealt by unit to as many partitions as
    they ask for, where units are listed and joined without another shuffle.
    """
    n = pieces(matches, documents)
    resolved, matches, documents, diffs = _dealt(n, resolved, matches, documents, diffs)
    found = F.struct("step", "type", "severity", "file", "a_idx", "b_idx", "line_delta")
    conflicts = matches.groupBy("unit").agg(F.count_if(F.col("step") == 1).alias("exact"), F.sort_array(F.collect_list(F.when(F.col("step") > 1, found))).alias("conflicts"))
    other = diffs.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("field", "a", "b"))).alias("informational"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("document", "reasoning", "n_locations")))
    both = documents.groupBy("unit").agg(side("A").alias("doc_a"), side("B").alias("doc_b"))
    rows = resolved.filter("final <> 'skipped_by_resolution'").join(both, "unit").join(conflicts, "unit", "left").join(other, "unit", "left")
    won = F.coalesce(F.when(F.col("choice").isin("A", "B"), F.col("choice")), F.lit(primary))
    by_choice = F.col("choice").isNotNull()
    listed = F.when(F.size("conflicts") > 0, F.col("conflicts"))
    return rows.select(
        "unit",
        F.when(won == "A", F.col("doc_a.document")).otherwise(F.col("doc_b.document")).alias("document"),
        F.struct(
            F.col("final").alias("status"),
            won.alias("primary"),
            F.when(by_choice, won).alias("resolved_in_favour_of"),
            F.coalesce("exact", F.lit(0)).alias("exact_matches"),
            F.col("doc_a.n_locations").alias("locations_a"),
            F.col("doc_b.n_locations").alias("locations_b"),
            F.when(won == "A", F.col("doc_b.reasoning")).otherwise(F.col("doc_a.reasoning")).alias("other_reasoning"),
            F.when(~by_choice, listed).alias("unresolved_conflicts"),
            F.when(by_choice, F.col("conflicts")).alias("resolved_conflicts"),
            F.when(F.size("informational") > 0, F.col("informational")).alias("informational_differences"),
        ).alias("merge_metadata"),
        "mergeable",
    )


def decide(agreed: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (unit, choice, priority) of two tables (unit, choice, row: place in the table): an id in both follows the conflict
    table, an id twice in one table its last row.  Ids and choices are trimmed.

    The second result holds what a person should hear of: unknown choices, and ids that the conflict table takes over.
    Rows with a blank id vanish.
    """
    tables = [t.select(F.trim("unit").alias("unit"), F.trim("choice").alias("choice"), F.lit(k).alias("priority"), "row") for k, t in enumerate((agreed, conflicts))]
    rows = tables[0].unionByName(tables[1]).filter(F.coalesce("unit", F.lit("")) != "")
    known = F.coalesce(F.col("choice").isin("A", "B") | ((F.col("priority") == 0) & (F.col("choice") == "Both")), F.lit(False))
    best = rows.filter(known).groupBy("unit").agg(F.max(F.struct("priority", "row", "choice")).alias("d"), F.count_distinct("priority").alias("n"))
    good = best.select("unit", "d.choice", "d.priority")
    unknown = rows.filter(~known).select("unit", "choice", "priority", F.lit("unexpected choice, skipped").alias("warning"))
    taken = best.filter("n > 1").select("unit", "d.choice", "d.priority", F.lit("also in the agreed table, overwriting").alias("warning"))
    return good, unknown.unionByName(taken)


def decided_reasoning(decisions: DataFrame, reasoning: DataFrame) -> DataFrame:
    """(unit, annotator1, annotator2, comments) by the decision: both reasonings for Both, else that of the side chosen, '' for the
    other.  reasoning: (unit, a, b); a null one is ''."""
    held = lambda c, *who: F.when(F.col("choice").isin(*who), F.coalesce(c, F.lit(""))).otherwise("")
    comments = F.when(F.col("priority") == 0, "both agreed").when(F.col("choice") == "A", "annotator1").otherwise("annotator2")
    return decisions.join(reasoning, "unit").select("unit", held("a", "Both", "A").alias("annotator1"), held("b", "Both", "B").alias("annotator2"), comments.alias("comments"))


def with_base_commit(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows (instance_id, ...) with the base_commit of their instance, of several the first by `row`; '' where there is none."""
    first = commits.groupBy(F.col("instance_id").alias("_id")).agg(F.min_by("base_commit", "row").alias("base_commit"))
    return rows.join(first, F.col("instance_id") == F.col("_id"), "left").drop("_id").withColumn("base_commit", F.coalesce("base_commit", F.lit("")))


def label_sets(labels: DataFrame, agreed: DataFrame) -> DataFrame:
    """(unit, membership): labelled (both), not_agreed (only labelled) or unlabeled (only agreed); labels and agreed have a column unit."""
    both = labels.select("unit", F.lit(1).alias("l"), F.lit(0).alias("a")).unionByName(agreed.select("unit", F.lit(0).alias("l"), F.lit(1).alias("a")))
    own = both.groupBy("unit").agg(F.max("l").alias("l"), F.max("a").alias("a"))
    return own.select("unit", F.when((F.col("l") == 1) & (F.col("a") == 1), "labelled").when(F.col("l") == 1, "not_agreed").otherwise("unlabeled").alias("membership"))

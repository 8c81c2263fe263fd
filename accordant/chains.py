"""From files to files: merging two raters' folders, ground truth from decisions, its flat table, and statement checks.

Every chain reads tables or folders of a shared store, runs the operators, and writes new folders; nothing is changed in
place.  What operators write on their way is given up at the end.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators import agreement, documents, reconcile, statements
from accordant.scratch import materialise, scratch
from accordant.sources import committed, readers, sinks

#: Lists of ids that a merge always writes, and those that it writes with ids alone, by the status that fills them (fixed values).
ALWAYS = {"agreed": ["agree"], "conflicts": ["conflict", "minor_conflict"]}
OPTIONAL = {"conflicts_blocking": ["conflict"], "conflicts_minor": ["minor_conflict"], "resolved": ["resolved"], "skipped_by_resolution": ["skipped_by_resolution"]}
GRANULARITIES = ["file", "statement", "line", "full"]
#: Folders of classified statements (fixed values).
BUCKETS = {"good": "statements-good", "safe": "statements-safe-apply", "unsafe": "statements-unsafe-apply"}


def _elements(located: DataFrame) -> DataFrame:
    """Locations as elements of the two raters' sets, at each granularity."""
    kinds = {"file": ["file"], "statement": ["file", "stmt"], "line": ["file", "line"], "full": ["file", "line", "stmt"]}
    each = F.array(*[F.struct(F.lit(g).alias("granularity"), F.to_json(F.struct(*c)).alias("item")) for g, c in kinds.items()])
    return located.select("unit", "side", F.explode(each).alias("x")).select("x.granularity", "unit", "side", "x.item")


def resolutions_of(spark: SparkSession, path: str) -> DataFrame:
    """(unit, choice) of a JSON file that maps units to choices."""
    held = F.from_json("value", "map<string, string>")
    return spark.read.text(path, wholetext=True).select(F.explode(held).alias("unit", "choice"))


def merge_folders(
    spark: SparkSession, folder_a: str, folder_b: str, out: str, report: str, name_a: str, name_b: str, primary: str | None = None, resolutions: DataFrame | None = None, write: bool = True, include_minor: bool = False
) -> None:
    """Compares the documents that both folders have; writes the merged ones (out/unit=<id>), and below `report` the instances
    and the summary as JSON lines, and the lists of ids with a manifest.

    write: without it only the report is written; include_minor: units with minor conflicts alone are merged too.
    """
    primary = primary or name_a
    if primary not in (name_a, name_b):
        raise ValueError(f"{primary!r} is neither {name_a!r} nor {name_b!r}")
    with scratch(spark):
        pairs = documents.pairs_of(readers.json_documents(spark, folder_a), readers.json_documents(spark, folder_b))
        compared, matches = documents.compared(pairs, name_a, name_b)
        units, matches = materialise(compared, "units"), materialise(matches.drop("said"), "matches")
        choices = resolutions if resolutions is not None else spark.createDataFrame([], "unit string, choice string")
        final = materialise(reconcile.resolve(units.select("unit", "status"), choices, {name_a: "A", name_b: "B"}, include_minor), "final")
        if write:
            docs = documents.merged(units, final, name_a, name_b, primary).filter("mergeable")
            docs.select("unit", F.to_json("doc").alias("value")).write.mode("overwrite").partitionBy("unit").text(out)
        known = final.select(F.col("unit").alias("_f"), "final", "choice", "mergeable")
        rows = units.join(known, F.col("unit") == F.col("_f"))
        resolution = F.when(F.col("choice") == "A", name_a).when(F.col("choice") == "B", name_b).otherwise(F.col("choice"))
        said = documents.json_object(
            {
                "instance_id": documents.json_of(F.col("unit")),
                "status": documents.json_of(F.col("final")),
                "annotators": F.lit(json.dumps([name_a, name_b])),
                "n_a": documents.json_of(F.col("n_a")),
                "n_b": documents.json_of(F.col("n_b")),
                "agreed": F.col("agreed"),
                "conflicts": F.col("conflicts"),
                "informational": F.col("informational"),
                "resolution": F.when(F.col("choice").isNotNull(), documents.json_of(resolution)),
                "conflict_status_before_skip": F.when(F.col("choice") == "skip", documents.json_of(F.col("status"))),
                "mergeable": documents.json_of(F.col("mergeable")),
            }
        )
        rows.select("unit", said.alias("value")).orderBy("unit").select("value").write.mode("overwrite").text(f"{report}/instances")
        metrics = agreement.agreement_report(_elements(documents.sites(pairs, "root_cause")), units, granularities=GRANULARITIES)
        measured = {r["granularity"]: {c: r[c] for c in ("jaccard_macro", "jaccard_micro", "dice", "alpha")} for r in metrics.collect()}
        counted = lambda df, c: dict(sorted(df.groupBy(c).count().collect()))  # noqa: E731  a row for each status or type
        summary = {"annotator_a": name_a, "annotator_b": name_b, "primary": primary, "line_shift_tolerance": reconcile.TOLERANCE}
        summary |= {"counts": counted(final, "final"), "agreement_metrics": measured, "conflict_types": counted(matches.filter("step > 1"), "type")}
        spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{report}/summary")
        named = [F.when(F.col("final").isin(own), name) for name, own in (ALWAYS | OPTIONAL).items()]
        named = F.array_compact(F.array(*named, F.when(F.col("mergeable"), "merged")))
        ids = final.select(F.explode(named).alias("list"), F.col("unit").alias("value"))
        committed.write_report(ids, f"{report}/ids", [*ALWAYS, "merged"])


def decided_documents(spark: SparkSession, agreed: DataFrame, conflicts: DataFrame, folder_a: str, folder_b: str, out: str) -> DataFrame:
    """Writes a ground-truth document (out/unit=<id>) for each decision of two tables (unit, choice, row); returns the warnings."""
    good, warnings = reconcile.decide(agreed, conflicts)
    docs = documents.ground_truth(good, readers.json_documents(spark, folder_a), readers.json_documents(spark, folder_b))
    docs.select("unit", F.to_json("doc").alias("value")).write.mode("overwrite").partitionBy("unit").text(out)
    return warnings


def flat_rows(docs: DataFrame, commits: DataFrame) -> DataFrame:
    """(instance_id, base_commit, file, line, statements), all strings: a row for each location, one with blanks for a document
    without any.  docs: (instance_id, stem, doc); commits: (instance_id, base_commit, row)."""
    entries = F.try_variant_get("doc", "$.root_cause", "array<variant>")
    each = docs.select("instance_id", F.posexplode_outer(F.when(F.size(entries) > 0, entries)).alias("idx", "e"))
    text = lambda k: F.coalesce(F.try_variant_get("e", f"$.{k}", "string"), F.lit(""))
    rows = each.select("instance_id", "idx", text("file").alias("file"), text("line").alias("line"), text("statement").alias("statements"))
    return reconcile.with_base_commit(rows, commits).select("instance_id", "base_commit", "file", "line", "statements")


def check_table(spark: SparkSession, table: str, sources: DataFrame, out: str) -> None:
    """A CSV of recorded statements to three: checked (out/checked), extracted (out/extracted, with spans by instance as JSON in
    out/spans), and classified (a folder each of BUCKETS)."""
    with scratch(spark):
        rows = readers.csv_table(spark, table).na.fill("")
        sinks.csv_with_header(statements.check_rows(rows, sources), f"{out}/checked")
        found = materialise(statements.extract(rows, sources), "extracted")
        sinks.csv_with_header(found, f"{out}/extracted")
        statements.spans_by_instance(found).select(F.to_json(F.struct("instance_id", "spans")).alias("value")).write.mode("overwrite").text(f"{out}/spans")
        classified = materialise(statements.classify(found), "classified")
        for bucket, name in BUCKETS.items():
            sinks.csv_with_header(classified.filter(F.col("bucket") == bucket).drop("bucket", "ratio"), f"{out}/{name}")


def shown(text, most: int = 120):
    """A statement as a summary shows it: on one line, cut off after `most` characters."""
    return F.left(T.collapse(text), F.lit(most))

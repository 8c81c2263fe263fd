"""Unified diffs as rows, and line numbers carried through them.

A patch is cut into files and hunks by column functions: no line of a hunk starts with `diff --git ` or `@@ `, so these
two cut it safely, and names are only read in front of a file's first hunk.  Each run of changed lines is an edit; between
two edits all lines move by the same number, so a file's old lines are carried by segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators.joins import containing
from accordant.scratch import materialise

#: Where a file's last segment ends.
LAST = (1 << 62) - 1
_HEAD = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def _name(head: Column, mark: str) -> Column:
    """The file that a `--- ` or `+++ ` line names, without a/ or b/ and without a time stamp; null for /dev/null and none."""
    said = F.regexp_extract(head, rf"(?m)^{mark} (.*)$", 1)
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, "[\t\r].*$", ""), '^"?[ab]/|"$', "")
    return T.let(said, lambda x: F.when((x != "") & ~x.startswith("/dev/null"), plain(x)))


def hunks(patches: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, old_file, new_file, hunk, old_start, old_count, new_start, new_count, lines): the hunks of each patch, from 0 a file.

    old_file is null for a new file, new_file for one that goes.  lines: those of the hunk with their sign, as many as the head says.
    """
    body = F.coalesce(text, F.lit(""))
    git = F.split(body, r"(?m)^(?=diff --git )", -1)
    plain = F.split(body, r"(?m)^(?=--- [^\n]*\n\+\+\+ [^\n]*\n@@ )", -1)
    files = patches.select(*keys, F.posexplode(F.when(body.rlike(r"(?m)^diff --git "), git).otherwise(plain)).alias("_file", "_x"))
    parts = F.split("_x", r"(?m)^(?=@@ -)", -1)
    files = files.select(*keys, "_file", parts.alias("_parts")).filter(F.size("_parts") > 1)
    head = F.get("_parts", 0)
    each = files.select(*keys, "_file", _name(head, "---").alias("old_file"), _name(head, r"\+\+\+").alias("new_file"), F.posexplode(F.slice("_parts", 2, 1 << 30)).alias("hunk", "_h"))
    # One look at a head for its four numbers.
    each = each.filter(F.col("_h").rlike(_HEAD)).withColumn("_n", F.split(F.regexp_replace("_h", _HEAD + "(?s:.*)", "$1 $2 $3 $4"), " ", -1))
    number = lambda k: F.get("_n", k - 1)
    count = lambda k: F.when(number(k) == "", 1).otherwise(number(k).try_cast("int"))
    each = each.select(
        *keys, "_file", "old_file", "new_file", "hunk", *[c.alias(n) for c, n in ((number(1).cast("long"), "old_start"), (count(2), "old_count"), (number(3).cast("long"), "new_start"), (count(4), "new_count"))], F.slice(F.split("_h", "\n", -1), 2, 1 << 30).alias("lines")
    )
    return each


def _lines(found: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of hunks with `_old` and `_new`: how many lines of the old and of the new file the hunk has before each."""
    own = [*keys, "_file", "hunk"]
    rows = found.select(*own, "old_file", "new_file", "old_start", "old_count", "new_start", "new_count", F.posexplode("lines").alias("_pos", "_line"))
    sign = F.when(F.trim(F.translate("_line", "\r", "")) == "", " ").otherwise(F.left("_line", F.lit(1)))  # an empty line is an empty context line
    before = Window.partitionBy(*own).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.count_if(c).over(before), F.lit(0))
    rows = rows.withColumn("_sign", sign).filter(F.col("_sign").isin(" ", "+", "-"))
    rows = rows.withColumns({"_old": seen(F.col("_sign") != "+"), "_new": seen(F.col("_sign") != "-")})
    # What stands behind the lines that the head counts is no part of the hunk.
    return rows.filter(F.when(F.col("_sign") == "+", F.col("_new") < F.col("new_count")).when(F.col("_sign") == "-", F.col("_old") < F.col("old_count")).otherwise((F.col("_old") < F.col("old_count")) & (F.col("_new") < F.col("new_count"))))


def edits(patches: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, old_file, new_file, at, removed, added): each run of changed lines, `at` the first old line it takes the place of
    (or stands in front of)."""
    rows = _lines(hunks(patches, keys, text), keys)
    same = Window.partitionBy(*keys, "_file", "hunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Changed lines with as many context lines before them are one run; a head that counts no old lines names the line before.
    rows = rows.withColumn("_run", F.count_if(F.col("_sign") == " ").over(same)).filter("_sign <> ' '")
    start = F.col("old_start") + F.when(F.col("old_count") == 0, 1).otherwise(0)
    found = rows.groupBy(*keys, "_file", "hunk", "_run").agg(
        F.first("old_file").alias("old_file"), F.first("new_file").alias("new_file"), F.min(start + F.col("_old")).alias("at"), F.count_if(F.col("_sign") == "-").alias("removed"), F.count_if(F.col("_sign") == "+").alias("added")
    )
    return found.select(*keys, "old_file", "new_file", "at", "removed", "added")


def segments(changed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_file, new_file, start, end, shift): the stretches of old lines that stay, and by how much they move.

    changed: what `edits` returns.  The last stretch of a file has no end (LAST).  A file that goes has none.
    """
    own = [*keys, "old_file"]
    order = Window.partitionBy(*own).orderBy("at", "removed")  # what stands in front of a line comes before its removal
    all_of = changed.filter("old_file IS NOT NULL")
    shift = F.sum(F.col("added") - F.col("removed")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    behind = all_of.select(*own, "new_file", (F.col("at") + F.col("removed")).alias("start"), F.coalesce(F.lead("at").over(order) - 1, F.lit(LAST)).alias("end"), shift.alias("shift"))
    first = all_of.groupBy(*own).agg(F.first("new_file").alias("new_file"), F.lit(1).cast("long").alias("start"), (F.min("at") - 1).alias("end"), F.lit(0).cast("long").alias("shift"))
    return first.unionByName(behind).filter((F.col("start") <= F.col("end")) & F.col("new_file").isNotNull())


def carried(points: DataFrame, changed: DataFrame, keys: list[str], file: str = "file", line: str = "line") -> DataFrame:
    """The points (keys, file, line, ...) with new_file and new_line: where the patch of their keys puts their line, null where
    it takes the line away.  Files that the patch doesn't touch keep their lines."""
    changed = materialise(changed, "edits")  # read three times
    spans = segments(changed, keys).withColumnRenamed("old_file", file)
    touched = changed.select(*keys, F.col("old_file").alias(file)).filter(F.col(file).isNotNull()).distinct().withColumn("_touched", F.lit(True))
    found = containing(points, spans, [*keys, file], line, ["new_file", "shift"])
    found = found.join(touched, [*keys, file], "left")
    stays = F.col("_touched").isNull()
    return found.select(
        *[F.col(f"`{c}`") for c in points.columns],
        F.when(stays, F.col(file)).otherwise(F.col("new_file")).alias("new_file"),
        F.when(stays, F.col(line)).otherwise(F.col(line) + F.col("shift")).cast("long").alias("new_line"),
    )


def truth_differences(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, only_expected, only_carried): where the recorded lines of variants (keys, lines) differ from those that old lines
    carried through the variants' patches give (keys, new_line); sorted, without repeats."""
    held = found.filter("new_line IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("new_line").cast("long"))).alias("_found"))
    none = F.array().cast("array<bigint>")
    both = expected.select(*keys, F.array_sort(F.array_distinct(F.col("lines").cast("array<bigint>"))).alias("_said")).join(held, keys, "full")
    said, got = F.coalesce("_said", none), F.coalesce("_found", none)
    return both.select(*keys, F.array_except(said, got).alias("only_expected"), F.array_except(got, said).alias("only_carried")).filter(F.size("only_expected") + F.size("only_carried") > 0)

"""Annotation documents as VARIANT: setting and dropping fields, conflicts of two raters in full, merged documents, ground truth.

Documents keep whatever fields they have; what is added is put together as JSON text and parsed once.  The names of fields and
types of what is added are fixed values that readers of these documents know.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators import reconcile
from accordant.operators.joins import same

#: Fields that differ only where both documents have a value.
FLAGS = ["multi_rc", "rc_ftcs_same", "hunk_type", "fault_inducing", "rc_in_this_hunk", "is_defensive"]


def json_of(value: Column) -> Column:
    """The JSON text of any value, `null` of a null."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.coalesce(F.substring(listed, F.lit(2), F.char_length(listed) - 2), F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """The JSON text of an object from its fields' JSON texts; fields whose text is null are left out."""
    said = F.concat_ws(",", *[F.concat(F.lit(json.dumps(k) + ":"), v) for k, v in fields.items()])
    return F.concat(F.lit("{"), said, F.lit("}"))


def _fields(doc: Column) -> Column:
    return doc.cast("map<string,variant>")


def with_field(doc: Column, name: str, text: Column) -> Column:
    """The document with the field set to what the JSON text says, all other fields as they are."""
    rest = F.map_filter(_fields(doc), lambda k, _: k != name)
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(name), F.parse_json(text))))


def without_field(doc: Column, *names: str) -> Column:
    """The document without the fields."""
    return F.to_variant_object(F.map_filter(_fields(doc), lambda k, _: ~k.isin(*names)))


def field(doc: Column | str, name: str) -> Column:
    """A field as VARIANT; null where it isn't there or null."""
    found = F.try_variant_get(doc, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(found), found)


def pairs_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """(unit, doc_a, doc_b): the documents (instance_id, stem, doc) of both folders that have the same name."""
    first = a.select(F.col("stem").alias("unit"), F.col("doc").alias("doc_a"))
    return first.join(b.select(F.col("stem").alias("unit"), F.col("doc").alias("doc_b")), "unit")


def sites(pairs: DataFrame, name: str) -> DataFrame:
    """(unit, side, idx, file, line, stmt, note): normalised entries of a list of both documents; entries that aren't objects
    are passed over; note is VARIANT."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.try_variant_get(f"doc_{s.lower()}", f"$.{name}", "array<variant>").alias("own")) for s in "AB"])
    each = pairs.select("unit", F.explode(sides).alias("x")).select("unit", "x.side", F.posexplode("x.own").alias("idx", "e"))
    each = each.filter("schema_of_variant(e) LIKE 'OBJECT%'")
    text = lambda k: F.try_variant_get("e", f"$.{k}", "string")
    return each.select("unit", "side", "idx", T.norm_file(text("file")).alias("file"), F.try_variant_get("e", "$.line", "bigint").alias("line"), T.norm_stmt(text("statement")).alias("stmt"), field("e", "note").alias("note"))


def conflicts(matches: DataFrame, locations: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """(unit, step, side, idx, type, severity, said): each match with its JSON text: what both say of an agreed location, and of a
    conflict what each rater, by name, has in place of the other's; in the order of passes and of the first rater's list."""
    side = lambda s: locations.filter(F.col("side") == s).select(F.col("unit").alias("_u"), F.col("idx").alias("_i"), F.struct("file", "line", "stmt", "note").alias(s.lower()))
    a, b = side("A"), side("B")
    rows = matches.join(a, (F.col("unit") == F.col("_u")) & (F.col("a_idx") == F.col("_i")), "left").drop("_u", "_i")
    rows = rows.join(b, (F.col("unit") == F.col("_u")) & (F.col("b_idx") == F.col("_i")), "left").drop("_u", "_i")
    get = lambda s, *names: json_object({{"stmt": "statement"}.get(n, n): json_of(F.col(f"{s}.{n}")) for n in names})
    one = F.coalesce("a", "b")
    own = lambda n: json_of(one[n])
    head = {"type": json_of(F.col("type")), "severity": json_of(F.col("severity"))}
    both = lambda *names: {name_a: get("a", *names), name_b: get("b", *names)}
    delta = {"line_delta": json_of(F.col("line_delta"))}
    said = (
        F.when(F.col("step") == 1, json_object({"file": own("file"), "line": own("line"), "statement": own("stmt")}))
        .when(F.col("step") == 2, json_object(head | {"file": own("file"), "statement": own("stmt")} | delta | both("line", "note")))
        .when(F.col("step") == 3, json_object(head | {"file": own("file"), "line": own("line")} | both("stmt", "note")))
        .when(F.col("step") == 4, json_object(head | {"file": own("file")} | delta | both("line", "stmt")))
        .otherwise(
            json_object(
                head
                | {"only_in": json_of(F.when(F.col("a_idx").isNotNull(), name_a).otherwise(name_b)), "file": own("file"), "line": own("line"), "statement": own("stmt"), "note": own("note")}
                | {"same_file_as_other_side": json_of(F.col("same_file"))}
            )
        )
    )
    return rows.select("unit", "step", F.when(F.col("a_idx").isNotNull(), "A").otherwise("B").alias("side"), F.coalesce("a_idx", "b_idx").alias("idx"), "type", "severity", said.alias("said"))


def differences(pairs: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """(unit, said): the JSON list of what differs outside the locations: confidence, call sites, and flags that both have."""
    raw = lambda s, name: F.coalesce(F.to_json(field(f"doc_{s}", name)), F.lit("null"))
    a, b = raw("a", "confidence"), raw("b", "confidence")
    entry = lambda name, x, y: json_object({"type": F.lit(f'"{name}_differs"'), name_a: x, name_b: y})
    lists = reconcile.call_site_diffs(sites(pairs, "fault_triggering_call_site")).select(F.col("unit").alias("_u"), F.to_json("a").alias("_a"), F.to_json("b").alias("_b"))
    found = [F.when(a != b, entry("confidence", a, b)), F.when(F.col("_u").isNotNull(), entry("ftcs", F.col("_a"), F.col("_b")))]
    for name in FLAGS:
        x, y = raw("a", name), raw("b", name)
        found.append(F.when((x != "null") & (y != "null") & (x != y), entry(name, x, y)))
    joined = pairs.join(lists, F.col("unit") == F.col("_u"), "left")
    return joined.select("unit", F.concat(F.lit("["), F.concat_ws(",", *found), F.lit("]")).alias("said"))


def compared(pairs: DataFrame, name_a: str, name_b: str, tolerance: int = reconcile.TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(units, matches): of each pair (unit, doc_a, doc_b, status, n_a, n_b, exact, agreed, conflicts, informational), the last
    three as JSON lists; and the matches as `conflicts` returns them."""
    located = sites(pairs, "root_cause")
    matched = reconcile.match(located.drop("note"), tolerance)
    each = conflicts(matched, located, name_a, name_b)
    place = F.struct("step", "side", "idx", "said")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, place))), lambda x: x["said"]), ","), F.lit("]"))
    own = each.groupBy(F.col("unit").alias("_u")).agg(listed(F.col("step") == 1).alias("agreed"), listed(F.col("step") > 1).alias("conflicts"), F.count_if(F.col("step") == 1).alias("exact"))
    states = reconcile.status(pairs, matched).withColumnRenamed("unit", "_s")
    other = differences(pairs, name_a, name_b).select(F.col("unit").alias("_d"), F.col("said").alias("informational"))
    size = lambda s: F.coalesce(F.size(F.try_variant_get(f"doc_{s}", "$.root_cause", "array<variant>")), F.lit(0))
    rows = pairs.join(states, F.col("unit") == F.col("_s")).join(own, F.col("unit") == F.col("_u"), "left").join(other, F.col("unit") == F.col("_d"))
    none = F.lit("[]")
    return rows.select(
        "unit", "doc_a", "doc_b", "status", size("a").alias("n_a"), size("b").alias("n_b"), F.coalesce("exact", F.lit(0)).alias("exact"),
        F.coalesce("agreed", none).alias("agreed"), F.coalesce("conflicts", none).alias("conflicts"), "informational",
    ), each


def merged(units: DataFrame, resolved: DataFrame, name_a: str, name_b: str, primary: str) -> DataFrame:
    """(unit, final, mergeable, doc): of each unit that isn't skipped the document of the side that won, else of the primary
    rater, as it is but for `merge_metadata`.

    units: as `compared` returns them; resolved: as reconcile.resolve does.
    """
    known = resolved.select(F.col("unit").alias("_r"), "final", "choice", "mergeable")
    rows = units.join(known, same(units, known, {"unit": "_r"})).filter("final <> 'skipped_by_resolution'")
    chosen = F.col("choice").isNotNull()
    won_a = F.when(chosen, F.col("choice") == "A").otherwise(F.lit(primary == name_a))
    winner = F.when(won_a, name_a).otherwise(name_b)
    some = lambda c: F.when(F.col(c) != "[]", F.col(c))
    reasoning = lambda s: F.coalesce(F.to_json(field(f"doc_{s}", "reasoning")), F.lit("null"))
    meta = json_object(
        {
            "status": json_of(F.col("final")),
            "annotators": F.lit(json.dumps([name_a, name_b], ensure_ascii=False)),
            "primary": json_of(winner),
            "root_cause_agreement": json_object({"exact_matches": json_of(F.col("exact")), f"locations_{name_a}": json_of(F.col("n_a")), f"locations_{name_b}": json_of(F.col("n_b"))}),
            f"reasoning_{name_b}": F.when(won_a, reasoning("b")),
            f"reasoning_{name_a}": F.when(~won_a, reasoning("a")),
            "unresolved_conflicts": F.when(~chosen, some("conflicts")),
            "informational_differences": some("informational"),
            "resolved_in_favour_of": F.when(chosen, json_of(winner)),
            "resolved_conflicts": F.when(chosen, F.col("conflicts")),
        }
    )
    doc = F.when(won_a, F.col("doc_a")).otherwise(F.col("doc_b"))
    return rows.select("unit", "final", "mergeable", with_field(doc, "merge_metadata", meta).alias("doc"))


def ground_truth(decisions: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(unit, doc): a document for each decision (unit, choice, priority): locations and confidence of the side chosen (of the first
    where both agreed), whose reasoning it is, and whose decision.  a, b: documents (instance_id, stem, doc)."""
    side = lambda df, s: df.select(F.col("stem").alias(f"_{s}"), F.col("doc").alias(f"doc_{s}"))
    rows = decisions.join(side(a, "a"), F.col("unit") == F.col("_a"), "left").join(side(b, "b"), F.col("unit") == F.col("_b"), "left")
    first = F.col("choice").isin("A", "Both") | (F.col("priority") == 0)
    doc = F.when(first, F.col("doc_a")).otherwise(F.col("doc_b"))
    rows = rows.withColumn("_doc", doc)
    entries = F.filter(F.coalesce(F.try_variant_get("_doc", "$.root_cause", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    raw = lambda e, k, none: F.coalesce(F.to_json(F.try_variant_get(e, f"$.{k}", "variant")), F.lit(none))
    places = F.transform(entries, lambda e: json_object({"file": raw(e, "file", '""'), "line": raw(e, "line", "null"), "statement": raw(e, "statement", '""')}))
    said = lambda s: json_of(F.coalesce(F.try_variant_get(f"doc_{s}", "$.reasoning", "string"), F.lit("")))
    whose = F.when(F.col("priority") == 0, "both agreed").when(F.col("choice") == "A", "annotator1").otherwise("annotator2")
    empty = F.lit('""')
    text = json_object(
        {
            "instance_id": json_of(F.col("unit")),
            "root_cause": F.concat(F.lit("["), F.array_join(places, ","), F.lit("]")),
            "confidence": F.coalesce(F.to_json(field("_doc", "confidence")), F.lit("null")),
            "comments": json_of(whose),
            "reasoning": json_object({"annotator1": F.when(F.col("choice").isin("A", "Both"), said("a")).otherwise(empty), "annotator2": F.when(F.col("choice").isin("B", "Both"), said("b")).otherwise(empty)}),
        }
    )
    return rows.select("unit", F.parse_json(text).alias("doc"))

"""Logical lines, and line numbers carried through patches, as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant import chains
from accordant.operators import alignment, bitmaps, documents, lines, patches, results, statements
from accordant.plans.more import _SOURCE, order_sources
from accordant.plans.registry import query, table


@query(_SOURCE + """ SELECT 'o' || o || '.py' AS path, "start", "end", length(CASE WHEN body LIKE 'def%' THEN body ELSE '    ' || replace(body, chr(10), chr(10) || '    ') END) AS chars FROM spans""")
def u1_logical_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical lines of every order's source file."""
    _, sources = order_sources(spark, sf_dir)
    return lines.logical_lines(sources, ["path"]).select("path", "start", "end", F.char_length("body").alias("chars"))


# An order's items are the lines of a file; its patch takes some away, puts two in the place of some and adds one behind some.
_ITEMS = """WITH i AS (SELECT l_orderkey AS o, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
  d AS (SELECT *, p % 5 AS kind, CASE p % 5 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS delta FROM i),
  m AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY o ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS moved FROM d)"""


def order_patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines: o, file, line; patches: o, text): one hunk over the whole file for odd orders, a hunk without context for each
    change for even ones."""
    text = lambda x: x.cast("string")
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = lambda x: x["p"] % 5
    delta = lambda x: F.when(kind(x) == 0, -1).when(kind(x).isin(1, 2), 1).otherwise(0)
    old = lambda x: F.concat(F.lit("-"), text(x["p"]))
    kept = lambda x: F.concat(F.lit(" "), text(x["p"]))
    new = F.lit("+-- new")  # a line that looks like a head with its sign
    changed = lambda x: F.when(kind(x) == 0, F.array(old(x))).when(kind(x) == 1, F.array(old(x), new, new)).when(kind(x) == 2, F.array(kept(x), new)).otherwise(F.array(kept(x)))
    moved = lambda i: F.aggregate(F.slice("items", 1, i), F.lit(0), lambda a, x: a + delta(x))
    at = lambda i, x: i + F.when(kind(x) == 2, 2).otherwise(1) + moved(i)  # noqa: E731  the new line that the hunk starts with
    head = lambda i, x: F.concat(
        F.lit("@@ -"), text(i + 1), F.when(kind(x) == 2, ",0").otherwise(""), F.lit(" +"),
        F.when(kind(x) == 0, F.concat(text(i + moved(i)), F.lit(",0"))).when(kind(x) == 1, F.concat(text(at(i, x)), F.lit(",2"))).otherwise(text(at(i, x))), F.lit(" @@"),
    )
    small = F.transform("items", lambda x, i: F.when(kind(x) < 3, F.concat_ws("\n", head(i, x), F.filter(changed(x), lambda y: ~y.startswith(" ")))))
    whole = F.concat(F.lit("@@ -1,"), text(F.size("items")), F.lit(" +1,"), text(F.size("items") + moved(F.size("items"))), F.lit(" @@\n"), F.concat_ws("\n", F.flatten(F.transform("items", changed))))
    name = F.concat(F.lit("o"), text(F.col("o")), F.lit(".txt"))
    title = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"))
    body = F.when(F.col("o") % 2 == 0, F.concat_ws("\n", small)).otherwise(whole)
    rows = orders.select("o", name.alias("file"), F.posexplode("items").alias("line", "x")).select("o", "file", (F.col("line") + 1).alias("line"))
    return rows, orders.select("o", F.concat(title, body, F.lit("\n")).alias("text"))


@query(_ITEMS + " SELECT o, k AS line, CASE WHEN kind IN (0, 1) THEN NULL ELSE 'o' || o || '.txt' END AS new_file, CASE WHEN kind IN (0, 1) THEN NULL ELSE k + moved END AS new_line FROM m")
def s14_line_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order's file, carried through the order's patch."""
    rows, given = order_patches(spark, sf_dir)
    return patches.carried(rows, patches.edits(given, ["o"]), ["o"]).select("o", "line", "new_file", "new_line")


@query(_ITEMS + """, e AS (SELECT o, list(k + moved ORDER BY k) FILTER (kind > 1) AS got, list(k ORDER BY k) AS said FROM m GROUP BY 1)
  SELECT o, array_to_string(list_sort(list_filter(said, lambda x: NOT list_contains(coalesce(got, []), x))), ',') AS only_expected, array_to_string(list_sort(list_filter(coalesce(got, []), lambda x: NOT list_contains(said, x))), ',') AS only_carried
  FROM e WHERE NOT (list_has_all(said, coalesce(got, [])) AND list_has_all(coalesce(got, []), said))""")
def e17_variant_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of an order's file, taken as recorded after the patch, differ from those that the patch gives."""
    rows, given = order_patches(spark, sf_dir)
    found = patches.carried(rows, patches.edits(given, ["o"]), ["o"])
    expected = rows.groupBy("o").agg(F.collect_list("line").alias("lines"))
    out = patches.truth_differences(expected, found, ["o"])
    said = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("o", said("only_expected"), said("only_carried"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS at, o_orderkey AS unit FROM orders WHERE o_orderstatus = 'F'")
def p4_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.with_status(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderstatus").alias("status")), "F")


@query("SELECT o_orderkey, o_custkey AS instance FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def p5_pilot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of those customers whose number is a supplier's too."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("instance"))
    return results.members(orders, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instance")))


@query("""SELECT c_custkey, '{"custkey":' || c_custkey || ',"segment":"' || c_mktsegment || '"}' AS kept, '{"custkey":' || c_custkey || ',"nation":' || (c_nationkey + 1) || ',"segment":"' || c_mktsegment || '"}' AS changed FROM customer""")
def p25_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, with a field dropped, and with that field set."""
    fields = F.to_json(F.struct(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    doc = F.parse_json(fields)
    changed = documents.with_field(doc, "nation", (F.col("c_nationkey") + 1).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(documents.without_field(doc, "nation")).alias("kept"), F.to_json(changed).alias("changed"))


@query("""SELECT row_number() OVER (ORDER BY n DESC, first) - 1 AS at, o_custkey, n FROM (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1)""")
def o3_first_seen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first_seen_counts(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"])


@query(r"""SELECT doc_id, left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 120) AS shown FROM documents""")
def o7_shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chains.shown("text").alias("shown"))


_EDITED = r"""WITH d AS (SELECT doc_id, doc_id % 6 AS kind, coalesce(text, '') AS t FROM documents),
  p AS (SELECT doc_id, CASE kind WHEN 0 THEN ' ' || t || ' ' WHEN 1 THEN replace(replace(t, ' ', '  '), '"', chr(39)) WHEN 2 THEN t || '.' WHEN 3 THEN left(t, 20) WHEN 4 THEN 'zzz qqq' ELSE '' END AS cur, t AS ext FROM d),
  n AS (SELECT *, trim(regexp_replace(cur, '\s+', ' ', 'g')) AS c, trim(regexp_replace(ext, '\s+', ' ', 'g')) AS e FROM p),
  r AS (SELECT *, length(e) / greatest(1, length(c)) AS ratio, regexp_replace(cur, '^\s+|\s+$', '', 'g') = regexp_replace(ext, '^\s+|\s+$', '', 'g') AS exact,
    regexp_replace(replace(cur, '"', chr(39)), '\s+', '', 'g') = regexp_replace(replace(ext, '"', chr(39)), '\s+', '', 'g') AS alike FROM n)
  SELECT doc_id, CASE WHEN exact THEN 'good' WHEN alike OR ratio <= 1.5 THEN 'safe' ELSE 'unsafe' END AS bucket,
    CASE WHEN exact THEN 'exact match' WHEN alike THEN 'whitespace/quote only' WHEN ratio <= 1.5 THEN 'same statement reformatted (x)' WHEN c <> '' AND contains(e, c) THEN 'sub-statement pointer, balloons x' ELSE 'differs / paraphrase (x)' END AS reason FROM r"""


@query(_EDITED)
def f13_classify_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a changed copy of itself, so that all outcomes occur."""
    t, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 6
    spaced = F.translate(F.replace(t, F.lit(" "), F.lit("  ")), '"', "'")
    cur = F.when(kind == 0, F.concat(F.lit(" "), t, F.lit(" "))).when(kind == 1, spaced).when(kind == 2, F.concat(t, F.lit("."))).when(kind == 3, F.left(t, F.lit(20))).when(kind == 4, "zzz qqq").otherwise("")
    found = table(spark, sf_dir, "documents").select("doc_id", statements.change(cur, t).alias("c"))
    return found.select("doc_id", "c.bucket", F.regexp_replace("c.reason", r"x[0-9.]+", "x").alias("reason"))


@query("""WITH u AS (SELECT user_id, ts::date AS d, list_sort(list(DISTINCT event_type)) AS t FROM events GROUP BY 1, 2), g AS (SELECT DISTINCT event_type AS t FROM events),
  m AS (SELECT user_id, d, string_agg(CASE WHEN list_contains(u.t, g.t) THEN '1' ELSE '0' END, '' ORDER BY g.t) AS mask FROM u, g GROUP BY 1, 2)
  SELECT 'region ' || mask AS name, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'size ' || event_type, count(DISTINCT (user_id, ts::date)) FROM events GROUP BY event_type UNION ALL SELECT 'union', count(*) FROM u""")
def x3_bitmap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days by event type: sizes, the union and all regions."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    sets = bitmaps.group_bitmaps(events, "event_type", ["user_id", "day"])
    groups = sorted(results.by_count(events, "event_type"))
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c)).alias("name")
    out = bitmaps.region_counts(sets, groups).select(named("region ", "mask"), "n").unionByName(bitmaps.sizes(sets).select(named("size ", "group"), "n"))
    return out.unionByName(bitmaps.union_size(sets).select(F.lit("union").alias("name"), "n"))


# The lengths for one more row of the base are the running maximum of: one more than before the place left of it where the nodes
# are equal, the length so far elsewhere.
@query("""WITH RECURSIVE e AS (SELECT ts::date AS day, event_type, user_id, row_number() OVER (PARTITION BY ts::date, event_type ORDER BY ts, event_id) AS k FROM events),
  p AS (SELECT day, lag(day) OVER (ORDER BY day) AS base FROM (SELECT DISTINCT day FROM e)),
  a AS (SELECT p.day AS run, event_type, k, user_id FROM e JOIN p ON e.day = base), b AS (SELECT p.day AS run, event_type, k, user_id FROM e JOIN p ON e.day = p.day WHERE base IS NOT NULL),
  g AS (SELECT run, event_type, sum(x)::bigint AS n, sum(y)::bigint AS m FROM (SELECT run, event_type, 1 AS x, 0 AS y FROM a UNION ALL SELECT run, event_type, 0, 1 FROM b) GROUP BY 1, 2),
  l AS (SELECT run, event_type, k AS j, user_id, 0::bigint AS i, 0::bigint AS best FROM b
    UNION ALL SELECT l.run, l.event_type, l.j, l.user_id, l.i + 1, max(CASE WHEN a.user_id = l.user_id THEN 1 + l.diagonal ELSE l.best END) OVER (PARTITION BY l.run, l.event_type ORDER BY l.j)
      FROM (SELECT *, coalesce(lag(best) OVER (PARTITION BY run, event_type ORDER BY j), 0) AS diagonal FROM l) l JOIN a ON a.run = l.run AND a.event_type = l.event_type AND a.k = l.i + 1),
  c AS (SELECT run, event_type, max(best) AS kept FROM l GROUP BY 1, 2)
  SELECT g.run, g.event_type, coalesce(kept, 0)::bigint AS kept, (n - coalesce(kept, 0))::bigint AS removed, (m - coalesce(kept, 0))::bigint AS added FROM g LEFT JOIN c ON c.run = g.run AND c.event_type = g.event_type""")
def x6_run_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's run against the one before as ordered lists: what stays in a shortest edit script, goes and comes."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return alignment.changed(*results.consecutive(e, "day"), ["run", "event_type"], ["ts", "event_id"], "user_id")

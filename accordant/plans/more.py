"""Extraction, decisions, validation sheets, run summaries and scalars as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators import agreement, joins, reconcile, results, statements
from accordant.plans.registry import query, table
from accordant.scratch import materialise

# Each order is a source file: a def line, then per line item an assignment, one wrapped over two lines, or a comment.
_SOURCE = """WITH i AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
  b AS (SELECT *, CASE k % 3 WHEN 0 THEN 2 ELSE 1 END AS height FROM i), c AS (SELECT *, 2 + coalesce(sum(height) OVER (PARTITION BY o ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS first FROM b),
  spans AS (SELECT o, 1 AS "start", 1 AS "end", 'def f():' AS body FROM (SELECT DISTINCT o FROM i) UNION ALL
    SELECT o, first, first + height - 1, CASE k % 3 WHEN 0 THEN 'v = g(' || p || ',' || chr(10) || '      ' || s || ')' ELSE 'x = ' || p END FROM c WHERE k % 3 <> 2),
  r AS (SELECT 'own__orders-' || o AS instance_id, CASE WHEN o % 11 = 0 THEN '' ELSE 'c1' END AS base_commit, CASE WHEN o % 13 = 0 THEN '' WHEN o % 17 = 0 THEN 'o' || o || '.txt' WHEN o % 19 = 0 THEN 'none.py' ELSE 'o' || o || '.py' END AS file,
    CASE WHEN k % 7 = 6 THEN 'six' ELSE (k + 1)::varchar END AS line, CASE k % 4 WHEN 0 THEN 'x = ' || p WHEN 1 THEN 'def' WHEN 2 THEN '' ELSE 'v = g(' || p || ', ' || s || ')' END AS statements, o, k FROM i),
  e AS (SELECT r.*, x."start" AS start_line, x."end" AS end_line, x.body, CASE WHEN file = '' THEN 'no_location' WHEN line = 'six' THEN 'line_not_int (ignored)' WHEN file NOT LIKE '%.py' THEN 'not_python (needs tree-sitter)'
      WHEN base_commit = '' THEN 'no_base_commit' WHEN file = 'none.py' THEN 'path_or_commit_missing' END AS stopped
    FROM r LEFT JOIN spans x ON x.o = r.o AND line <> 'six' AND try_cast(line AS int) BETWEEN x."start" AND x."end"),
  f AS (SELECT instance_id, file, line, statements, CASE WHEN stopped IS NULL THEN start_line END AS start_line, CASE WHEN stopped IS NULL THEN end_line END AS end_line, CASE WHEN stopped IS NULL THEN coalesce(body, '') ELSE '' END AS extracted_statement,
      coalesce(stopped, CASE WHEN start_line IS NULL THEN 'no_statement_at_line (blank/comment?)' ELSE concat_ws('; ', CASE WHEN end_line > start_line THEN 'multiline' END,
        CASE WHEN statements <> '' AND NOT contains(regexp_replace(body, '\\s+', ' ', 'g'), regexp_replace(statements, '\\s+', ' ', 'g')) THEN 'current_not_contained' END) END) AS note FROM e)"""


def order_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(recorded rows, source files) made from orders, which are put together and written once."""
    item = F.struct(*[F.col(c).alias(n) for c, n in (("l_linenumber", "n"), ("l_partkey", "p"), ("l_suppkey", "s"))])
    line = table(spark, sf_dir, "lineitem")
    line = line.repartition(joins.pieces(line), "l_orderkey")  # lists are put together once
    orders = line.groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    orders = materialise(orders, "orders")
    text = lambda x: x.cast("string")
    line = F.transform(
        "items",
        lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("    v = g("), text(x["p"]), F.lit(",\n          "), text(x["s"]), F.lit(")")))
        .when((i + 1) % 3 == 1, F.concat(F.lit("    x = "), text(x["p"])))
        .otherwise(F.concat(F.lit("    # "), text(x["p"]))),
    )
    body = F.concat(F.lit("def f():\n"), F.array_join(line, "\n"), F.lit("\n"))
    name = F.concat(F.lit("o"), text(F.col("o")))
    sources = orders.select(F.lit("orders").alias("repo"), F.lit("c1").alias("commit"), F.concat(name, F.lit(".py")).alias("path"), body.alias("text"))
    rows = orders.select("o", F.posexplode("items").alias("k", "x")).withColumn("k", F.col("k") + 1)
    p, s, k, o = text(F.col("x.p")), text(F.col("x.s")), F.col("k"), F.col("o")
    stmt = F.when(k % 4 == 0, F.concat(F.lit("x = "), p)).when(k % 4 == 1, "def").when(k % 4 == 2, "").otherwise(F.concat(F.lit("v = g("), p, F.lit(", "), s, F.lit(")")))
    file = F.when(o % 13 == 0, "").when(o % 17 == 0, F.concat(name, F.lit(".txt"))).when(o % 19 == 0, "none.py").otherwise(F.concat(name, F.lit(".py")))
    rows = rows.select(
        F.concat(F.lit("own__orders-"), text(o)).alias("instance_id"),
        F.when(o % 11 == 0, "").otherwise("c1").alias("base_commit"),
        file.alias("file"),
        F.when(k % 7 == 6, "six").otherwise(text(k + 1)).alias("line"),
        stmt.alias("statements"),
    )
    return rows, sources


@query(_SOURCE + " SELECT instance_id, line, start_line, end_line, extracted_statement, note FROM f")
def p9_extract_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.extract(*order_sources(spark, sf_dir)).select("instance_id", "line", "start_line", "end_line", "extracted_statement", "note")


@query(_SOURCE + " SELECT count(*) AS locations, count(*) FILTER (extracted_statement <> '') AS extracted, count(*) FILTER (contains(note, 'multiline')) AS multiline, count(*) FILTER (contains(note, 'current_not_contained')) AS not_contained FROM f")
def a34_extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.extract_summary(statements.extract(*order_sources(spark, sf_dir)))


@query(_SOURCE + " SELECT instance_id, string_agg(line || ':' || start_line || '-' || end_line || ' ' || extracted_statement, '|' ORDER BY line) AS spans FROM f WHERE start_line IS NOT NULL GROUP BY 1")
def a33_spans_by_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("spans", lambda x: F.concat(x["line"], F.lit(":"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit(" "), x["statement"]))
    rows, sources = order_sources(spark, sf_dir)
    return statements.spans_by_instance(statements.extract(rows, sources), joins.pieces(rows)).select("instance_id", F.array_join(said, "|").alias("spans"))


@query(_SOURCE + " SELECT instance_id, file, line, statements AS old, extracted_statement AS new FROM f WHERE start_line IS NOT NULL AND statements <> extracted_statement")
def p22_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.replacements(statements.extract(*order_sources(spark, sf_dir)))


@query(
    _SOURCE
    + r""", n AS (SELECT *, trim(regexp_replace(statements, '\s+', ' ', 'g')) AS c, trim(regexp_replace(extracted_statement, '\s+', ' ', 'g')) AS x FROM f), q AS (SELECT *, length(x) / greatest(1, length(c)) AS ratio FROM n)
  SELECT instance_id, line, CASE WHEN start_line IS NULL THEN 'unsafe' WHEN trim(statements) = extracted_statement THEN 'good' WHEN replace(replace(statements, ' ', ''), chr(10), '') = replace(replace(extracted_statement, ' ', ''), chr(10), '') THEN 'safe' WHEN ratio <= 1.5 THEN 'safe' ELSE 'unsafe' END AS bucket,
    CASE WHEN start_line IS NULL THEN split_part(note, ' (', 1) WHEN trim(statements) = extracted_statement THEN 'exact match' WHEN replace(replace(statements, ' ', ''), chr(10), '') = replace(replace(extracted_statement, ' ', ''), chr(10), '') THEN 'whitespace/quote only'
      WHEN ratio <= 1.5 THEN 'same statement reformatted (x)' WHEN c <> '' AND contains(x, c) THEN 'sub-statement pointer, balloons x' ELSE 'differs / paraphrase (x)' END AS reason FROM q"""
)
def p10_classify_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statements.classify(statements.extract(*order_sources(spark, sf_dir)))
    return found.select("instance_id", "line", "bucket", F.regexp_replace("reason", r"x[0-9.]+", "x").alias("reason"))


_TABLES = """WITH a AS (SELECT ' ' || (c_custkey % 500) AS unit, CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'Both' WHEN 2 THEN 'B' WHEN 3 THEN 'X' ELSE ' A ' END AS choice, c_custkey AS row, 0 AS priority FROM customer UNION ALL SELECT ' ', 'A', 0, 0),
  b AS (SELECT (s_suppkey % 300)::varchar AS unit, CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'Both' ELSE 'skip' END AS choice, s_suppkey AS row, 1 AS priority FROM supplier),
  t AS (SELECT trim(unit) AS unit, trim(choice) AS choice, row, priority FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE trim(unit) <> ''), k AS (SELECT *, choice IN ('A', 'B') OR (priority = 0 AND choice = 'Both') AS known FROM t),
  g AS (SELECT unit, arg_max(choice, (priority, row)) AS choice, max(priority) AS priority, count(DISTINCT priority) AS n FROM k WHERE known GROUP BY 1)"""


def decision_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    agreed = c.select(
        F.concat(F.lit(" "), (F.col("c_custkey") % 500).cast("string")).alias("unit"),
        F.expr("CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'Both' WHEN 2 THEN 'B' WHEN 3 THEN 'X' ELSE ' A ' END").alias("choice"),
        F.col("c_custkey").cast("long").alias("row"),
    ).unionByName(spark.range(1).select(F.lit(" ").alias("unit"), F.lit("A").alias("choice"), F.lit(0).cast("long").alias("row")))
    conflicts = s.select((F.col("s_suppkey") % 300).cast("string").alias("unit"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'Both' ELSE 'skip' END").alias("choice"), F.col("s_suppkey").cast("long").alias("row"))
    return agreed, conflicts


@query(
    _TABLES
    + """ SELECT unit, CASE WHEN choice IN ('Both', 'A') THEN 'ra' || unit ELSE '' END AS annotator1, CASE WHEN choice IN ('Both', 'B') AND unit::int % 3 <> 0 THEN 'rb' || unit ELSE '' END AS annotator2,
    CASE WHEN priority = 0 THEN 'both agreed' WHEN choice = 'A' THEN 'annotator1' ELSE 'annotator2' END AS comments FROM g"""
)
def j16_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = reconcile.decide(*decision_tables(spark, sf_dir))
    units = good.select("unit").distinct()
    said = units.select("unit", F.concat(F.lit("ra"), "unit").alias("a"), F.when(F.col("unit").cast("int") % 3 != 0, F.concat(F.lit("rb"), "unit")).alias("b"))
    return reconcile.decided_reasoning(good, said)


@query(_TABLES + " SELECT unit, choice, priority, 'unexpected choice, skipped' AS warning FROM k WHERE NOT known UNION ALL SELECT unit, choice, priority, 'also in the agreed table, overwriting' FROM g WHERE n > 1")
def p12_decision_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.decide(*decision_tables(spark, sf_dir))[1]


@query("""WITH l AS (SELECT DISTINCT doc_id AS unit FROM labels), a AS (SELECT DISTINCT doc_id AS unit FROM documents WHERE lang <> 'fr'), b AS (SELECT unit, l.unit IS NOT NULL AS x, a.unit IS NOT NULL AS y FROM l FULL JOIN a USING (unit))
  SELECT b.unit, CASE WHEN l.unit IS NOT NULL AND a.unit IS NOT NULL THEN 'labelled' WHEN l.unit IS NOT NULL THEN 'not_agreed' ELSE 'unlabeled' END AS membership FROM b LEFT JOIN l ON l.unit = b.unit LEFT JOIN a ON a.unit = b.unit""")
def j6_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit"))
    return reconcile.label_sets(labels, table(spark, sf_dir, "documents").filter("lang <> 'fr'").select(F.col("doc_id").alias("unit")))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)
  SELECT l.doc_id, sha256('Annotator 1 reasoning:' || chr(10) || '""' || '"' || chr(10) || coalesce(a.t, '') || chr(10) || '""' || '"' || chr(10) || chr(10) || 'Annotator 2 reasoning:' || chr(10) || '""' || '"' || chr(10) || coalesce(b.t, '') || chr(10) || '""' || '"') AS said_sha256
  FROM labels l LEFT JOIN s a ON a.doc_id = l.doc_id LEFT JOIN s b ON b.doc_id = l.doc_id + 1""")
def j7_label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document with two texts, its own and the next one's, as a juror reads them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first, second = d.select(F.col("doc_id").alias("_a"), F.col("text").alias("a")), d.select((F.col("doc_id") - 1).alias("_b"), F.col("text").alias("b"))
    rows = table(spark, sf_dir, "labels").select("doc_id").join(first, F.col("doc_id") == F.col("_a"), "left").join(second, F.col("doc_id") == F.col("_b"), "left")
    return rows.select("doc_id", F.sha2(T.two_reasonings("a", "b"), 256).alias("said_sha256"))


@query("""WITH s AS (SELECT doc_id AS unit, CASE WHEN doc_id % 10 = 0 THEN '' WHEN quality = 1 THEN 'aligned' ELSE 'partial' END AS human, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN toxic = 1 THEN 'partial' ELSE 'aligned' END AS judge FROM labels)
  SELECT unit, human, judge, CASE WHEN human = '' THEN 'unlabeled' WHEN judge IS NULL THEN 'missing' END AS skipped FROM s""")
def j8_judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").withColumn("unit", F.col("doc_id"))
    sheet = l.select("unit", F.expr("CASE WHEN doc_id % 10 = 0 THEN '  ' WHEN quality = 1 THEN ' Aligned ' ELSE 'PARTIAL' END").alias("human"))
    report = l.filter("doc_id % 14 <> 0").select("unit", F.expr("CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN toxic = 1 THEN 'partial' ELSE 'aligned' END").alias("final"))
    return agreement.judged_pairs(sheet, report, agreement.LABELS)


@query("""WITH c AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS base_commit FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1)
  SELECT c_custkey AS instance_id, coalesce(base_commit, '') AS base_commit FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def j4_base_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = table(spark, sf_dir, "orders").filter("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("instance_id"), F.col("o_orderstatus").alias("base_commit"), F.col("o_orderkey").alias("row"))
    return reconcile.with_base_commit(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance_id")), commits)


_RUNS = """WITH d AS (SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND source IS NOT NULL), m AS (SELECT conv_id, arg_max({'s': CASE WHEN turn % 3 <> 0 THEN 'st' || (turn % 3) END}, turn).s AS st, true AS told FROM conversations WHERE role = 'assistant' GROUP BY 1),
  s AS (SELECT source AS model, 'i' || doc_id AS instance, CASE WHEN doc_id % 7 = 0 THEN 'no_instance_dir' WHEN doc_id % 5 = 0 THEN 'no_trajectory' WHEN told IS NULL THEN 'no_exit_message' ELSE coalesce(st, 'unknown') END AS status FROM d LEFT JOIN m ON conv_id = doc_id)"""


def unreported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label as runs without a report, their conversations as trajectories."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").filter("quality IS NULL AND source IS NOT NULL")
    name = F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    runs = d.select(F.col("source").alias("model"), name.alias("instance"), (F.col("doc_id") % 7 != 0).alias("has_dir"), (F.col("doc_id") % 5 != 0).alias("has_trajectory"))
    turns = table(spark, sf_dir, "conversations").join(d.select("doc_id", "source"), F.col("conv_id") == F.col("doc_id"))
    status = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("st"), (F.col("turn") % 3).cast("string")))
    messages = turns.select(F.col("source").alias("model"), name.alias("instance"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "exit").otherwise(F.col("role")).alias("role"), status.alias("exit_status"))
    return results.exit_of(runs, messages)


@query(_RUNS + """ SELECT model, '{' || string_agg('"' || instance || '":"' || status || '"', ',' ORDER BY instance) || '}' AS missing FROM s GROUP BY 1""")
def k12_missing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.missing_reports(unreported(spark, sf_dir))


@query(_RUNS + """, n AS (SELECT substr(model, 4) AS model, status, count(*)::varchar AS n FROM s GROUP BY ALL), g AS (SELECT m.model, t.status, coalesce(n, '-') AS n FROM (SELECT DISTINCT model FROM n) m CROSS JOIN (SELECT DISTINCT status FROM n) t LEFT JOIN n USING (model, status))
  SELECT model, string_agg(g.status || '=' || g.n, ',' ORDER BY t.total DESC, g.status) AS cells FROM g JOIN (SELECT status, count(*) AS total FROM s GROUP BY 1) t ON t.status = g.status GROUP BY 1""")
def k11_ordered_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.as_text(results.ordered_pivot(unreported(spark, sf_dir), "model", "status", "src"), "model")


@query("SELECT source AS model, count(DISTINCT doc_id) AS n, sha256(string_agg(DISTINCT doc_id::varchar, ',' ORDER BY doc_id::varchar)) AS resolved FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND source IS NOT NULL GROUP BY 1")
def a28_resolved_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    found = results.resolved_sets(d.select(F.col("source").alias("model"), F.col("doc_id").cast("string").alias("instance"), (F.col("quality") == 1).alias("resolved")))
    return found.select("model", F.size("resolved").cast("long").alias("n"), F.sha2(F.array_join("resolved", ","), 256).alias("resolved"))


@query("""WITH u AS (SELECT user_id, ts::date AS d, count(DISTINCT event_type) AS k, min(event_type) AS t FROM events GROUP BY 1, 2) SELECT 'union' AS name, count(*) AS n FROM u UNION ALL SELECT 'only ' || t, count(*) FROM u WHERE k = 1 GROUP BY 1""")
def a29_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.struct("user_id", F.to_date("ts")).alias("day"), "event_type")
    groups = sorted(results.by_count(e, "event_type"))
    return results.coverage(results.regions(e, "day", "event_type", groups), groups)


@query("""SELECT c_custkey, f.field, f.content FROM customer, LATERAL (SELECT unnest(['c_name', 'c_mktsegment', 'c_acctbal']) AS field, unnest([coalesce(c_name, ''), coalesce(c_mktsegment, ''), CASE WHEN c_acctbal >= 0 THEN 'plus' ELSE 'minus' END]) AS content) f""")
def k15_fields_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, "plus").otherwise("minus"))
    return results.fields_long(c, "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"])


@query("""WITH n AS (SELECT count(DISTINCT c_mktsegment) AS n FROM customer) SELECT 2 * n AS calls_per_juror, 3 * 2 * n AS requests, round(3 * 2 * n * (900 * 5.0 + 500 * 25.0) / 1e6, 6) AS cost FROM n""")
def a35_jury_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    one = agreement.cost(1, 3)
    found = table(spark, sf_dir, "customer").agg(F.count_distinct("c_mktsegment").alias("n"))
    return found.select((n * one["calls_per_juror"]).alias("calls_per_juror"), (n * one["requests"]).alias("requests"), F.round(n * one["cost"], 6).alias("cost"))


@query("""WITH i AS (SELECT c_mktsegment AS instance, row_number() OVER (ORDER BY c_mktsegment) - 1 AS pos FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT 'c' || ((pos * 2 + ordering) * 2 + p) AS cid, instance, ordering, provider
  FROM i, (SELECT unnest([0, 1]) AS ordering), (SELECT unnest(['a', 'c']) AS provider, unnest([0, 1]) AS p) WHERE pos < 2""")
def p6_chosen_jurors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the first two instances to the jurors that a list names."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("instance"))
    return results.request_grid(segments, results.chosen(["a", "b", "c"], "c, a"), limit=2)


@query(r"""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS shown, left(o_orderpriority, 5) AS head, 'owner' || (o_custkey % 3) || '/repo' || (o_custkey % 5) AS slug,
    lower('Owner_1776_R-' || o_custkey) AS image, CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS listed, o_orderpriority = '1-URGENT' AS is_py, CASE WHEN k >= 0.81 THEN 'almost perfect' WHEN k >= 0.61 THEN 'substantial' WHEN k >= 0.41 THEN 'moderate' WHEN k >= 0.21 THEN 'fair' WHEN k >= 0 THEN 'slight' ELSE 'poor (< chance)' END AS band
  FROM (SELECT *, (o_orderkey % 120 - 20) / 100 AS k FROM orders)""")
def f17_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes, heads, slugs, image names, JSON lists, file types and kappa bands."""
    o = table(spark, sf_dir, "orders")
    owner, number = (F.col("o_custkey") % 3).cast("string"), F.col("o_custkey").cast("string")
    listed = F.when(F.col("o_orderkey") % 2 == 0, '["a", "b"]').otherwise("no list")
    name = F.concat(F.lit("owner"), owner, F.lit("__repo"), (F.col("o_custkey") % 5).cast("string"), F.lit("-12"))
    file = F.when(F.col("o_orderpriority") == "1-URGENT", "a/b.py").otherwise("a/b.pyc")
    return o.select(
        "o_orderkey",
        T.without_prefix("o_orderpriority", "1-").alias("shown"),
        T.label_head("o_orderpriority").alias("head"),
        T.owner_and_repo(name).alias("slug"),
        T.image_name(F.concat(F.lit("Owner__R-"), number)).alias("image"),
        F.when(T.string_list(listed).isNotNull(), F.size(T.string_list(listed))).alias("listed"),
        file.endswith(".py").alias("is_py"),
        agreement.band((F.col("o_orderkey") % 120 - 20) / 100).alias("band"),
    )

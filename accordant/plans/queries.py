"""The operators as queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.functions import text as T
from accordant.operators import agreement, joins, reconcile, results, statements
from accordant.plans.registry import ORACLE, QUERIES, query, table  # noqa: F401
from accordant.scratch import materialise

def order_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as two raters' locations: side by line status, file by return flag."""
    line = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_linestatus") == "O", "A").otherwise("B")
    stmt = F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string"), F.when(F.col("l_partkey") % 3 == 0, ",").otherwise(""))
    place = Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    line = line.repartition(joins.pieces(line), "l_orderkey")
    return line.select(F.col("l_orderkey").alias("unit"), side.alias("side"), F.row_number().over(place).alias("idx"), F.col("l_returnflag").alias("file"), (F.col("l_linenumber") * 3).alias("line"), stmt.alias("stmt"))


_LOCS = """locs AS (SELECT l_orderkey AS unit, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS side,
    row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_partkey, l_suppkey, l_linenumber) AS idx, l_returnflag AS file,
    l_linenumber * 3 AS line, 'S' || (l_suppkey % 4) || CASE WHEN l_partkey % 3 = 0 THEN ',' ELSE '' END AS stmt FROM lineitem),
  l0 AS (SELECT *, rtrim(replace(stmt, ' ', ''), ',:;') AS loose FROM locs)"""


def _pass(k: int, key: str) -> str:
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in key.split(", "))
    cols = "unit, side, idx, file, line, stmt, loose"
    return f""",
  r{k} AS (SELECT *, row_number() OVER (PARTITION BY unit, side, {key} ORDER BY idx) AS rn FROM l{k - 1}),
  p{k} AS (SELECT a.unit, a.file, {k} AS step, a.idx AS a_idx, b.idx AS b_idx, abs(a.line - b.line) AS line_delta, a.loose = b.loose AS same_loose
           FROM r{k} a JOIN r{k} b ON a.unit = b.unit AND a.rn = b.rn AND {on} WHERE a.side = 'A' AND b.side = 'B'),
  l{k} AS (SELECT {cols} FROM l{k - 1} l WHERE NOT EXISTS (SELECT 1 FROM p{k} p WHERE p.unit = l.unit AND ((l.side = 'A' AND p.a_idx = l.idx) OR (l.side = 'B' AND p.b_idx = l.idx))))"""


_MATCHED = (
    "WITH "
    + _LOCS
    + "".join(_pass(k, key) for k, key in enumerate(("file, line, stmt", "file, stmt", "file, line", "file, loose"), 1))
    + """,
  found AS (SELECT *, true AS same_file FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)
    UNION ALL SELECT unit, file, 5, CASE WHEN side = 'A' THEN idx END, CASE WHEN side = 'B' THEN idx END, NULL, false,
      EXISTS (SELECT 1 FROM l0 o WHERE o.unit = l4.unit AND o.file = l4.file AND o.side <> l4.side) FROM l4),
  matches AS (SELECT unit, file, step, CASE step WHEN 1 THEN 'agreed' WHEN 2 THEN 'line_mismatch' WHEN 3 THEN CASE WHEN same_loose THEN 'statement_formatting' ELSE 'statement_mismatch' END
      WHEN 4 THEN 'line_and_formatting_mismatch' ELSE 'extra_location' END AS type,
    CASE WHEN step = 1 THEN 'none' WHEN step IN (2, 4) AND line_delta <= 10 THEN 'minor' WHEN step = 3 AND same_loose THEN 'minor' ELSE 'blocking' END AS severity,
    a_idx, b_idx, line_delta, same_file FROM found)"""
)
_STATUS = """,
  status AS (SELECT unit, CASE max(CASE severity WHEN 'blocking' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END) WHEN 2 THEN 'conflict' WHEN 1 THEN 'minor_conflict' ELSE 'agree' END AS status FROM matches GROUP BY unit)"""


@query(_MATCHED + " SELECT * FROM matches")
def j2_multi_pass_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.match(order_locations(spark, sf_dir))


@query(
    _MATCHED
    + _STATUS
    + """ SELECT 'status' AS kind, status AS name, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM status GROUP BY status
    UNION ALL SELECT 'type', type, count(*), round(count(*) / sum(count(*)) OVER (), 6) FROM matches GROUP BY type"""
)
def a1_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    locs = order_locations(spark, sf_dir)
    return reconcile.counts(reconcile.match(locs), joins.pieces(locs))


@query(_MATCHED + " SELECT CASE WHEN a_idx IS NULL THEN 'B' ELSE 'A' END AS only_in, same_file, count(*) AS n FROM matches WHERE step = 5 GROUP BY ALL")
def j3_same_side_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = reconcile.match(order_locations(spark, sf_dir)).filter("step = 5")
    return extra.groupBy(F.when(F.col("a_idx").isNull(), "B").otherwise("A").alias("only_in"), "same_file").agg(F.count("*").alias("n"))


_CHOICES = "CASE unit % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'second' WHEN 2 THEN 'skip' WHEN 3 THEN 'SKIP' WHEN 4 THEN ' b ' END"
_CHOSEN = "CASE unit % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'skip' WHEN 4 THEN 'B' END"


@query(
    _MATCHED
    + _STATUS
    + f""" SELECT unit, status, c AS choice, CASE WHEN c = 'skip' THEN 'skipped_by_resolution' WHEN c IS NOT NULL THEN 'resolved' ELSE status END AS final,
    CASE WHEN c = 'skip' THEN false WHEN c IS NOT NULL THEN true ELSE status <> 'conflict' END AS mergeable FROM (SELECT *, {_CHOSEN} AS c FROM status)"""
)
def p20_resolution_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(materialise(reconcile.match(order_locations(spark, sf_dir)).select("unit", "severity"), "matches"))


def _resolved(matches: DataFrame) -> DataFrame:
    parts = joins.pieces(matches)
    status = materialise(reconcile.status(matches, matches, parts), "status")
    choices = status.select("unit", F.expr(_CHOICES).alias("choice")).filter("choice IS NOT NULL")
    return reconcile.resolve(status, choices, {"second": "B"}, include_minor=True, parts=parts)


_DOCS = "SELECT l_orderkey AS unit, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS side, max(l_returnflag) AS reasoning, count(*) AS n FROM lineitem GROUP BY 1, 2"


@query(
    _MATCHED
    + _STATUS
    + f""", res AS (SELECT unit, status, {_CHOSEN} AS c FROM status), docs AS ({_DOCS}),
  m AS (SELECT unit, count(*) FILTER (step = 1) AS exact, count(*) FILTER (step > 1) AS conflicts FROM matches GROUP BY 1),
  w AS (SELECT *, CASE WHEN c IN ('A', 'B') THEN c ELSE 'A' END AS won FROM res WHERE c IS DISTINCT FROM 'skip')
  SELECT w.unit, CASE WHEN won = 'A' AND a.unit IS NOT NULL THEN 'A' || w.unit WHEN won = 'B' AND b.unit IS NOT NULL THEN 'B' || w.unit END AS document, CASE WHEN c IS NULL THEN status ELSE 'resolved' END AS status, won AS "primary",
    c AS favour, exact AS exact_matches, a.n AS locations_a, b.n AS locations_b, CASE WHEN won = 'A' THEN b.reasoning ELSE a.reasoning END AS other_reasoning,
    CASE WHEN c IS NULL THEN conflicts ELSE 0 END AS unresolved, CASE WHEN c IS NULL THEN 0 ELSE conflicts END AS resolved, CASE WHEN w.unit % 4 = 0 THEN 1 ELSE 0 END AS informational, c IS NOT NULL OR status <> 'conflict' AS mergeable
  FROM w JOIN m USING (unit) LEFT JOIN docs a ON a.unit = w.unit AND a.side = 'A' LEFT JOIN docs b ON b.unit = w.unit AND b.side = 'B'"""
)
def p21_merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged documents of both raters, from the matches, the resolutions and the other differences."""
    matches = materialise(reconcile.match(order_locations(spark, sf_dir)), "matches")
    side = F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("side")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), side, "l_returnflag")
    line = line.repartition(joins.pieces(line), "unit")
    docs = line.groupBy("unit", "side").agg(F.max("l_returnflag").alias("reasoning"), F.count("*").alias("n_locations"))
    docs = docs.withColumn("document", F.concat("side", F.col("unit").cast("string")))
    diffs = line.select("unit").distinct().filter("unit % 4 = 0").select("unit", F.lit("confidence").alias("field"), F.lit("1").alias("a"), F.lit("2").alias("b"))
    m = F.col("merge_metadata")
    size = lambda c: F.when(m[c].isNull(), 0).otherwise(F.size(m[c])).cast("long")
    return reconcile.merged(_resolved(matches), matches, docs, diffs).select(
        "unit",
        "document",
        m["status"].alias("status"),
        m["primary"].alias("primary"),
        m["resolved_in_favour_of"].alias("favour"),
        m["exact_matches"].alias("exact_matches"),
        m["locations_a"].alias("locations_a"),
        m["locations_b"].alias("locations_b"),
        m["other_reasoning"].alias("other_reasoning"),
        size("unresolved_conflicts").alias("unresolved"),
        size("resolved_conflicts").alias("resolved"),
        size("informational_differences").alias("informational"),
        "mergeable",
    )


_SITE = ["CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS side", "l_returnflag AS file", "CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber % 3 END AS line", "'S' || (l_suppkey % 2) AS stmt"]
_SHOWN = "string_agg(file || ':' || coalesce(line::varchar, 'None') || '  ' || stmt, '|' ORDER BY file, line IS NULL, line, stmt) FILTER (side = '{}')"


@query(f"""WITH s AS (SELECT l_orderkey AS unit, {", ".join(_SITE)} FROM lineitem), o AS (SELECT unit, coalesce({_SHOWN.format("A")}, '') AS a, coalesce({_SHOWN.format("B")}, '') AS b FROM s GROUP BY 1) SELECT * FROM o WHERE a <> b""")
def p18_call_site_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS unit", *_SITE)
    return reconcile.call_site_diffs(sites).select("unit", F.array_join("a", "|").alias("a"), F.array_join("b", "|").alias("b"))


@query("""WITH s AS (SELECT l_orderkey, bool_or(l_linestatus = 'O') AS o, bool_or(l_linestatus <> 'O') AS f FROM lineitem GROUP BY 1)
  SELECT CASE WHEN o AND f THEN 'both' WHEN o THEN 'only_a' ELSE 'only_b' END AS side, count(*) AS units FROM s GROUP BY 1""")
def j1_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    sides = line.groupBy("l_orderkey").agg(F.max(F.col("l_linestatus") == "O").alias("o"), F.max(F.col("l_linestatus") != "O").alias("f"))
    return sides.groupBy(F.when(F.col("o") & F.col("f"), "both").when(F.col("o"), "only_a").otherwise("only_b").alias("side")).agg(F.count("*").alias("units"))


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS s FROM orders),
  b AS (SELECT o_custkey, arg_min(struct_pack(p := p, s := s), o_orderkey) AS a, arg_max(struct_pack(p := p, s := s), o_orderkey) AS z FROM o GROUP BY 1)
  SELECT o_custkey, 'confidence' AS field, a.p AS a, z.p AS b FROM b WHERE a.p IS DISTINCT FROM z.p
  UNION ALL SELECT o_custkey, 'flag', a.s, z.s FROM b WHERE a.s <> z.s""")
def p17_metadata_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END").alias("p"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END").alias("s"))
    ends = o.groupBy("o_custkey").agg(F.min_by(F.struct("p", "s"), "o_orderkey").alias("a"), F.max_by(F.struct("p", "s"), "o_orderkey").alias("z"))
    flat = ends.select("o_custkey", F.col("a.p").alias("ap"), F.col("z.p").alias("zp"), F.col("a.s").alias("as"), F.col("z.s").alias("zs"))
    return reconcile.field_diffs(flat, "o_custkey", {"confidence": ("ap", "zp")}, {"flag": ("as", "zs")})


#: The four granularities, and one that no element has.
_GRANULARITIES = ["file", "statement", "line", "full", "none"]


def event_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the first and second half of the month as two raters' sets, at four granularities."""
    bucket = F.coalesce((F.regexp_extract("props", '"k": *([0-9]+)', 1).try_cast("int") / 10).cast("int").cast("string"), F.lit(""))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.when(F.dayofmonth("ts") <= 15, "A").otherwise("B").alias("side"), F.col("event_type").alias("t"), bucket.alias("k"), F.hour("ts").cast("string").alias("h"))
    # A user's different events meet once, before there are four rows of each: what is grouped by user later needn't be shuffled.
    e = e.groupBy("unit").agg(F.collect_set(F.struct("side", "t", "k", "h")).alias("e")).select("unit", F.explode("e").alias("e")).select("unit", "e.*")
    items = {"file": ["t"], "statement": ["t", "k"], "line": ["t", "h"], "full": ["t", "k", "h"]}
    long = F.array(*[F.struct(F.lit(g).alias("granularity"), F.concat_ws("|", *c).alias("item")) for g, c in items.items()])
    return e.select("unit", "side", F.explode(long).alias("x")).select("x.granularity", "unit", "side", "x.item")


def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of event_sets, each of whose events is an element."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"))


_SETS = """WITH e AS (SELECT user_id AS unit, CASE WHEN day(ts) <= 15 THEN 'A' ELSE 'B' END AS side, event_type AS t,
    coalesce((try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS int) // 10)::varchar, '') AS k, hour(ts)::varchar AS h FROM events),
  el AS (SELECT DISTINCT 'file' AS granularity, unit, side, t AS item FROM e UNION SELECT 'statement', unit, side, t || '|' || k FROM e
    UNION SELECT 'line', unit, side, t || '|' || h FROM e UNION SELECT 'full', unit, side, t || '|' || k || '|' || h FROM e),
  sd AS (SELECT granularity, unit, item, max((side = 'A')::int) AS a, max((side = 'B')::int) AS b FROM el GROUP BY ALL),
  ov AS (SELECT granularity, unit, sum(a) AS a, sum(b) AS b, sum(a * b) AS both_ FROM sd GROUP BY ALL)"""


@query(
    _SETS
    + """ SELECT granularity, round(coalesce(avg(CASE WHEN a + b - both_ > 0 THEN both_ / (a + b - both_) END), 1.0), 6) AS jaccard_macro,
    round(sum(both_) / sum(a + b - both_), 6) AS jaccard_micro, round(2 * sum(both_) / sum(a + b), 6) AS dice FROM ov GROUP BY 1 UNION ALL SELECT 'none', 1.0, 1.0, 1.0"""
)
def a7_agreement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.set_metrics(event_sets(spark, sf_dir), granularities=_GRANULARITIES)


_ALPHA = (
    _SETS
    + """, sets AS (SELECT g.granularity, u.unit, s.side, list(el.item) FILTER (el.item IS NOT NULL) AS items FROM (SELECT DISTINCT granularity FROM el UNION SELECT 'none') g, (SELECT DISTINCT unit FROM el) u,
      (SELECT unnest(['A', 'B']) AS side) s LEFT JOIN el ON el.granularity = g.granularity AND el.unit = u.unit AND el.side = s.side GROUP BY ALL),
  d AS (SELECT x.granularity, x.unit = y.unit AS own, x.side AS xs, y.side AS ys, coalesce(len(x.items), 0) AS a, coalesce(len(y.items), 0) AS b, coalesce(len(list_intersect(x.items, y.items)), 0) AS i
      FROM sets x JOIN sets y ON x.granularity = y.granularity AND (x.unit <> y.unit OR x.side <> y.side)),
  m AS (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 0.0 WHEN a = 0 OR b = 0 THEN 1.0 ELSE 1 - i / (a + b - i) * CASE WHEN i = a AND i = b THEN 1.0 WHEN i = a OR i = b THEN 2.0 / 3 WHEN i > 0 THEN 1.0 / 3 ELSE 0 END END AS dist FROM d),
  t AS (SELECT granularity, avg(dist) FILTER (own AND xs = 'A') AS o, avg(dist) AS e, count(*) FILTER (own AND xs = 'A') AS n FROM m GROUP BY 1)"""
)
_ALPHA_OF = """SELECT granularity, n, round(o, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN e = 0 THEN 1.0 ELSE 1 - o / e END, 6) AS alpha FROM t"""
_METRICS_OF = """SELECT granularity, round(coalesce(avg(CASE WHEN a + b - both_ > 0 THEN both_ / (a + b - both_) END), 1.0), 6) AS jaccard_macro,
    round(sum(both_) / sum(a + b - both_), 6) AS jaccard_micro, round(2 * sum(both_) / sum(a + b), 6) AS dice FROM ov GROUP BY 1 UNION ALL SELECT 'none', 1.0, 1.0, 1.0"""


@query(_ALPHA + " " + _ALPHA_OF)
def a12_krippendorff_masi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.alpha(event_sets(spark, sf_dir), event_units(spark, sf_dir), granularities=_GRANULARITIES)


@query(f"{_ALPHA}, al AS ({_ALPHA_OF}), me AS ({_METRICS_OF}) SELECT * FROM me JOIN al USING (granularity)")
def a13_agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric at every granularity."""
    return agreement.agreement_report(event_sets(spark, sf_dir), event_units(spark, sf_dir), granularities=_GRANULARITIES)


def _priority_rank(c: str = "o_orderpriority") -> Column:
    return -F.substring(F.col(c), 1, 1).cast("int")


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2)
  SELECT o_custkey, arg_max(o_orderpriority, (n, -left(o_orderpriority, 1)::int)) AS o_orderpriority, max(n) AS n, sum(n)::bigint AS votes FROM n GROUP BY 1""")
def a14_majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.majority(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", _priority_rank())


_VOTE = "SELECT {0}, arg_max(o_orderpriority, (n, -left(o_orderpriority, 1)::int)) AS label FROM (SELECT {0}, o_orderpriority, count(*) AS n FROM v GROUP BY ALL) GROUP BY {0}"


#: Order priorities as labels, from least to most divergent; the last two are severe.
_LABELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]

_VERDICTS = f"""WITH r AS (SELECT o_custkey AS unit, year(o_orderdate) % 2 AS ordering, o_orderstatus AS provider, CASE WHEN o_orderkey % 10 NOT IN (0, 1) THEN o_orderpriority END AS o_orderpriority, o_totalprice < 50000 AS low FROM orders),
  v AS (SELECT * FROM r WHERE o_orderpriority IS NOT NULL), u AS (SELECT unit, count(*) AS votes, count(o_orderpriority) AS valid FROM r GROUP BY 1), f AS ({_VOTE.format("unit")}),
  o AS (SELECT unit, max(label) FILTER (ordering = 0) AS order0, max(label) FILTER (ordering = 1) AS order1 FROM ({_VOTE.format("unit, ordering")}) GROUP BY 1),
  p AS (SELECT unit, count(DISTINCT label) > 1 AS m, string_agg(provider || '=' || label, ',' ORDER BY provider) AS models FROM ({_VOTE.format("unit, provider")}) GROUP BY 1),
  l AS (SELECT unit, 2 * count(*) FILTER (low) >= count(*) AS low FROM v GROUP BY 1),
  h AS (SELECT unit, string_agg(label || '=' || n, ',' ORDER BY label) AS label_counts FROM (SELECT unit, o_orderpriority AS label, count(*) AS n FROM v GROUP BY ALL) GROUP BY 1),
  j AS (SELECT unit, votes, valid, label AS final, order0, order1, CASE WHEN valid > 0 THEN coalesce(order0 <> order1, false) END AS order_disagreement, models, m AS model_disagreement, label_counts, low
    FROM u LEFT JOIN f USING (unit) LEFT JOIN o USING (unit) LEFT JOIN p USING (unit) LEFT JOIN l USING (unit) LEFT JOIN h USING (unit)),
  w AS (SELECT *, CASE WHEN valid = 0 THEN 'no valid verdicts' ELSE concat_ws('; ', CASE WHEN model_disagreement THEN 'cross-model disagreement' END, CASE WHEN order_disagreement THEN 'order-swap disagreement' END,
    CASE WHEN final IN ('2-HIGH', '1-URGENT') THEN 'final=' || final END, CASE WHEN low THEN 'low confidence' END, CASE WHEN valid < votes THEN (votes - valid) || ' verdict(s) failed' END) END AS flag_reason FROM j)"""


def order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a jury's requests and answers: of ten, one gave no verdict and one a label outside the list."""
    o = table(spark, sf_dir, "orders")
    manifest = o.select(F.col("o_orderkey").alias("cid"), F.col("o_custkey").alias("unit"), (F.year("o_orderdate") % 2).alias("ordering"), F.col("o_orderstatus").alias("provider"))
    label = F.when(F.col("o_orderkey") % 10 == 1, "no label").otherwise(F.col("o_orderpriority"))
    given = o.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("cid"), label.alias("label"), F.when(F.col("o_totalprice") < 50000, "low").otherwise("high").alias("confidence"), F.lit(None).cast("string").alias("error"))
    return agreement.verdicts(manifest, given, _LABELS)


@query(_VERDICTS + " SELECT unit AS o_custkey, final, order0, order1, order_disagreement, model_disagreement, flag_reason, flag_reason <> '' AS flagged FROM w")
def a15_a16_split_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agreement.aggregate_verdicts(order_verdicts(spark, sf_dir), _LABELS, _LABELS[3:])
    return found.select(F.col("unit").alias("o_custkey"), "final", "order0", "order1", "order_disagreement", "model_disagreement", "flag_reason", "flagged")


def _said(m: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")


@query(_VERDICTS + " SELECT unit, final, models, label_counts, votes, valid, flag_reason FROM w")
def a20_verdict_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agreement.aggregate_verdicts(order_verdicts(spark, sf_dir), _LABELS, _LABELS[3:])
    return found.select("unit", "final", _said("model_labels").alias("models"), _said("label_counts").alias("label_counts"), "votes", "valid", "flag_reason")


@query(_VERDICTS + """ SELECT 'final' AS kind, final AS name, count(*) AS n FROM w GROUP BY final UNION ALL SELECT 'signal', 'flagged', count(*) FROM w WHERE flag_reason <> '' HAVING count(*) > 0
  UNION ALL SELECT 'signal', 'model_disagreement', count(*) FROM w WHERE model_disagreement HAVING count(*) > 0 UNION ALL SELECT 'signal', 'order_disagreement', count(*) FROM w WHERE order_disagreement HAVING count(*) > 0""")
def a21_verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.verdict_summary(agreement.aggregate_verdicts(order_verdicts(spark, sf_dir), _LABELS, _LABELS[3:]))


_VOTE_SAID = "(year(o_orderdate) % 2) || ':' || o_orderstatus || ':' || CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 10 = 1 THEN 'none' ELSE o_orderpriority END"


@query(f"SELECT o_custkey AS unit, string_agg({_VOTE_SAID}, ',' ORDER BY {_VOTE_SAID}) AS votes FROM orders GROUP BY 1")
def a19_vote_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("votes", lambda v: F.concat(v["ordering"].cast("string"), F.lit(":"), v["provider"], F.lit(":"), F.coalesce(v["label"], v["error"], F.lit("none"))))
    return agreement.vote_lists(order_verdicts(spark, sf_dir)).select("unit", F.array_join(F.array_sort(said), ",").alias("votes"))


@query("""WITH i AS (SELECT DISTINCT c_mktsegment AS instance FROM customer), g AS (SELECT instance, ordering, provider, row_number() OVER (ORDER BY instance, ordering, p) - 1 AS k
    FROM i, (SELECT unnest([0, 1]) AS ordering), (SELECT unnest(['F', 'O', 'P']) AS provider, unnest([0, 1, 2]) AS p)),
  n AS (SELECT c_mktsegment AS instance, year(o_orderdate) % 2 AS ordering, o_orderstatus AS provider, count(*) AS answers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT 'c' || k AS cid, instance, ordering, provider, coalesce(answers, 0) AS answers FROM g LEFT JOIN n USING (instance, ordering, provider)""")
def j10_request_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    grid = results.request_grid(customer.select(F.col("c_mktsegment").alias("instance")), ["F", "O", "P"])
    n = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("instance"), (F.year("o_orderdate") % 2).alias("ordering"), F.col("o_orderstatus").alias("provider")).agg(F.count("*").alias("answers"))
    return grid.join(n, ["instance", "ordering", "provider"], "left").select("cid", "instance", "ordering", "provider", F.coalesce("answers", F.lit(0)).alias("answers"))


@query("""WITH m AS (SELECT o_custkey, least(3, (avg(o_totalprice) / 100000)::int) AS j FROM orders GROUP BY 1), p AS (SELECT least(3, greatest(0, floor(c_acctbal / 2500)::int)) AS h, j FROM customer JOIN m ON c_custkey = o_custkey),
  g AS (SELECT a.h, b.j, (SELECT count(*) FROM p WHERE p.h = a.h AND p.j = b.j) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS h) a, (SELECT unnest([0, 1, 2, 3]) AS j) b),
  f AS (SELECT h, j, n, sum(n) OVER (PARTITION BY h) AS r, sum(n) OVER (PARTITION BY j) AS c, sum(n) OVER () AS t FROM g),
  k AS (SELECT max(t)::bigint AS n, sum(n) FILTER (h = j) / max(t) AS agreement, 1 - sum(n * (h <> j)::int) * max(t) / sum((h <> j)::int * r * c) AS plain, 1 - sum(n * abs(h - j) / 3) * max(t) / sum(abs(h - j) / 3 * r * c) AS weighted FROM f)
  SELECT 'plain' AS kind, n, round(agreement, 6) AS agreement, round(plain, 6) AS kappa FROM k UNION ALL SELECT 'weighted', n, round(agreement, 6), round(weighted, 6) FROM k""")
def a23_confusion_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.least(F.lit(3), F.rint(F.avg("o_totalprice") / 100000).cast("int")).alias("j"))
    level = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 2500).cast("int")))
    grid = agreement.confusion(table(spark, sf_dir, "customer").join(means, F.col("c_custkey") == F.col("o_custkey")).select(level.alias("h"), "j"), 4)
    return agreement.kappa(grid, 4, False).select(F.lit("plain").alias("kind"), "*").unionByName(agreement.kappa(grid, 4, True).select(F.lit("weighted").alias("kind"), "*"))


@query("""WITH p AS (SELECT quality AS h, toxic AS j FROM labels), l AS (SELECT unnest([0, 1]) AS label)
  SELECT label, (SELECT count(*) FROM p WHERE h = label) AS support_h, (SELECT count(*) FROM p WHERE j = label) AS support_j,
    round((SELECT avg((j = label)::int) FROM p WHERE h = label), 6) AS recall, round((SELECT avg((h = label)::int) FROM p WHERE j = label), 6) AS "precision" FROM l""")
def a25_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.per_class(agreement.confusion(table(spark, sf_dir, "labels").select(F.col("quality").alias("h"), F.col("toxic").alias("j")), 2))


@query("""WITH r AS (SELECT doc_id, quality, toxic, ((doc_id % 2147483647 + 42) * 48271) % 2147483647 AS k, ((doc_id % 2147483647 + 43) * 48271) % 2147483647 AS c FROM documents JOIN labels USING (doc_id))
  SELECT doc_id, quality, toxic, c % 2 = 0 AS swap FROM r ORDER BY k, doc_id LIMIT 50""")
def o8_validation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return results.validation_sheet(rows, "doc_id", 50).select("doc_id", "quality", "toxic", "swap")


@query("""SELECT c_mktsegment, coalesce(nullif(count(*) FILTER (o_orderstatus = 'F'), 0)::varchar, '-') AS "F", coalesce(nullif(count(*) FILTER (o_orderstatus = 'O'), 0)::varchar, '-') AS "O",
  coalesce(nullif(count(*) FILTER (o_orderstatus = 'P'), 0)::varchar, '-') AS "P" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a26_exit_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return results.count_pivot(joined, "c_mktsegment", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT source, count(*) AS total, count(quality) AS evaluated, count(*) FILTER (quality = 1) AS resolved, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def a27_model_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return results.rollup(joined.withColumn("resolved", F.col("quality") == 1), "source", "resolved")


@query("""WITH t AS (SELECT DISTINCT event_type, rank FROM (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS rank FROM events)), u AS (SELECT user_id, ts::date AS d, list(DISTINCT event_type) AS s FROM events GROUP BY 1, 2),
  m AS (SELECT (SELECT string_agg(CASE WHEN list_contains(s, event_type) THEN '1' ELSE '0' END, '' ORDER BY rank) FROM t) AS mask FROM u) SELECT mask, count(*) AS n FROM m GROUP BY 1""")
def a29_region_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.struct("user_id", F.to_date("ts")).alias("day"), "event_type")
    return results.regions(e, "day", "event_type", sorted(results.by_count(e, "event_type")))


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS text FROM conversations GROUP BY 1")
def w4_last_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.last_where(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant", "text")


_RECORDED = """WITH d AS (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), e AS (SELECT *, (doc_id % len(lines))::int + 1 AS n FROM d),
  s AS (SELECT *, 'o__' || CASE WHEN doc_id % 23 = 0 THEN 'nowhere' ELSE source END || '-' || doc_id AS instance_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS base_commit,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'd' || doc_id || '.py' END AS file, CASE WHEN doc_id % 17 = 0 THEN 'x' WHEN doc_id % 19 = 0 THEN '999999' ELSE n::varchar END AS line,
    CASE doc_id % 9 WHEN 0 THEN '  ' || lines[n] || ' ' WHEN 1 THEN replace(lines[n], ' ', '') WHEN 2 THEN concat_ws(' ', lines[n], lines[n + 1]) WHEN 3 THEN coalesce(lines[n + 1], 'none') WHEN 4 THEN lines[n][1:30] || '...'
      WHEN 5 THEN replace(lines[n], '"', '''') WHEN 6 THEN 'no such words' WHEN 7 THEN coalesce(CASE WHEN n > 2 THEN lines[n - 2] END, 'none') ELSE concat_ws(' ', lines[n], lines[n + 1], lines[n + 2]) END AS statements FROM e)"""


def recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as source files, and statements recorded for one line each: right, altered by rule, or not to be found."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py"))
    sources = d.filter("doc_id % 29 <> 0").select(F.col("source").alias("repo"), F.col("lang").alias("commit"), path.alias("path"), "text")
    e = d.select("doc_id", "source", "lang", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")).withColumn("n", F.pmod("doc_id", F.size("lines")).cast("int") + 1)
    own, after, second = (F.get("lines", F.col("n") + k) for k in (-1, 0, 1))
    kind = F.pmod("doc_id", F.lit(9))
    stmt = (
        F.when(kind == 0, F.concat(F.lit("  "), own, F.lit(" ")))
        .when(kind == 1, F.replace(own, F.lit(" "), F.lit("")))
        .when(kind == 2, F.concat_ws(" ", own, after))
        .when(kind == 3, F.coalesce(after, F.lit("none")))
        .when(kind == 4, F.concat(F.left(own, F.lit(30)), F.lit("...")))
        .when(kind == 5, F.replace(own, F.lit('"'), F.lit("'")))
        .when(kind == 6, "no such words")
        .when(kind == 7, F.coalesce(F.when(F.col("n") > 2, F.get("lines", F.col("n") - 3)), F.lit("none")))
        .otherwise(F.concat_ws(" ", own, after, second))
    )
    repo = F.when(F.col("doc_id") % 23 == 0, "nowhere").otherwise(F.col("source"))
    rows = e.select(
        F.concat(F.lit("o__"), repo, F.lit("-"), F.col("doc_id").cast("string")).alias("instance_id"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("lang")).alias("base_commit"),
        F.when(F.col("doc_id") % 13 == 0, "").otherwise(path).alias("file"),
        F.when(F.col("doc_id") % 17 == 0, "x").when(F.col("doc_id") % 19 == 0, "999999").otherwise(F.col("n").cast("string")).alias("line"),
        stmt.alias("statements"),
    )
    return materialise(rows, "rows"), materialise(sources, "sources")


_CHECKED = (
    _RECORDED
    + r""",
  t AS (SELECT *, CASE WHEN file = '' OR line = '' THEN 'no_location' WHEN base_commit = '' THEN 'error:no_base_commit' WHEN doc_id % 23 = 0 THEN 'error:repo_missing' WHEN doc_id % 29 = 0 THEN 'error:path_or_commit_missing'
      WHEN NOT regexp_full_match(line, '[0-9]+') THEN 'error:bad_line' WHEN line::bigint NOT BETWEEN 1 AND len(lines) THEN 'error:line_out_of_range' END AS stopped,
    [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in lines] AS c, [regexp_replace(x, '\s+', '', 'g') for x in lines] AS z, trim(regexp_replace(statements, '\s+', ' ', 'g')) AS cs, regexp_replace(statements, '\s+', '', 'g') AS zs FROM s),
  x AS (SELECT *, regexp_replace(lines[n], '^\s+|\s+$', '', 'g') AS own, ([k for k in range(2, 26) if n + k - 1 <= len(lines) AND replace(array_to_string(z[n:n + k - 1], ''), '"', '''') = replace(zs, '"', '''')])[1] AS wrapped,
    ([d for d in flatten([[-k, k] for k in range(1, 11)]) if n + d >= 1 AND n + d <= len(lines) AND replace(c[n + d], '"', '''') = replace(cs, '"', '''')])[1] AS moved FROM t),
  y AS (SELECT *, coalesce(stopped, CASE WHEN own = regexp_replace(statements, '^\s+|\s+$', '', 'g') THEN 'match' WHEN c[n] = cs OR z[n] = zs THEN 'whitespace' WHEN wrapped IS NOT NULL THEN 'multiline' WHEN replace(c[n], '"', '''') = replace(cs, '"', '''') THEN 'quote_diff'
    WHEN moved IS NOT NULL THEN 'line_offset' WHEN contains(statements, '...') THEN 'paraphrase' ELSE 'mismatch' END) AS status FROM x)"""
)


@query(
    _CHECKED
    + """ SELECT instance_id, file, line, status, CASE WHEN stopped IS NULL THEN own ELSE '' END AS repo_line, CASE status WHEN 'multiline' THEN 'spans ' || wrapped || ' lines'
    WHEN 'line_offset' THEN 'actual line ' || (n + moved) || ' (Δ' || CASE WHEN moved > 0 THEN '+' ELSE '' END || moved || ')' WHEN 'paraphrase' THEN 'recorded statement is shorthand' ELSE '' END AS detail FROM y"""
)
def f12_check_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.check_rows(*recorded(spark, sf_dir)).select("instance_id", "file", "line", "status", "repo_line", "detail")


@query(_CHECKED + " SELECT status, count(*) AS n FROM y GROUP BY 1")
def a4_check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.check_rows(*recorded(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(_CHECKED + """, k AS (SELECT count(*) AS rows, count(DISTINCT instance_id) AS instances, count(*) FILTER (status IN ('match', 'whitespace', 'multiline', 'quote_diff')) AS agree,
  count(*) FILTER (status IN ('line_offset', 'paraphrase', 'mismatch')) AS review FROM y) SELECT *, round(agree / nullif(agree + review, 0), 6) AS share_agreeing FROM k""")
def a6_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.check_summary(statements.check_rows(*recorded(spark, sf_dir)))


@query(r"""WITH p AS (SELECT d.doc_id, coalesce(d.text, '') AS cur, coalesce(o.text, '') AS ext FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1),
  n AS (SELECT *, trim(regexp_replace(cur, '\s+', ' ', 'g')) AS c, trim(regexp_replace(ext, '\s+', ' ', 'g')) AS e FROM p), r AS (SELECT *, length(e) / greatest(1, length(c)) AS ratio FROM n),
  b AS (SELECT *, CASE WHEN regexp_replace(cur, '^\s+|\s+$', '', 'g') = regexp_replace(ext, '^\s+|\s+$', '', 'g') THEN 'exact match' WHEN regexp_replace(replace(cur, '"', ''''), '\s+', '', 'g') = regexp_replace(replace(ext, '"', ''''), '\s+', '', 'g') THEN 'whitespace/quote only'
    WHEN ratio <= 1.5 THEN 'same statement reformatted (x)' WHEN c <> '' AND contains(e, c) THEN 'sub-statement pointer, balloons x' ELSE 'differs / paraphrase (x)' END AS reason FROM r)
  SELECT doc_id, CASE WHEN reason = 'exact match' THEN 'good' WHEN reason LIKE 'wh%' OR reason LIKE 'same%' THEN 'safe' ELSE 'unsafe' END AS bucket, reason, CASE WHEN reason LIKE '%x' OR reason LIKE '%x)' THEN round(ratio, 6) END AS ratio FROM b""")
def f13_classify_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the one with the next id."""
    d = table(spark, sf_dir, "documents")
    other = d.select((F.col("doc_id") - 1).alias("_id"), F.col("text").alias("other"))
    found = statements.change(F.coalesce("text", F.lit("")), F.coalesce("other", F.lit("")))
    pairs = d.join(other, F.col("doc_id") == F.col("_id"), "left").select("doc_id", found.alias("c"))
    return pairs.select("doc_id", "c.bucket", F.regexp_replace("c.reason", r"x[0-9.]+", "x").alias("reason"), F.round("c.ratio", 6).alias("ratio"))


@query("""WITH o AS (SELECT l_orderkey AS unit, l_linenumber AS line FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS unit, l_linenumber - l_linenumber % 2 AS "start", l_linenumber - l_linenumber % 2 + 2 AS "end" FROM lineitem WHERE l_quantity > 25)
  SELECT unit, line, x."start", x."end" FROM o LEFT JOIN LATERAL (SELECT s."start", s."end" FROM s WHERE s.unit = o.unit AND s."start" <= o.line AND o.line <= s."end" ORDER BY 1, 2 LIMIT 1) x ON true""")
def j12_span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber") - F.col("l_linenumber") % 2
    spans = line.filter("l_quantity > 25").select(F.col("l_orderkey").alias("unit"), start.alias("start"), (start + 2).alias("end")).distinct()
    return joins.containing(line.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("line")), spans, ["unit"])


@query(r"""SELECT page_id, regexp_replace(regexp_replace(trim(coalesce(url, '')), '\\', '/', 'g'), '^[./]+', '') AS file, regexp_replace(regexp_replace(url, '^.*?__', ''), '-[0-9]+$', '') AS repo,
  rtrim(replace(trim(regexp_replace(html, '\s+', ' ', 'g')), ' ', ''), ',:;') AS loose, list_extract(string_split(url, '__'), -1) AS short, lower(trim(url)) AS label, regexp_extract(url, '[^-]*$') AS number,
  CASE WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '^[0-9]+$') THEN regexp_extract(url, '[^/]*$')::bigint END AS line FROM pages""")
def f1_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        T.norm_file("url").alias("file"),
        T.repo_name("url").alias("repo"),
        T.loose_stmt("html").alias("loose"),
        T.short_id("url").alias("short"),
        T.enum("url").alias("label"),
        T.change_number("url").alias("number"),
        T.parse_line(F.substring_index("url", "/", -1)).alias("line"),
    )


@query(r"""SELECT page_id, rtrim(replace(trim(regexp_replace(html, '\s+', ' ', 'g')), ' ', ''), ',:;') AS loose FROM pages""")
def f1_text_normalize_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.loose_stmt("html").alias("loose"))


_CASE = """SELECT event_id, user_id, event_type, ts, CASE event_type WHEN 'click' THEN 'failure' WHEN 'view' THEN 'skipped' WHEN 'purchase' THEN 'error' END AS d,
    CASE event_id % 6 WHEN 0 THEN concat('XFAIL: ', event_type) WHEN 1 THEN 'unexpectedly passing' WHEN 2 THEN 'Expected test failure' WHEN 3 THEN 'XPASS(strict)' WHEN 4 THEN 'for now' END AS m,
    CASE event_id % 4 WHEN 0 THEN 'tests.test_a' WHEN 1 THEN 'tests.test_a.Case.Inner' WHEN 2 THEN '' ELSE 'other.Case' END AS c, CASE WHEN event_id % 5 <> 0 THEN 'tests/test_a.py' END AS f,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('t', user_id) END AS name FROM {events}"""
_NODES = f"""WITH e AS ({_CASE.format(events="events")}), k AS (SELECT *, CASE WHEN d IN ('failure', 'error') THEN 'failed' WHEN d = 'skipped' THEN CASE WHEN m LIKE 'XFAIL%' OR m LIKE 'Expected%' THEN 'xfailed' WHEN m LIKE 'XPASS%' OR m LIKE 'unexp%' THEN 'passed' ELSE 'skipped' END ELSE 'passed' END AS bucket,
    CASE WHEN f IS NULL THEN CASE WHEN c = '' THEN name ELSE c || '::' || name END WHEN c IN ('', 'tests.test_a') THEN CASE WHEN name = '' THEN f ELSE f || '::' || name END
    WHEN c = 'tests.test_a.Case.Inner' THEN f || '::Case.Inner::' || name ELSE c || '::' || name END AS node FROM e)"""


def event_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as test cases: (event_id, user_id, run: the day, pos, bucket, node)."""
    e = spark.sql(_CASE, events=table(spark, sf_dir, "events"))
    return e.select("event_id", "user_id", F.to_date("ts").alias("run"), F.col("event_id").alias("pos"), results.categorize(F.col("d"), F.col("m")).alias("bucket"), results.node_id(F.col("c"), F.col("f"), F.col("name")).alias("node"))


@query(_NODES + " SELECT event_id, bucket, node FROM k")
def f14_test_categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cases(spark, sf_dir).select("event_id", "bucket", "node")


_IN = "sha256(coalesce(string_agg(node, ',' ORDER BY event_id) FILTER (bucket = '{0}'), '')) AS {0}"


@query(_NODES + " SELECT ts::date AS run, " + ", ".join(_IN.format(b) for b in results.BUCKETS) + " FROM k GROUP BY 1")
def a31_test_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.test_buckets(event_cases(spark, sf_dir)).select("run", *[F.sha2(F.array_join(b, ","), 256).alias(b) for b in results.BUCKETS])


@query(_NODES + " SELECT node, string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS buckets FROM k GROUP BY 1 HAVING count(DISTINCT bucket) > 1")
def x6_flaky_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.flaky(event_cases(spark, sf_dir)).select("node", F.array_join("buckets", ",").alias("buckets"))


@query("""WITH e AS (SELECT ts::date AS day, event_type, user_id FROM events), p AS (SELECT day, lag(day) OVER (ORDER BY day) AS base FROM (SELECT DISTINCT day FROM e)),
  r AS (SELECT p.day AS run, event_type, user_id, 1 AS x, 0 AS y FROM e JOIN p ON e.day = base UNION ALL SELECT p.day, event_type, user_id, 0, 1 FROM e JOIN p ON e.day = p.day WHERE base IS NOT NULL)
  SELECT run, event_type, user_id, greatest(sum(x) - sum(y), 0)::bigint AS only_a, greatest(sum(y) - sum(x), 0)::bigint AS only_b FROM r GROUP BY 1, 2, 3 HAVING sum(x) <> sum(y)""")
def x6_run_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's run against the one before, whatever the order."""
    pairs = results.consecutive(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day")
    return results.run_difference(*pairs, ["run", "event_type", "user_id"])


@query("""WITH e AS (SELECT ts::date AS day, event_type, user_id, row_number() OVER (PARTITION BY ts::date, event_type ORDER BY ts, event_id) AS pos FROM events),
  p AS (SELECT day, lag(day) OVER (ORDER BY day) AS base FROM (SELECT DISTINCT day FROM e)),
  r AS (SELECT p.day AS run, event_type, pos, user_id, 1 AS x, 0 AS y FROM e JOIN p ON e.day = base UNION ALL SELECT p.day, event_type, pos, user_id, 0, 1 FROM e JOIN p ON e.day = p.day WHERE base IS NOT NULL)
  SELECT run, event_type, pos, user_id, greatest(sum(x) - sum(y), 0)::bigint AS only_a, greatest(sum(y) - sum(x), 0)::bigint AS only_b FROM r GROUP BY 1, 2, 3, 4 HAVING sum(x) <> sum(y)""")
def x6_run_equality_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's run against the one before, by bucket, position in it and node."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("day", "event_type").orderBy("ts", "event_id")))
    return results.run_difference(*results.consecutive(e, "day"), ["run", "event_type", "pos", "user_id"])


@query("""SELECT doc_id, coalesce(quality::varchar, '') AS quality, coalesce(t.tag, '') AS tag FROM documents LEFT JOIN labels USING (doc_id)
  LEFT JOIN LATERAL (SELECT unnest(CASE WHEN toxic = 1 THEN ['toxic', 'flag'] WHEN toxic = 0 THEN ['clean'] ELSE [] END) AS tag) t ON true""")
def p2_explode_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.expr("CASE WHEN toxic = 1 THEN array('toxic', 'flag') WHEN toxic = 0 THEN array('clean') ELSE array() END")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"), F.explode_outer(tags).alias("tag")).fillna("", ["tag"])


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1""")
def a32_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(order)["o_orderkey"].alias("first_order"), F.max(order)["o_orderkey"].alias("last_order"))


@query("""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS n FROM pages""")
def a30_distinct_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))).alias("n"))


@query("""SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(text) < 200 THEN 'short' WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'low' ELSE 'ok' END AS reason
  FROM documents LEFT JOIN labels USING (doc_id)""")
def p8_error_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    reason = statements.first_error((F.trim(text) == "", "empty"), (F.char_length(text) < 200, "short"), (F.col("quality").isNull(), "unlabelled"), (F.col("quality") == 0, "low"))
    return joined.select("doc_id", reason.alias("reason"))


@query("""WITH r AS (SELECT source AS model, lang AS instance, max((quality = 1)::int) = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
  f AS (SELECT i.lang AS instance, m.source AS model, CASE WHEN ok THEN 'True' WHEN NOT ok THEN 'False' ELSE 'missing' END AS v FROM (SELECT DISTINCT lang FROM documents) i CROSS JOIN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) m LEFT JOIN r ON r.instance = i.lang AND r.model = m.source), c AS (SELECT source AS model, count(*) AS n FROM documents GROUP BY 1)
  SELECT instance, string_agg(model || '=' || v, ',' ORDER BY n DESC, model) AS cells FROM f JOIN c USING (model) GROUP BY 1""")
def k10_result_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix with a column for every model of the table, the most frequent first; a row's cells as one string, as SQL
    can't name columns by data."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    ok = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("source").alias("model"), F.col("lang").alias("instance"), (F.col("quality") == 1).alias("resolved"))
    models = results.by_count(d.filter("source IS NOT NULL"), "source")
    return results.as_text(results.result_matrix(ok, d.select(F.col("lang").alias("instance")), models), "instance")


@query("""WITH r AS (SELECT source AS model, lang AS instance, max((quality = 1)::int) = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2)
  SELECT i.lang AS instance, m.source AS model, CASE WHEN ok THEN 'True' WHEN NOT ok THEN 'False' ELSE 'missing' END AS resolved
  FROM (SELECT DISTINCT lang FROM documents) i CROSS JOIN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) m LEFT JOIN r ON r.instance = i.lang AND r.model = m.source""")
def k10_result_matrix_all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix over every model of the table, in long form, as its columns depend on the table."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    ok = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("source").alias("model"), F.col("lang").alias("instance"), (F.col("quality") == 1).alias("resolved"))
    models = results.by_count(d.filter("source IS NOT NULL"), "source")
    return results.result_matrix(ok, d.select(F.col("lang").alias("instance")), models).unpivot("instance", [F.col(f"`{m}`") for m in models], "model", "resolved")


from accordant.plans import changes, more  # noqa: E402, F401  (they register their queries)

"""Readers for annotation documents, decision tables, test reports and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.sources.junit import junit_cases  # noqa: F401


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, stem, doc VARIANT) of every *.json file, by stem; the id falls back to the stem, the file's name.  Files that
    aren't JSON have a null doc; a missing folder has no documents."""
    if not _there(spark, path):
        return spark.createDataFrame([], "instance_id string, stem string").withColumn("doc", F.try_parse_json(F.lit(None).cast("string")))
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select("value", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("stem"))
    doc = raw.select("stem", F.try_parse_json("value").alias("doc"))
    return doc.select(F.coalesce(F.nullif(F.try_variant_get("doc", "$.instance_id", "string"), F.lit("")), "stem").alias("instance_id"), "stem", "doc").orderBy("stem")


def locations(documents: DataFrame, field: str = "root_cause") -> DataFrame:
    """(instance_id, idx, file, line, stmt) of a document's locations; entries that aren't objects are passed over."""
    entries = F.try_variant_get("doc", f"$.{field}", "array<variant>")
    found = documents.select("instance_id", F.posexplode(entries).alias("idx", "value")).filter("schema_of_variant(value) LIKE 'OBJECT%'")
    text = lambda k: F.coalesce(F.try_variant_get("value", f"$.{k}", "string"), F.lit(""))
    return found.select("instance_id", "idx", text("file").alias("file"), F.try_variant_get("value", "$.line", "bigint").alias("line"), text("statement").alias("stmt"))


def reasoning(documents: DataFrame) -> DataFrame:
    """(instance_id, reasoning) with '' for a missing one."""
    return documents.select("instance_id", F.coalesce(F.try_variant_get("doc", "$.reasoning", "string"), F.lit("")).alias("reasoning"))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """All-string CSV with a header; quoted line ends and a byte-order mark are fine."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, sorted: the last word of each line, and of that what follows the last double underscore."""
    word = F.element_at(F.split(F.trim("value"), r"\s+"), -1)
    return spark.read.text(path).filter(F.trim("value") != "").select(F.element_at(F.split(word, "__"), -1).alias("instance")).distinct().orderBy("instance")


def plain_ids(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed lines as ids, as often as they stand."""
    return spark.read.text(path).select(F.trim("value").alias("instance")).filter("instance <> ''")


def exit_messages(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, role, exit_status) of the messages of every *.traj.json below the path; of several files of a folder the first by path."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.traj.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    first = raw.groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).agg(F.min_by(F.struct("file", "value"), "file").alias("x"))
    messages = F.from_json("x.value", "struct<messages: array<struct<role: string, extra: struct<exit_status: string>>>>")["messages"]
    return first.select(F.col("x.file").alias("file"), F.posexplode(messages).alias("pos", "m")).select("file", "pos", "m.role", F.col("m.extra.exit_status").alias("exit_status"))


def run_reports(spark: SparkSession, path: str) -> DataFrame:
    """(model, instance, resolved) of every <model>/<instance>/logs/run_evaluation/**/report.json below the path: of several for an
    instance the first by path; of a report the first entry; resolved is false where it isn't given."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    entry = F.map_values(F.from_json("value", "map<string, struct<resolved: boolean>>"))
    part = lambda k: F.regexp_extract("file", "([^/]+)/([^/]+)/logs/run_evaluation/", k)
    rows = raw.select(part(1).alias("model"), part(2).alias("instance"), "file", F.coalesce(F.get(entry, 0)["resolved"], F.lit(False)).alias("resolved")).filter("instance <> ''")
    return rows.groupBy("model", "instance").agg(F.min_by("resolved", "file").alias("resolved"))


def exit_statuses(spark: SparkSession, path: str) -> DataFrame:
    """(status, instance) of exit-status files: a name with a colon, then its instances as list items."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "exit_statuses*.yaml").text(path, wholetext=True)
    blocks = lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^  (\S+:(?:\n\s+- .+)+)"), 1)).alias("b"))
    return blocks.select(F.regexp_extract("b", r"^(\S+):", 1).alias("status"), F.explode(F.regexp_extract_all("b", F.lit(r"- ['\"]?([^'\"\n]+)"), 1)).alias("instance"))


def variant_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(instance, rule, verified) from the names of <instance>/<rule>[_unverified].patch files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.patch").load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)/([0-9]+)(_unverified)?\.patch$", 2)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("instance"), name.try_cast("int").alias("rule"), (~F.col("path").contains("_unverified")).alias("verified")).filter("rule IS NOT NULL")


def _named_json(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(instance, name, value): files below <instance>/ whose names fit, whole."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    part = lambda k: F.regexp_extract("file", r"([^/]+)/([^/]+)$", k)
    return raw.select(F.col("_metadata.file_path").alias("file"), "value").select(part(1).alias("instance"), part(2).alias("name"), "value")


def variant_truth(spark: SparkSession, path: str) -> DataFrame:
    """(instance, rule, verified, lines) of the <instance>/<rule>[_unverified]-gt.json files: the line numbers after the variant's patch."""
    rows = _named_json(spark, path, "*-gt.json")
    return rows.select(
        "instance",
        F.regexp_extract("name", "^([0-9]+)", 1).try_cast("int").alias("rule"),
        (~F.contains("name", F.lit("_unverified"))).alias("verified"),
        F.from_json("value", "array<bigint>").alias("lines"),
    ).filter("rule IS NOT NULL")


def combined_rules(spark: SparkSession, path: str) -> DataFrame:
    """(instance, rule, combined) of the <instance>/<rule>-summary.json files: the rules that a variant puts together."""
    rows = _named_json(spark, path, "*-summary.json")
    return rows.select("instance", F.regexp_extract("name", "^([0-9]+)", 1).try_cast("int").alias("rule"), F.from_json("value", "array<int>").alias("combined")).filter("rule IS NOT NULL")


def variant_patches(spark: SparkSession, path: str) -> DataFrame:
    """(instance, rule, verified, text) of the <instance>/<rule>[_unverified].patch files."""
    rows = _named_json(spark, path, "*.patch")
    rule = F.regexp_extract("name", r"^([0-9]+)(_unverified)?\.patch$", 1).try_cast("int")
    return rows.select("instance", rule.alias("rule"), (~F.contains("name", F.lit("_unverified"))).alias("verified"), F.col("value").alias("text")).filter("rule IS NOT NULL")


def instance_fields(spark: SparkSession, path: str) -> DataFrame:
    """(instance, field, content): every file of an instance bundle <instance>/<field>.<ending>, a field each."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    part = lambda k: F.regexp_extract("file", r"([^/]+)/([^/]+?)\.[^./]+$", k)
    return raw.select(part(1).alias("instance"), part(2).alias("field"), F.col("value").alias("content")).filter("instance <> ''")

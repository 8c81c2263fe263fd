"""Writers for reports and tables; all take a folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a report for reading.
MOST_LINES = 100_000


def nested_json(df: DataFrame, path: str, *by: str) -> None:
    """One JSON line per value of the first column of `by`, with lists of lists down to the rows for the others."""
    rest = df
    held = [c for c in df.columns if c not in by]
    for k in range(len(by), 0, -1):
        rows = F.sort_array(F.collect_list(F.struct(*held))).alias("rows")
        rest = rest.groupBy(*by[:k]).agg(rows)
        held = [by[k - 1], "rows"]
    rest.select(F.to_json(F.struct(by[0], "rows")).alias("value")).write.mode("overwrite").text(path)


def per_key_json(df: DataFrame, path: str, key: str) -> None:
    """A folder of JSON files for each key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def csv_with_header(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def buckets(df: DataFrame, path: str, bucket: str, format: str = "csv") -> None:
    """A folder for each bucket."""
    df.write.mode("overwrite").partitionBy(bucket).option("header", True).format(format).save(path)


def id_lists(ids: DataFrame, path: str, always: list[str], optional: list[str]) -> None:
    """ids: (bucket, id).  A sorted text file of ids for each bucket, under bucket=<name>: those in `always` also when empty, those in
    `optional` only with ids; what an earlier run left goes."""
    rows = ids.filter(F.col("bucket").isin([*always, *optional])).select("bucket", F.col("id").cast("string").alias("value"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "value").write.mode("overwrite").partitionBy("bucket").text(path)
    have = {r[0] for r in rows.select("bucket").distinct().collect()}
    spark = ids.sparkSession
    for name in always:
        if name not in have:
            spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bucket={name}")


def grouped_json(df: DataFrame, path: str, key: str) -> None:
    """JSON objects {key: [rows]}, one a line."""
    rows = F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != key])))
    df.groupBy(key).agg(rows.alias("rows")).select(F.to_json(F.create_map(F.col(key).cast("string"), "rows")).alias("value")).write.mode("overwrite").text(path)


def changes(df: DataFrame, path: str) -> None:
    """Replaced statements (instance_id, file, line, old, new): the new version is written beside the old, never over it."""
    df.write.mode("errorifexists").json(path)


def markdown(df: DataFrame) -> str:
    """A table as Markdown: a report for reading, so more than MOST_LINES rows are an error."""
    rows = df.limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} rows are no report for reading")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def markdown_report(title: str, units: DataFrame, status: str, sections: dict[str, str], metrics: DataFrame | None = None) -> str:
    """A title, the number of units of each status, the metrics, and for each status in `sections` (status: heading) the units' rows."""
    counts = {r[0]: r[1] for r in units.groupBy(status).count().collect()}
    out = [f"# {title}", "", f"- considered: **{sum(counts.values())}**", *[f"- {k}: **{n}**" for k, n in sorted(counts.items(), key=str)], ""]
    out += [markdown(metrics), ""] if metrics is not None else []
    for name, heading in sections.items():
        if counts.get(name):
            out += [f"## {heading} ({counts[name]})", "", markdown(units.filter(F.col(status) == name).drop(status).orderBy(units.columns[0])), ""]
    return "\n".join(out)

"""Readers and writers of annotation text formats: interval labels, time lists, pipe-separated tables, JSON Lines, JAMS documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r"^\s*(\S+)\s+(\S+)(?:\s+(.*?))?\s*$"


def read_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, start, end, label of interval label files, with blanks or tabs between fields.

    Blank lines are skipped and runs of blanks in a label become one. A line without two numbers is an error that names the line, or with strict off a row with null
    times.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value")).where("trim(value) <> ''")
    part = lambda i: F.regexp_extract("value", _LINE, i)
    start, end = part(1).try_cast("double"), part(2).try_cast("double")
    bad = F.raise_error(F.concat(F.lit("no label line: "), F.col("value")))
    ok = start.isNotNull() & end.isNotNull()
    checked = (lambda c: F.when(ok, c).otherwise(bad.cast("double"))) if strict else (lambda c: F.when(ok, c))
    return lines.select("file", checked(start).alias("start"), checked(end).alias("end"), F.regexp_replace(part(3), r"\s+", " ").alias("label"))


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """file, t of lists with one time a line; blank lines are skipped, others must be numbers."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value")).where("value <> ''")
    return lines.select("file", F.col("value").cast("double").alias("t"))


def read_pipe_table(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """Pipe-separated text with trimmed fields; the last column keeps further pipes."""
    rows = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    if header:  # the first line of each file
        first = rows.groupBy(F.col("_metadata.file_path").alias("_f")).agg(F.min("_line").alias("_first"))
        rows = rows.withColumn("_f", F.col("_metadata.file_path")).join(F.broadcast(first), "_f").where("_line > _first")
    parts = F.split("value", r"\|", len(columns))
    return rows.where("trim(value) <> ''").select(*[F.trim(F.get(parts, i)).alias(c) for i, c in enumerate(columns)])


def non_commercial(licence: Column) -> Column:
    upper = F.upper(licence)
    return F.coalesce(upper.contains("NON COMMERCIAL") | upper.contains("-NC"), F.lit(False))


def label_lines(df: DataFrame, start: str = "start", end: str = "end", label: str = "label", sep: str = " ") -> DataFrame:
    return df.select(F.format_string(f"%.6f{sep}%.6f{sep}%s", start, end, label).alias("value"))


def write_labels(df: DataFrame, path: str, sep: str = " ") -> None:
    """Interval label files, ordered by start and end within each part; sep: a blank or a tab."""
    ordered = df.select("start", "end", "label").repartitionByRange("start", "end", "label").sortWithinPartitions("start", "end", "label")
    label_lines(ordered, sep=sep).write.text(path)


def write_times(df: DataFrame, path: str, at: str = "t") -> None:
    df.select(at).repartitionByRange(at).sortWithinPartitions(at).select(F.format_string("%.6f", at).alias("value")).write.text(path)


def write_results(ok: DataFrame, errors: DataFrame, path: str) -> None:
    """JSON Lines of results and of error rows, which are kept beside them."""
    ok.unionByName(errors, allowMissingColumns=True).write.json(path)


def jams(df: DataFrame, key: str, namespace: str = "segment_open") -> DataFrame:
    """One JAMS document for each key of (key, start, end, label); a key's annotations form one document, so keys are files, not corpora."""
    data = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "label"))), lambda x: F.struct(x["start"].alias("time"), (x["end"] - x["start"]).alias("duration"), x["label"].alias("value"), F.lit(None).cast("double").alias("confidence")))
    note = F.struct(F.lit(namespace).alias("namespace"), data.alias("data"))
    return df.groupBy(key).agg(F.to_json(F.struct(F.struct(F.lit("0.3.0").alias("jams_version")).alias("file_metadata"), F.array(note).alias("annotations"))).alias("jams"))

"""Readers of JSON-lines logs: no line is dropped, broken ones are kept and marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n in ("tags", "asked", "symbols", "files") else T.StringType()) for n in (
    "id", "ts", "type", "project", "agent", "authority", "title", "text", "why", "topic", "class", "choice", "learning", "key", "value", "fact", "tags", "asked", "symbols", "files",
    "replaces_id", "retires_id", "closes_id", "by_id", "state", "status", "valid_from", "valid_until", "due", "from", "to", "kind",
)])


def parse_lines(lines: DataFrame, schema: T.StructType = ENTRY, value: str = "value") -> DataFrame:
    """Adds ``entry``, the parsed line or null, and ``broken``: no JSON object, or without an id that is text."""
    e = lines.withColumn("entry", F.from_json(F.col(value), schema, {"mode": "PERMISSIVE"}))
    whole = F.col(value).rlike(r"^\s*\{[\s\S]*\}\s*$") & F.col("entry.id").isNotNull()
    return e.withColumn("broken", ~F.coalesce(whole, F.lit(False)))


def read_drawers(spark: SparkSession, paths: list[str], schema: T.StructType = ENTRY) -> DataFrame:
    """All lines of JSON-lines files, plain or gzip, with their file; see parse_lines. Splits are read in parallel."""
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source")).filter(F.trim("value") != "")
    return parse_lines(rows, schema)


def write_drawers(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, one folder for each type and project."""
    entries.write.mode("append").partitionBy("type", "project").json(path)


def read_table_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A small append-only side table with an explicit schema; lines that do not fit come as nulls with their text in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def as_list(c: Column) -> Column:
    """A JSON list as text, or a comma list, as an array without blanks."""
    items = F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """A content-addressed store: each file with its SHA-256, size and time."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime")

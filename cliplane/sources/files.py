"""Files in and out: metadata documents, id lists, JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, over as many lines as it takes."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed; blank lines go."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """Place, size, suffix and time of change of files, without their content."""
    size = F.col("length")
    files = spark.read.format("binaryFile").load(path).drop("content")
    return files.select("path", size.alias("size"), F.bround(size / F.lit(1024.0 * 1024.0), 2).alias("size_mb"), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("suffix"), "modificationTime")


def asked_files(asked: DataFrame, found: DataFrame) -> DataFrame:
    """The files that are asked for by ``name`` (the end of their path), with what ``file_info`` found of each; null where there is none."""
    own = found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("_name"), "size", "size_mb", "suffix", "modificationTime")
    return asked.join(own, F.col("name") == F.col("_name"), "left").drop("_name")


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, null fields included."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)

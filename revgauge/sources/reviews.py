"""Raw review exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgauge.operators import intake
from revgauge.sources import csv_ranges

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_reviews_csv(spark: SparkSession, path, whole_files: bool = False) -> DataFrame:
    """A CSV file or folder with quoted line breaks, every column as text, blanks stripped from column names.

    Extra columns pass through; a missing required column is an error. Files are read in ranges (see ``csv_ranges``), so
    a single large export is many tasks. ``whole_files`` reads each file in one task instead: for files with a quote inside
    an unquoted field, or with \\r alone between lines.
    """
    raw = spark.read.options(**CSV_OPTIONS).csv(path) if whole_files else csv_ranges.read_csv(spark, path, CSV_OPTIONS)
    return intake.require_columns(raw.toDF(*[c.strip() for c in raw.columns]), intake.REQUIRED)


def raw_file_meta(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """Name, size and SHA-256 of each input file."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"))

"""Named result tables on storage, listed in a manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revgauge.functions import text
from revgauge.session import is_absent

MANIFEST = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("artifact_manifest", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("path", T.StringType())]))),
])


def read_manifest(spark: SparkSession, root: str, name: str = "metadata.json") -> DataFrame:
    """Name, type and path of each artifact; no rows when the manifest is absent or holds no such fields."""
    try:
        doc = spark.read.schema(MANIFEST).option("multiLine", "true").json(f"{root}/{name}")
    except AnalysisException as e:
        if not is_absent(e):
            raise
        doc = spark.createDataFrame([], MANIFEST)
    return doc.select("run_id", "created_at", "schema_version", F.inline("artifact_manifest"))


def unescape_strings(df: DataFrame) -> DataFrame:
    return df.select([text.html_unescape(f.name).alias(f.name) if isinstance(f.dataType, T.StringType)
                      else F.col(f.name) for f in df.schema.fields])


def _empty(spark: SparkSession, schema: T.StructType | None) -> DataFrame:
    return spark.createDataFrame([], schema or T.StructType([]))


def read_table(spark: SparkSession, root: str, kind: str, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One artifact with character references decoded; empty when absent or of an unknown kind.

    ``json`` is one document (an object, or an array of records) per file, ``jsonl`` one object per line.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    full = f"{root}/{path}"
    try:
        if kind == "csv":
            df = reader.options(header="true", multiLine="true", quote='"', escape='"',
                                inferSchema=str(schema is None).lower()).csv(full)
        elif kind in ("json", "jsonl"):
            df = reader.option("multiLine", str(kind == "json").lower()).json(full)
        elif kind == "parquet":
            df = reader.parquet(full)
        else:
            return _empty(spark, schema)
    except AnalysisException as e:
        if not is_absent(e):
            raise
        return _empty(spark, schema)
    return unescape_strings(df)


def load_artifacts(spark: SparkSession, root: str, schemas: Mapping[str, T.StructType] | None = None):
    """Every table of the manifest by name. A manifest is a short list; the tables stay lazy."""
    schemas = schemas or {}
    return {r.name: read_table(spark, root, r.type, r.path, schemas.get(r.name))
            for r in read_manifest(spark, root).select("name", "type", "path").collect()}


def write_artifacts(tables: Mapping[str, DataFrame], root: str, kinds: Mapping[str, str] | None = None,
                    run_id: str = "run", created_at: str = "") -> None:
    """Write each table in its kind (Parquet unless stated) and then the manifest.

    A ``json`` table of one row is one document; one of several rows is stored with a row per line, and the manifest
    lists it as ``jsonl``.
    """
    kinds, items = kinds or {}, []
    for name, df in tables.items():
        kind = kinds.get(name, "parquet")
        path = f"{root}/{name}"
        writer = df.write.mode("overwrite")
        if kind == "csv":
            writer.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false",
                           ignoreTrailingWhiteSpace="false").csv(path)
        elif kind == "json" and len(df.take(2)) < 2:
            df.coalesce(1).write.mode("overwrite").json(path)
        elif kind in ("json", "jsonl"):
            kind = "jsonl"
            writer.json(path)
        elif kind == "parquet":
            writer.parquet(path)
        else:
            raise ValueError(f"unknown kind: {kind}")
        items.append((name, kind, name))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run_id, created_at, "v0", items)], MANIFEST).coalesce(1).write.mode("overwrite").json(
        f"{root}/metadata.json")

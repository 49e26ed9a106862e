"""Comparison of current tables with a backup."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _differences(current: DataFrame, backup: DataFrame) -> DataFrame:
    """Rows that do not occur equally often on both sides, found in one aggregation over both tables."""
    tagged = current.withColumn("_side", F.lit(1)).unionByName(backup.withColumn("_side", F.lit(-1)))
    return tagged.groupBy(*current.columns).agg(F.sum("_side").alias("_d")).where(F.col("_d") != 0)


def _status(name: str, spark: SparkSession, current: DataFrame | None, backup: DataFrame | None) -> DataFrame:
    one = lambda s, n=None: spark.range(1).select(
        F.lit(name).alias("artifact"), F.lit(s).alias("status"), F.lit(n).cast("bigint").alias("n_different"))
    if current is None:
        return one("MISSING")
    if backup is None:
        return one("NO BACKUP")
    if [(f.name, f.dataType) for f in current.schema] != [(f.name, f.dataType) for f in backup.schema]:
        return one("DIFF")
    rows = _differences(current, backup).agg(F.coalesce(F.sum(F.abs("_d")), F.lit(0)).alias("n_different"))
    return rows.select(F.lit(name).alias("artifact"),
                       F.when(F.col("n_different") == 0, "OK").otherwise("DIFF").alias("status"), "n_different")


def validate_artifacts(spark: SparkSession, current: Mapping[str, DataFrame | None],
                       backup: Mapping[str, DataFrame | None], names=None) -> DataFrame:
    """OK, DIFF, MISSING or NO BACKUP per artifact, with the number of rows only one side has."""
    names = list(names or dict.fromkeys([*current, *backup]))
    return reduce(DataFrame.unionByName, [_status(n, spark, current.get(n), backup.get(n)) for n in names])


def all_valid(statuses: DataFrame) -> bool:
    """A missing backup does not fail the check."""
    return statuses.where(F.col("status").isin("DIFF", "MISSING")).isEmpty()

"""Approximate reports from stored sketches: distinct counts and quartiles under any filter without reading reviews.

One row per day, entity type and rating holds counts and mergeable sketches. A question merges the rows that it selects,
so its cost depends on the number of cells, not of reviews; new reviews are further rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a filter or grouping may use.
CELL = ("day", "entity_type", "rating")
#: Distinct counts: 2 ** 12 registers, a relative standard error of 1.04 / 64; three of these are taken as the bound.
LG_REGISTERS = 12
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_REGISTERS / 2)
#: Quantiles: sketches of this size are off by 1.65 % of the ranks at most, with 99 % confidence.
QUANTILE_SIZE = 200
RANK_ERROR = 0.0165


def review_sketches(reviews: DataFrame) -> DataFrame:
    """A row per day, entity type and rating (each may be null) with its counts and sketches."""
    cells = reviews.withColumn("day", F.to_date("review_date")).groupBy(*CELL)
    return cells.agg(
        F.count("*").alias("reviews"), F.count("token_count").alias("counted"), F.sum("token_count").alias("tokens"),
        F.min("token_count").alias("token_min"), F.max("token_count").alias("token_max"),
        F.hll_sketch_agg("entity_id", LG_REGISTERS).alias("entity_sketch"),
        F.hll_sketch_agg("entity_name", LG_REGISTERS).alias("name_sketch"),
        F.kll_sketch_agg_bigint(F.col("token_count").cast("bigint"), QUANTILE_SIZE).alias("token_sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """One row per value of ``by``, in the form of the input: tables of several batches become one, or a coarser one."""
    return sketches.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("reviews", "counted", "tokens")],
        F.min("token_min").alias("token_min"), F.max("token_max").alias("token_max"),
        F.hll_union_agg("entity_sketch").alias("entity_sketch"), F.hll_union_agg("name_sketch").alias("name_sketch"),
        F.kll_merge_agg_bigint("token_sketch").alias("token_sketch"))


def report(sketches: DataFrame, where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Reviews, entities, names, and the range, mean and quartiles of tokens, per value of ``by`` (none: one row).

    Counts, range and mean are exact. Distinct counts lie within ``DISTINCT_ERROR`` of the truth (at three standard
    errors), quartiles within ``RANK_ERROR`` of their rank. No selected cell gives no row with ``by``, else zeros and
    nulls; cells without token counts have no quartiles.
    """
    own = merged(sketches if where is None else sketches.where(where), by)
    any_tokens = F.col("counted") > 0
    quartiles = [F.when(any_tokens, F.kll_sketch_get_quantile_bigint("token_sketch", F.lit(p))).alias(name)
                 for name, p in (("token_q1", 0.25), ("token_median", 0.5), ("token_q3", 0.75))]
    return own.select(
        *by, F.coalesce("reviews", F.lit(0)).alias("reviews"),
        F.coalesce(F.hll_sketch_estimate("entity_sketch"), F.lit(0)).alias("entities"),
        F.coalesce(F.hll_sketch_estimate("name_sketch"), F.lit(0)).alias("names"),
        "token_min", "token_max", F.try_divide(F.col("tokens").cast("double"), F.col("counted")).alias("token_mean"), *quartiles)

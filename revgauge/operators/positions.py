"""Exact positions in sorted order, without sorting a whole group in one task.

A pool such as "all people, one dimension" can hold most rows of the table, so a window over it would be one task.
Here equal values are counted first (combined before the shuffle), values are cut into buckets at approximate
quantiles of the whole column, running counts are taken inside each (group, bucket), and the totals of lower buckets
shift them. A bucket holds an even share of all values, so no (group, bucket) holds more, however large its group. The
cuts only balance the work; the positions are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 1024
ROWS_PER_BUCKET = 1_000_000


def _cuts(df: DataFrame, value: str) -> Column:
    """Sorted cut points as one scalar: none for a small table, at most ``MAX_BUCKETS - 1``. They come from every
    16th value by hash."""
    probs = ", ".join(f"{i / MAX_BUCKETS}D" for i in range(1, MAX_BUCKETS))
    sampled = f"CASE WHEN pmod(xxhash64(`{value}`), 16) = 0 THEN `{value}` END"
    whole = df.agg(F.expr(f"percentile_approx({sampled}, array({probs}), 10000)").alias("c"),
                   F.count(F.lit(1)).alias("n"))
    buckets = F.least(F.lit(MAX_BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(ROWS_PER_BUCKET))))
    return whole.select("c", F.floor(F.lit(MAX_BUCKETS) / buckets).alias("step")).select(
        F.filter("c", lambda c, i: (i + 1) % F.col("step") == 0).alias("cuts")).scalar()


def _bucket(value: str, cuts: Column) -> Column:
    """How many of the sorted cuts lie below the value, by halving; reading past the end is NULL and counts as above."""
    steps = F.lit([MAX_BUCKETS >> i for i in range(1, MAX_BUCKETS.bit_length())])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(
        F.get(cuts, at + step - 1) < F.col(value), step).otherwise(0))
    # never NULL: otherwise the later join would test it on every row before the counting
    return F.coalesce(below, F.lit(0))


def value_positions(df: DataFrame, groups: Sequence[str], value: str, member: Column | None = None) -> DataFrame:
    """One row per (group, distinct value): ``n_at`` rows at it, ``n_before`` rows below it, ``n_total`` in the
    group, and the group's ``low`` and ``high``. NULL values do not count. Without groups the table is one group.

    With ``member`` only rows where it holds are counted, but every value gets its position among them. ``low`` and
    ``high`` then still span all values.
    """
    groups = list(groups)
    present = df.where(F.col(value).isNotNull())
    weight = F.count(F.lit(1)) if member is None else F.count_if(member)
    counts = present.groupBy(*groups, value).agg(weight.alias("n_at"))
    cut = (counts.withColumn("_cuts", _cuts(present, value)).withColumn("_bucket", _bucket(value, F.col("_cuts")))
           .drop("_cuts"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket from here on: at most MAX_BUCKETS in a group
    group = Window.partitionBy(*groups)
    lower = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        cut.groupBy(*groups, "_bucket").agg(F.sum("n_at").alias("_n"), F.min(value).alias("_lo"),
                                            F.max(value).alias("_hi"))
        .select(*groups, "_bucket", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset"),
                F.sum("_n").over(group).alias("n_total"), F.min("_lo").over(group).alias("low"),
                F.max("_hi").over(group).alias("high"))
    )
    return (
        cut.withColumn("_run", F.coalesce(F.sum("n_at").over(within), F.lit(0)))
        .join(buckets, [*groups, "_bucket"])
        .select(*groups, value, "n_at", (F.col("_run") + F.col("_offset")).alias("n_before"), "n_total", "low", "high")
    )


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group; ``probs`` maps output column to probability."""
    groups = list(groups)
    spots = value_positions(df.select(*groups, value), groups, value)
    picks = []
    for name, q in probs.items():
        h = (F.col("n_total") - 1) * F.lit(float(q))
        low, high = F.floor(h), F.ceil(h)
        holds = lambda at: (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n_at"))
        at_low = F.max(F.when(holds(low), F.col(value).cast("double")))
        at_high = F.max(F.when(holds(high), F.col(value).cast("double")))
        part = F.max(h - low)
        picks.append((at_low + (at_high - at_low) * part).alias(name))
    return spots.groupBy(*groups).agg(*picks)


def with_positions(rows: DataFrame, spots: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Attach positions to rows; rows with a NULL value keep NULL positions. A value shared by very many rows is a
    skewed join key, which adaptive execution splits."""
    return rows.join(spots, [*groups, value], "left")


def average_rank_percent(n_before="n_before", n_at="n_at", n_total="n_total") -> Column:
    """Average rank of ties over the number of values, in percent, one decimal."""
    before, at, total = (F.col(c) if isinstance(c, str) else c for c in (n_before, n_at, n_total))
    return F.bround((before + (at + 1) / F.lit(2.0)) / total * 100, 1)


def min_max_percent(value, low="low", high="high") -> Column:
    """Place between lowest and highest in percent, one decimal; 50 when all are equal."""
    x, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (value, low, high))
    return F.when(hi > lo, F.bround((x - lo) / (hi - lo) * 100, 1)).when(x.isNotNull(), F.lit(50.0))

"""One evaluation per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    An expression used inside a lambda is otherwise computed for every element, and one used several times may be
    computed several times.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column, computed in its place. Filters on a plain column are pushed below it, and below a shuffle,
    where the column is computed for the filter alone and then again."""
    return df.withColumn(name, F.explode(F.array(value)))

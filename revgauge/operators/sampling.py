"""Reproducible samples: rows ordered by a digest of seed and id, so the pick does not depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_column: str = "review_id") -> DataFrame:
    """``n`` rows, or all when there are fewer."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string")), 256)
    return df.orderBy(digest, id_column).limit(n)


def sample_reviews(scored: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    keep = ("review_id", "entity_id", "entity_name", "entity_type")
    cols = [c for c in scored.columns if c in keep or c.startswith("sim_")]
    return sample_rows(scored.select(cols), n, seed)


def sample_scatter(df: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    rated = df.where(F.col("rating").isNotNull()).select("review_id", "rating", "token_count")
    return sample_rows(rated, n, seed)

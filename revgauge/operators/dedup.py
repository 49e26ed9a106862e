"""Identity, duplicates and incremental stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgauge.functions import text


def with_review_hash(df: DataFrame, body: str = "review_text_raw") -> DataFrame:
    return df.withColumn("review_hash", text.review_hash("entity_id", body, "review_date", "reviewer_name"))


def keep_first(df: DataFrame, key: str = "review_hash", order: str = "review_id") -> DataFrame:
    """The first row of each key in a stated order. Each task keeps only its own first before the shuffle, so a
    group of very many copies stays small."""
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def new_rows(batch: DataFrame, store: DataFrame, key: str = "review_hash") -> DataFrame:
    """Batch rows whose key is not stored; reads only the key column of the store."""
    return batch.join(store.select(key), key, "left_anti")


def union_by_name(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Columns matched by name; what one side lacks is NULL."""
    return store.unionByName(fresh, allowMissingColumns=True)


def incremental_delta(batch: DataFrame, store: DataFrame | None, full: bool = False) -> DataFrame:
    """Distinct batch rows that still have to be processed."""
    batch = keep_first(batch)
    if full or store is None or "review_hash" not in store.columns:
        return batch
    return new_rows(batch, store)


def incremental_append(batch: DataFrame, store: DataFrame | None, process: Callable[[DataFrame], DataFrame] = lambda d: d,
                       full: bool = False) -> DataFrame:
    """The store after a batch: deduplicate, process only rows not stored, append.

    ``full``, and a store without hashes, process everything anew. The delta holds one row per hash and none that is
    stored, so the union has no duplicates of its own; a store that may hold some is cleaned by ``keep_first``.
    """
    fresh = process(incremental_delta(batch, store, full))
    if full or store is None or "review_hash" not in store.columns:
        return fresh
    return union_by_name(store, fresh)


def snapshot_prune(store: DataFrame, snapshot: DataFrame, key: str = "review_hash") -> DataFrame:
    """Keep stored rows that the new export still holds."""
    return store.join(snapshot.select(key), key, "left_semi")

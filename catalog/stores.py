"""The incremental store: deltas, appends and pruning that open only what they need."""

from pyspark.sql import functions as F

from catalog.base import ORACLE, query, shaped
from catalog.intake import STORED, content_rows
from revgauge.operators import dedup
from revgauge.session import scratch_dir
from revgauge.sources.keyed_store import KeyedStore


def _store(spark, rows):
    store = KeyedStore(spark, scratch_dir(spark, "keyed"), "review_hash", rows_per_file=10_000)
    store.append(rows)
    return store


@query("delta_anti_join_store", ORACLE["delta_anti_join"])
def delta_anti_join_store(spark, d):
    rows = content_rows(spark, d).select("review_id", "entity_id", "review_hash")
    store = _store(spark, dedup.keep_first(rows.where(STORED)))
    return shaped(store.new_rows(rows).select("review_id", "review_hash"))


@query("incremental_append_store", ORACLE["incremental_append"])
def incremental_append_store(spark, d):
    rows = content_rows(spark, d).select("review_id", "entity_id", "review_hash")
    store = _store(spark, dedup.keep_first(rows.where(STORED)).withColumn("origin", F.lit("stored")))
    store.append(store.new_rows(dedup.keep_first(rows)).withColumn("origin", F.lit("new")))
    return shaped(store.rows().select("review_id", "review_hash", "origin"))


@query("snapshot_prune_store", ORACLE["snapshot_prune"])
def snapshot_prune_store(spark, d):
    rows = content_rows(spark, d).select("review_id", "entity_id", "review_hash")
    store = _store(spark, dedup.keep_first(rows))
    store.prune(rows.where(STORED))
    return shaped(store.rows().select("review_id", "review_hash"))

"""Continuous versions of the incremental append and the volume report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revgauge.operators import dedup
from revgauge.sources.keyed_store import KeyedStore


def review_store(spark, path: str) -> KeyedStore:
    return KeyedStore(spark, path, "review_hash")


def append_new_reviews(stream: DataFrame, store: str, checkpoint: str, order: str = "review_id") -> StreamingQuery:
    """Append reviews whose hash is not stored yet, whenever the first copy arrived; ``review_store`` reads them.

    A micro-batch opens only files that may hold one of its hashes. A batch that is run again after a failure is either
    stored, and changes nothing, or starts from what was stored before it.
    """
    reviews = review_store(stream.sparkSession, store)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id > reviews.last_batch():
            reviews.append(reviews.new_rows(dedup.keep_first(batch, order=order)), batch_id)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dedup_within(stream: DataFrame, delay: str = "1 day", ts: str = "review_date") -> DataFrame:
    """Drop copies that arrive within ``delay`` of each other in event time; state is bounded by the watermark."""
    return (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
            .dropDuplicatesWithinWatermark(["review_hash"]))


def review_volume(stream: DataFrame, period: str = "1 day", delay: str = "1 day", ts: str = "review_date") -> DataFrame:
    """Reviews per period; rows later than ``delay`` are dropped."""
    return (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
            .groupBy(F.window(ts, period)).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("period_start"), "n"))


def _volume_store(spark, path: str) -> KeyedStore:
    return KeyedStore(spark, path, "period_start", newest="batch_id")


def write_volume(volume: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Store the changed periods of each micro-batch; ``read_volume`` takes the latest of each."""
    periods = _volume_store(volume.sparkSession, table)

    def write(batch: DataFrame, batch_id: int) -> None:
        periods.append(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)

    return (volume.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_volume(spark, table: str) -> DataFrame:
    rows = _volume_store(spark, table).rows()
    if rows is None:
        return spark.createDataFrame([], "period_start timestamp, n bigint")
    return rows.select("period_start", "n")

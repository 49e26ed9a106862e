"""Streaming ingest and volume."""

from pyspark.sql import functions as F

from catalog.base import query, shaped, table
from catalog.intake import CONTENT
from revgauge.operators import dedup
from revgauge.session import scratch_dir
from revgauge.streaming import ingest


def _arrivals(spark, rows, key, parts=3, files=4, last=None):
    """The rows as a stream in the order of ``key``: ``parts`` micro-batches of ``files`` files; ``last`` is added to the
    last one."""
    path = scratch_dir(spark, "arrivals")
    cuts = rows.select(F.percentile_approx(key, [i / parts for i in range(1, parts)]).alias("c")).first().c
    bounds = [None, *cuts, None]
    for i in range(parts):
        part = rows
        if bounds[i] is not None:
            part = part.where(F.col(key) > F.lit(bounds[i]))
        if bounds[i + 1] is not None:
            part = part.where(F.col(key) <= F.lit(bounds[i + 1]))
        if last is not None and i == parts - 1:
            part = part.unionByName(last)
        part.repartition(files).write.mode("append").parquet(path)   # one after another: files are taken in this order
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _hashed(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("entity_id"), F.col("text").alias("review_text_raw"),
        F.lit(None).cast("timestamp_ntz").alias("review_date"), F.lit(None).cast("string").alias("reviewer_name"))
    return dedup.with_review_hash(rows).select("review_id", "review_hash")


@query("stream_dedup_ingest", f"WITH {CONTENT} SELECT min(review_id) AS review_id, review_hash FROM ct GROUP BY review_hash")
def stream_dedup_ingest(spark, d):
    """Three micro-batches; copies come within a batch and across batches."""
    store, mark = scratch_dir(spark, "stream-store"), scratch_dir(spark, "stream-mark")
    ingest.append_new_reviews(_arrivals(spark, _hashed(spark, d), "review_id"), store, mark).awaitTermination()
    return shaped(ingest.review_store(spark, store).rows().select("review_id", "review_hash"))


@query("stream_dedup_within", f"WITH {CONTENT} SELECT min(review_id) AS review_id, review_hash FROM ct GROUP BY review_hash")
def stream_dedup_within(spark, d):
    """All reviews fall on one day, so every copy lies within the delay, whichever batch it comes in."""
    out, mark = scratch_dir(spark, "within"), scratch_dir(spark, "within-mark")
    rows = _hashed(spark, d).withColumn("review_date", F.lit("2024-01-05").cast("timestamp"))
    fresh = ingest.dedup_within(_arrivals(spark, rows, "review_id"))
    fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(
        availableNow=True).start().awaitTermination()
    # which copy of one batch is kept is left open: the hash identifies it
    firsts = rows.groupBy("review_hash").agg(F.min("review_id").alias("review_id"))
    return shaped(spark.read.parquet(out).select("review_hash").join(firsts, "review_hash").select("review_id", "review_hash"))


@query("stream_review_volume", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS period_start,
  count(*) AS n FROM events GROUP BY ALL""")
def stream_review_volume(spark, d):
    """Three micro-batches in the order of time; a copy of the oldest event comes last, too late to count."""
    out, mark = scratch_dir(spark, "volume"), scratch_dir(spark, "volume-mark")
    events = table(spark, d, "events")
    late = events.orderBy("ts", "event_id").limit(1)
    volume = ingest.review_volume(_arrivals(spark, events, "ts", last=late), ts="ts")
    ingest.write_volume(volume, out, mark).awaitTermination()
    return shaped(ingest.read_volume(spark, out))

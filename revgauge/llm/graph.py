"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import salted_join, stored


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Alternating large-star and small-star steps: every step only relinks a node's neighbours to the smallest of them,
    so the number of edges never grows and a chain of n nodes settles in about log(n) rounds. A hub's edges are combined
    before they are shuffled, and meet the smallest of them in several tasks. Each round is written to the shared scratch folder. Loops and repeated edges are
    harmless, rows with a null end are ignored, no edges give no rows.
    """
    hi, lo = F.greatest(left, right), F.least(left, right)
    now = stored(edges.where(F.col(left) != F.col(right)).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", "v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        changed = _mark(after)
        if changed == mark:
            break
        now, mark = after, changed
    stars = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Two equal edge sets have equal marks."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(h))).first())

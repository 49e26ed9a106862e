"""Partner groups of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.operators.dedup import keep_first
from revgauge.operators.positions import value_positions


def real_groups(reviews: DataFrame, column: str = "partner_group") -> DataFrame:
    """The group named in each entity's first review; the code is also the name."""
    firsts = keep_first(reviews.select("entity_id", "review_id", column), "entity_id", "review_id")
    return firsts.select("entity_id", F.col(column).alias("partner_group_code"),
                         F.col(column).alias("partner_group_name"))


def group_size(code) -> Column:
    """3, 4 or 5, from the code's digest."""
    return 3 + F.conv(F.substring(F.sha2(F.col(code) if isinstance(code, str) else code, 256), 1, 4), 16, 10).cast("bigint") % 3


def hash_group_assignment(entities: DataFrame, groups: DataFrame, min_reviews: int = fv.MIN_GROUP_MEMBER_REVIEWS,
                          order: str = "position") -> DataFrame:
    """Deal entities, ordered by the digest of their id, to groups (code, name, ``order``), 3 to 5 each.

    The k-th entity meets the group that holds slot k. Both ranks are counted in buckets of the sort order (see
    ``positions``), so neither table is sorted in one task, and any number of groups can be dealt.
    """
    sized = groups.select("code", "name", F.col(order).alias("_at"), group_size("code").alias("_size"))
    spread_out = sized.select("code", "name", "_at", F.explode(F.sequence(F.lit(1).cast("bigint"), "_size")).alias("_k"))
    # slots of one group share its place in the order: the k-th of them comes k - 1 after the first
    before = value_positions(spread_out, [], "_at").select("_at", "n_before")
    slots = spread_out.join(before, "_at").select((F.col("n_before") + F.col("_k")).alias("_n"), "code", "name")
    fit = entities.where((F.col("entity_type") == "advisor") & (F.col("review_count") >= min_reviews)).select(
        "entity_id", F.sha2(F.col("entity_id").cast("string"), 256).alias("_digest"))
    fit = fit.withColumn("_key", F.conv(F.substring("_digest", 1, 15), 16, 10).cast("bigint"))
    placed = fit.join(value_positions(fit, [], "_key").select("_key", "n_before"), "_key")
    # equal leading digits are as good as never met; the full digest settles them
    tie = Window.partitionBy("_key").orderBy("_digest", "entity_id")
    drawn = placed.select("entity_id", (F.col("n_before") + F.row_number().over(tie)).alias("_n"))
    return drawn.join(slots, "_n").select("entity_id", F.col("code").alias("partner_group_code"),
                                          F.col("name").alias("partner_group_name"))


def stale_members(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """Group members whose entity no longer exists."""
    return groups.join(entities.select("entity_id"), "entity_id", "left_anti")


def group_revalidation(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: members, stale members, and whether the stored groups may be kept."""
    stale = stale_members(groups, entities).agg(F.count(F.lit(1)).alias("n")).scalar()
    return groups.agg(F.count(F.lit(1)).alias("n_members")).withColumn("n_stale", stale).withColumn(
        "keep", F.col("n_stale") == 0)

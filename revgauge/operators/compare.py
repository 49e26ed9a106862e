"""Comparisons of chosen entities and partner groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.operators import ranking


def partner_group_list(groups: DataFrame) -> DataFrame:
    return groups.groupBy("partner_group_code", "partner_group_name").agg(F.count(F.lit(1)).alias("member_count"))


def group_profiles(groups: DataFrame, entities: DataFrame, code, method: str = "mean") -> DataFrame:
    """Enriched profiles of a group's members; members without scores drop out."""
    members = groups.where(F.col("partner_group_code") == F.lit(code)).select(
        "entity_id", "partner_group_code", "partner_group_name")
    return ranking.profiles(entities, members, method)


def entity_comparison(entities: DataFrame, ids: Sequence, method: str = "mean") -> DataFrame:
    """Enriched profiles of the given ids with their place in the list; unknown ids drop out."""
    if not ids:
        return ranking.profiles(entities, entities.where(F.lit(False)).select(
            "entity_id", F.lit(0).alias("position")), method)
    id_type = entities.schema["entity_id"].dataType
    asked = entities.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(i).cast(id_type) for i in ids])).alias("position", "entity_id"))
    return ranking.profiles(entities, asked, method).orderBy("position", "dim")


def head_to_head(entities: DataFrame, id_a, id_b, method: str = "mean") -> DataFrame:
    """Both profiles per dimension and the differences B - A, four decimals; no rows unless both are known."""
    both = entity_comparison(entities, [id_a, id_b], method)
    side = lambda p, s: both.where(F.col("position") == p).select(
        "dim", *[F.col(c).alias(f"{c}_{s}") for c in ("raw", "percentile", "normalized", "tier")])
    out = side(0, "a").join(side(1, "b"), "dim")
    return out.withColumns({f"diff_{c}": F.bround(F.col(f"{c}_b") - F.col(f"{c}_a"), 4)
                            for c in ("raw", "percentile", "normalized")})

"""Percentiles, tiers, profiles and leaderboards over entity scores.

The working form is long: (entity_id, entity_name, entity_type, review_count, method, dim, score).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import numbers, text
from revgauge.operators import positions, scoring

PEERS = ("entity_type", "method", "dim")


def enrich(rows: DataFrame, pool: DataFrame, groups: Sequence[str] = PEERS) -> DataFrame:
    """Raw, percentile, normalised score and tier of ``rows`` within the groups of ``pool``."""
    spots = positions.value_positions(pool.select(*groups, "score"), groups, "score")
    return (positions.with_positions(rows, spots, groups, "score")
            .withColumns({
                "raw": F.bround("score", 6),
                "percentile": positions.average_rank_percent(),
                "normalized": positions.min_max_percent("score"),
            })
            .withColumn("tier", numbers.tier_from_percentile("percentile"))
            .drop("score", "n_at", "n_before", "n_total", "low", "high"))


def percentile_rank(long: DataFrame, groups: Sequence[str] = PEERS) -> DataFrame:
    """Average rank of ties over the number of scores in the group, in percent."""
    spots = positions.value_positions(long.select(*groups, "score"), groups, "score")
    return (positions.with_positions(long, spots, groups, "score")
            .withColumn("percentile", positions.average_rank_percent())
            .drop("n_at", "n_before", "n_total", "low", "high"))


def minmax_normalize(long: DataFrame, groups: Sequence[str] = PEERS) -> DataFrame:
    ends = long.groupBy(*groups).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return (long.join(ends, list(groups), "left")
            .withColumn("normalized", positions.min_max_percent("score")).drop("low", "high"))


def enrich_scores(entities: DataFrame, methods: Sequence[str] = fv.METHODS, composite: bool = True) -> DataFrame:
    """Enriched scores of all entities among those of their type; profiles and comparisons filter this table."""
    long = scoring.long_scores(entities, methods, "strict" if composite else None)
    return enrich(long, long)


def profiles(entities: DataFrame, chosen: DataFrame, method: str = "mean") -> DataFrame:
    """Enriched dimensions and composite of the chosen entities (a table with ``entity_id``)."""
    long = scoring.long_scores(entities, [method], "strict")
    return enrich(long.join(chosen, "entity_id"), long)


def entity_profile(entities: DataFrame, entity_id, method: str = "mean") -> DataFrame:
    long = scoring.long_scores(entities, [method], "strict")
    target = long.where(F.col("entity_id") == F.lit(entity_id))
    peers = long.where(F.col("entity_type") == entities.where(F.col("entity_id") == F.lit(entity_id))
                       .agg(F.max("entity_type")).scalar())
    return enrich(target, peers)


def premier_percentiles(entities: DataFrame, method: str = "mean", min_reviews: int = 0,
                        premier: int = fv.PREMIER_REVIEWS) -> DataFrame:
    """Percentile of every entity against peers of its type with enough reviews, itself always included.

    An entity outside the pool is ranked as if it were added to it, so all entities are answered at once.
    """
    groups = ["entity_type", "dim"]
    long = scoring.long_scores(entities, [method])
    member = F.col("review_count") >= min_reviews if min_reviews > 0 else F.lit(True)
    spots = positions.value_positions(long.select(*groups, "review_count", "score"), groups, "score", member)
    pool_size = entities.groupBy("entity_type").agg(F.count_if(member).alias("_pool"))
    extra = F.when(member, 0).otherwise(1)
    ranked = positions.with_positions(long, spots, groups, "score").join(pool_size, "entity_type")
    return ranked.select(
        "entity_id", "entity_name", "entity_type", "method", "dim",
        positions.average_rank_percent("n_before", F.col("n_at") + extra, F.col("n_total") + extra)
        .alias("percentile"),
        (F.col("_pool") + extra).alias("peer_count"), "review_count",
        (F.col("review_count") >= premier).alias("premier"))


def leaderboard(entities: DataFrame, method: str = "mean", entity_type: str = "all", min_reviews: int = 0,
                top_n: int = 10, dimension: str = "all") -> DataFrame:
    """Best entities per dimension and composite within the filtered pool, which may mix types.

    The few winners are found first and only they are joined to their positions.
    """
    pool = entities if entity_type == "all" else entities.where(F.col("entity_type") == entity_type)
    if min_reviews > 0:
        pool = pool.where(F.col("review_count") >= min_reviews)
    long = scoring.long_scores(pool, [method], "present").where(F.col("score").isNotNull())
    if dimension != "all":
        long = long.where(F.col("dim") == dimension)
    best = Window.partitionBy("dim").orderBy(F.desc("score"), "entity_id")
    top = long.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)
    return enrich(top, long, ["dim"]).select(
        "dim", "rank", "entity_id", "entity_name", "entity_type", F.col("raw").alias("score"), "percentile",
        "normalized", "tier", "review_count")


def leaderboard_extremes(board: DataFrame) -> DataFrame:
    """Best and worst entry of each list by percentile (the list is at most ``top_n`` rows per dimension)."""
    # order as in the list among equal percentiles: the first is best, the last is worst
    key = F.struct(F.col("percentile"), -F.col("rank"))
    return board.groupBy("dim").agg(F.max_by("entity_id", key).alias("best_id"), F.max("percentile").alias("best"),
                                    F.min_by("entity_id", key).alias("worst_id"), F.min("percentile").alias("worst"))


def evidence_topk(scored: DataFrame, dims: Sequence[str], top_n: int = 3, length: int = 200) -> DataFrame:
    """The reviews that score highest per entity and dimension, with snippet and tier.

    Texts are cut to snippets before rows are multiplied, and each task forwards its best ``top_n`` only. Reviews of an
    entity come together first, in pieces of even size, so that most rows drop out where they are and no task sorts more
    than a piece, however large the table or the entity.
    """
    best = Window.partitionBy("entity_id", "dim").orderBy(F.desc("score"), "review_id")
    return _evidence_rows(scored, dims, length, lambda slim: slim.hint("rebalance", "entity_id"), lambda rows: (
        rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)))


def evidence_list(scored: DataFrame, dim: str, length: int = 200) -> DataFrame:
    """All reviews of each entity by one dimension, best first: a global sort, which also splits a hot entity."""
    return _evidence_rows(scored, [dim], length).orderBy("entity_id", F.desc("score"), "review_id")


def _evidence_rows(scored: DataFrame, dims: Sequence[str], length: int, dealt: Callable = lambda slim: slim,
                   chosen: Callable = lambda rows: rows) -> DataFrame:
    """``dealt`` places the reviews, one row each; ``chosen`` picks of the multiplied rows before these get their labels."""
    cells = [F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(f"sim_{d}"), F.lit(0.0)).alias("score")) for d in dims]
    reviewer = F.coalesce(F.nullif(F.col("reviewer_name"), F.lit("")), F.lit("Anonymous"))
    slim = dealt(scored.select("review_id", "entity_id", "reviewer_name", "review_date",
                               text.snippet("review_text_raw", length).alias("snippet"), F.array(*cells).alias("_c")))
    rows = chosen(slim.select("review_id", "entity_id", "reviewer_name", "review_date", "snippet", F.inline("_c")))
    return rows.select("review_id", "entity_id", reviewer.alias("reviewer"),
                       F.date_format("review_date", "yyyy-MM-dd").alias("review_day"), "snippet", "dim", "score",
                       numbers.tier_from_breakpoints("score").alias("tier"), *(["rank"] if "rank" in rows.columns else []))


def top_ids(entities: DataFrame, method: str, dim: str, top_n: int = 10) -> DataFrame:
    return (entities.where(F.col(f"sim_{method}_{dim}").isNotNull())
            .orderBy(F.desc(f"sim_{method}_{dim}"), "entity_id").limit(top_n).select("entity_id"))


def method_overlap(entities: DataFrame, dims: Sequence[str], top_n: int = 10) -> DataFrame:
    """Which entities the methods share among their top lists: one row per dimension and set of methods."""
    long = scoring.long_scores(entities, fv.METHODS, dims=dims).where(F.col("score").isNotNull())
    best = Window.partitionBy("dim", "method").orderBy(F.desc("score"), "entity_id")
    top = long.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top_n)
    return (top.groupBy("dim", "entity_id").agg(F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))
            .groupBy("dim", "methods").agg(
                F.count(F.lit(1)).alias("n"),
                F.array_join(F.array_sort(F.collect_list(F.col("entity_id").cast("string"))), ",").alias("entity_ids")))

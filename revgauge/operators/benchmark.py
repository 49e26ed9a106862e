"""Pool statistics, breakpoints and score distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import numbers
from revgauge.operators import corpus, positions, scoring


def _of_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities if entity_type == "all" else entities.where(F.col("entity_type") == entity_type)


def population_medians(entities: DataFrame, method: str = "mean", entity_type: str = "firm") -> DataFrame:
    long = scoring.long_scores(_of_type(entities, entity_type), [method])
    return positions.exact_quantiles(long, ["dim"], "score", {"median": 0.5})


def method_breakpoints(entities: DataFrame, method: str = "mean", entity_type: str = "firm") -> DataFrame:
    """Quartiles per dimension; type ``all`` takes every entity."""
    long = scoring.long_scores(_of_type(entities, entity_type), [method])
    return positions.exact_quantiles(long, ["dim"], "score", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def pool_totals(entities: DataFrame, min_reviews: int = fv.PREMIER_REVIEWS) -> DataFrame:
    """Size, types and review counts of all entities and of the premier pool; two rows from one pass."""
    n = F.col("review_count")

    def block(name, inside):
        count = F.when(inside, n)
        return F.struct(
            F.lit(name).alias("pool"), F.count_if(inside).alias("total"),
            F.count_if(inside & (F.col("entity_type") == "firm")).alias("firms"),
            F.count_if(inside & (F.col("entity_type") == "advisor")).alias("advisors"),
            F.avg(count).alias("reviews_mean"), F.percentile(count, F.lit(0.5)).alias("reviews_median"),
            F.coalesce(F.min(count), F.lit(0)).alias("reviews_min"),
            F.coalesce(F.max(count), F.lit(0)).alias("reviews_max"))

    return entities.agg(F.array(block("all", F.lit(True)), block("premier", n >= min_reviews)).alias("b")).select(
        F.inline("b"))


def pool_dim_stats(entities: DataFrame, min_reviews: int = fv.PREMIER_REVIEWS, method: str = "mean") -> DataFrame:
    """Mean, median, deviation, quartiles and range per pool and dimension."""
    pools = F.when(F.col("review_count") >= min_reviews, F.array(F.lit("all"), F.lit("premier"))).otherwise(
        F.array(F.lit("all")))
    long = (scoring.long_scores(entities, [method]).where(F.col("score").isNotNull())
            .select(F.explode(pools).alias("pool"), "dim", "score"))
    plain = long.groupBy("pool", "dim").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
                                            F.min("score").alias("min"), F.max("score").alias("max"))
    ranks = positions.exact_quantiles(long, ["pool", "dim"], "score", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return plain.join(ranks, ["pool", "dim"])


def score_distributions(entities: DataFrame, method: str = "mean", entity_type: str = "all",
                        min_reviews: int = 0) -> DataFrame:
    """Score values per dimension under type and pool filter."""
    pool = _of_type(entities, entity_type)
    if min_reviews > 0:
        pool = pool.where(F.col("review_count") >= min_reviews)
    return scoring.long_scores(pool, [method]).where(F.col("score").isNotNull()).select("dim", "entity_id", "score")


def score_histogram(entities: DataFrame, method: str = "mean", entity_type: str = "all", min_reviews: int = 0,
                    bins: int = 20, entity_id=None) -> DataFrame:
    """Counts in equal bins per dimension; ``entity_id`` marks the bins that hold this entity."""
    values = score_distributions(entities, method, entity_type, min_reviews)
    out = corpus.histogram(values, "score", bins, ["dim"])
    if entity_id is None:
        return out
    own = scoring.long_scores(entities.where(F.col("entity_id") == F.lit(entity_id)), [method]).select(
        "dim", F.col("score").alias("_own"))
    ends = values.groupBy("dim").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    marks = own.join(ends, "dim").select(
        "dim", F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(
            (F.col("_own") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))), F.lit(bins - 1)))
        .otherwise(F.lit(0)).cast("int").alias("_bin"))
    return out.join(marks, "dim", "left").withColumn(
        "is_here", F.coalesce(F.col("bin") == F.col("_bin"), F.lit(False))).drop("_bin")


def entity_list(entities: DataFrame) -> DataFrame:
    return entities.select("entity_type", "entity_id", "entity_name", "review_count").distinct()


def entity_directory(entities: DataFrame, entity_type: str = "firm", min_reviews: int = 0) -> DataFrame:
    """Entities of a type, in a pool, by name."""
    return (entity_list(entities).where((F.col("entity_type") == entity_type) & (F.col("review_count") >= min_reviews))
            .orderBy("entity_name", "entity_id"))


def with_confidence(entities: DataFrame) -> DataFrame:
    return entities.withColumn("confidence_tier", numbers.confidence_tier("review_count"))


def tiers_from_breakpoints(entities: DataFrame, method: str = "mean", entity_type: str = "firm") -> DataFrame:
    """Raw scores of a type with the tier their own breakpoints give."""
    long = scoring.long_scores(_of_type(entities, entity_type), [method])
    marks = method_breakpoints(entities, method, entity_type)
    return long.join(marks, "dim").withColumn("tier", numbers.tier_from_breakpoints("score", "p75", "p50", "p25"))


def peer_table(entities: DataFrame, entity_id, method: str = "mean", entity_type: str = "all",
               min_reviews: int = 0) -> DataFrame:
    """Score, percentile in the pool and breakpoints of one entity, per dimension."""
    from revgauge.operators import ranking

    target = F.lit(entity_id)
    own = scoring.long_scores(entities.where(F.col("entity_id") == target), [method]).select("dim", "score")
    rank = ranking.premier_percentiles(entities, method, min_reviews).where(F.col("entity_id") == target).select(
        "dim", "percentile")
    return own.join(rank, "dim", "left").join(method_breakpoints(entities, method, entity_type), "dim", "left")

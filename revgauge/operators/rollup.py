"""Entity vectors from review vectors.

Vectors are averaged with Spark ML's summarizer: partial sums per task travel, not vectors, so an entity that holds a
large share of all reviews costs no more than any other.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import dates, numbers, vectors
from revgauge.operators import positions


def newest(df: DataFrame, column: str = "review_date") -> Column:
    """The newest date as a scalar, the default for "today": results then depend on the data only."""
    return df.agg(F.max(column)).scalar()


def _named(df: DataFrame) -> Column:
    name = "entity_name" if "entity_name" in df.columns else "entity_id"
    return F.min_by(name, "review_id").alias("entity_name")


def entity_mean_vectors(df: DataFrame, vector: str = "embedding", tokens: str = "token_count", as_of=None,
                        days_per_year: float = fv.DAYS_PER_YEAR) -> DataFrame:
    """Normalised mean vector per entity with name, review count, token sum, median age and last review date.

    Ages are whole days, so the exact median keeps one counter per distinct day.
    """
    as_of = newest(df) if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    rows = df.where(F.col(vector).isNotNull() & F.col("entity_id").isNotNull()).withColumn(
        "_age", dates.age_years_days("review_date", as_of, days_per_year))
    n_tokens = F.sum(tokens) if tokens in df.columns else F.lit(None).cast("bigint")
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vector))))
    return (rows.groupBy("entity_id").agg(
        _named(df), F.count(F.lit(1)).alias("n_reviews"), n_tokens.alias("n_tokens_raw"),
        F.percentile("_age", F.lit(0.5)).alias("median_age_years"),
        F.max("review_date").alias("most_recent_review_date"), mean.alias("_mean"))
        .withColumn("vector_mean", vectors.unit("_mean")).drop("_mean"))


def with_staleness_penalty(entities: DataFrame, as_of, days_per_year: float = fv.DAYS_PER_YEAR,
                           target: float = fv.PENALTY_AT_P75) -> DataFrame:
    """Staleness from the last review, and exp(-rate * staleness) with the rate set so that the 75th percentile of
    staleness is penalised to ``target``. ``as_of`` is a timestamp or a scalar column.

    Staleness is whole days, so the exact percentile keeps one counter per distinct day. If it is 0 there is no
    finite rate: fresh entities get NULL, all others 0.
    """
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    staleness = dates.age_years_days("most_recent_review_date", as_of, days_per_year)
    stale = entities.withColumn("staleness_years", staleness)
    p75 = stale.agg(F.percentile("staleness_years", F.lit(0.75))).scalar()
    decay = F.exp(F.try_divide(F.ln(F.lit(target)), p75) * F.col("staleness_years"))
    return stale.withColumn("penalty_factor", F.coalesce(decay, F.when(F.col("staleness_years") > 0, F.lit(0.0))))


def with_penalized_vectors(entities: DataFrame) -> DataFrame:
    return entities.withColumn("vector_penalized", vectors.scale("vector_mean", "penalty_factor"))


def entity_vectors(df: DataFrame, vector: str = "embedding", as_of=None,
                   days_per_year: float = fv.DAYS_PER_YEAR) -> DataFrame:
    """Mean and penalised vectors of every entity."""
    when = newest(df) if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    means = entity_mean_vectors(df, vector, as_of=as_of, days_per_year=days_per_year)
    return with_penalized_vectors(with_staleness_penalty(means, when, days_per_year))


def with_half_life_weight(df: DataFrame, half_life: float = fv.HALF_LIFE_YEARS,
                          days_per_year: float = fv.DAYS_PER_YEAR, as_of=None) -> DataFrame:
    """Age from the newest review and its weight, halved every ``half_life`` years."""
    as_of = newest(df) if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    aged = df.withColumn("age_years", dates.age_years_exact("review_date", as_of, days_per_year))
    return aged.withColumn("w_time", numbers.half_life_weight("age_years", half_life))


def weighted_mean_vector(vector, weight) -> Column:
    """Aggregate: sum of weighted vectors over the sum of weights; the plain mean when all weights are 0.

    The floor of 1e-300 does not show beside any real weight and turns all-zero weights into equal ones. A missing
    weight counts as 0.
    """
    w = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(1e-300))
    return vector_to_array(Summarizer.mean(array_to_vector(vector), w))


def entity_weighted_vectors(weighted: DataFrame, vector: str = "embedding", weight: str = "w_time",
                            median_age: bool = True) -> DataFrame:
    """Weighted mean vector per entity, not normalised, with counts, token sums, dates, effective sample size and,
    on request, the median age."""
    rows = weighted.where(F.col(vector).isNotNull() & F.col("entity_id").isNotNull())
    sums = {"token_count": "total_tokens", "clean_token_count": "total_tokens_nostop"}
    out = rows.groupBy("entity_id").agg(
        _named(weighted), F.count(F.lit(1)).alias("n_reviews_used"),
        *[F.sum(c).alias(a) for c, a in sums.items() if c in weighted.columns],
        F.min("review_date").alias("min_review_date"), F.max("review_date").alias("max_review_date"),
        F.coalesce(numbers.effective_n(weight), F.lit(0.0)).alias("effective_n_time"),
        weighted_mean_vector(F.col(vector), F.col(weight)).alias("vector_weighted"))
    if median_age:
        # ages are exact to the second: distinct values are many, so the median comes from positions
        medians = positions.exact_quantiles(rows, ["entity_id"], "age_years", {"median_age_years": 0.5})
        out = out.join(medians, "entity_id", "left")
    return out

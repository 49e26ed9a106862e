"""Corpus reports: quality, coverage, volume and length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revgauge import fixed_values as fv
from revgauge.functions import dates, numbers, text
from revgauge.operators import positions


def reviews_per_entity(df: DataFrame) -> DataFrame:
    return df.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_reviews"))


def quality_summary(df: DataFrame, name: str = "entity_name", body: str = "review_text_raw",
                    blank_is_empty: bool = True) -> DataFrame:
    """Rows, columns, distinct ids and names, date span, shares without rating and without text.

    A blank text counts as empty before cleaning; in the query report only a missing one does.
    """
    empty = F.col(body).isNull()
    if blank_is_empty:
        empty = empty | (text.collapse_edges(body) == "")
    # each distinct count reads one column; two of them in one aggregate would copy every row, text and all
    distinct = lambda c: df.select(c).distinct().agg(F.count(c)).scalar()
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"),
        F.min("review_date").alias("date_min"), F.max("review_date").alias("date_max"),
        F.avg(F.col("rating").isNull().cast("int")).alias("rating_missing_frac"),
        F.avg(empty.cast("int")).alias("text_empty_frac"),
    )
    return counted.select("n_rows", "n_cols", distinct("entity_id").alias("n_entities"), distinct(name).alias("n_names"),
                          *counted.columns[2:])


def missing_report(df: DataFrame) -> DataFrame:
    """Share and count of missing values per column, worst first."""
    def missing(field):
        gone = F.col(f"`{field.name}`").isNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            gone = gone | F.isnan(f"`{field.name}`")
        return F.count_if(gone)

    counted = df.agg(F.count(F.lit(1)).alias("_n"),
                     F.array(*[F.struct(F.lit(f.name).alias("column_name"), missing(f).alias("missing_count"))
                               for f in df.schema.fields]).alias("_m"))
    return (counted.select("_n", F.inline("_m"))
            .select("column_name", (F.col("missing_count") / F.col("_n")).alias("missing_frac"), "missing_count")
            .orderBy(F.desc("missing_frac"), "column_name"))


def eda_summary(df: DataFrame) -> DataFrame:
    """Reviews, entities, the distribution of reviews per entity and of tokens, shares of short reviews, and the number
    of reviews of each rating (lowest first, none given before all); one row."""
    per_entity = reviews_per_entity(df).agg(
        F.struct(*numbers.describe("n_reviews", "rpe")).alias("s")).scalar()
    short = lambda n: F.avg((F.coalesce(F.col("token_count") < n, F.lit(False))).cast("int"))
    totals = df.agg(F.count(F.lit(1)).alias("reviews"), *numbers.describe("token_count", "tokens"),
                    short(20).alias("pct_under_20_tokens"), short(50).alias("pct_under_50_tokens"))
    ratings = df.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("rating", "n")))).scalar()
    wide = totals.withColumns({"_rpe": per_entity, "rating_counts": ratings})
    return wide.select("reviews", F.col("_rpe.rpe_count").alias("entities"), "_rpe.*",
                       *[c for c in totals.columns if c != "reviews"], "rating_counts")


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of any numeric column; one row."""
    base = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
                  F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"))
    quartiles = positions.exact_quantiles(df.select(column), [], column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    q = quartiles.select(F.struct("p25", "p50", "p75").alias("q")).scalar()
    return base.withColumn("_q", q).select("count", "mean", "std", "min", "_q.p25", "_q.p50", "_q.p75", "max")


def coverage(df: DataFrame) -> DataFrame:
    n = F.col("n_reviews")
    cuts = F.percentile(n, F.lit([0.5, 0.9]))
    return reviews_per_entity(df).agg(
        F.count(F.lit(1)).alias("entities_total"),
        *[F.avg((n < k).cast("int")).alias(f"pct_entities_lt{k}") for k in (3, 5, 10)],
        F.get(cuts, F.lit(0)).alias("median_reviews_per_entity"), F.get(cuts, F.lit(1)).alias("p90_reviews_per_entity"),
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first("rating"))


def reviews_over_time(df: DataFrame, freq: str = "month", column: str = "review_date") -> DataFrame:
    """Reviews per period from the first to the last, periods without reviews as 0."""
    step = {"day": "interval 1 day", "month": "interval 1 month", "quarter": "interval 3 months",
            "year": "interval 1 year"}[freq]
    counts = (df.where(F.col(column).isNotNull()).groupBy(dates.period_start(column, freq).alias("start"))
              .agg(F.count(F.lit(1)).alias("n")))
    span = counts.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    calendar = span.where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr(step))).alias("start"))
    return (calendar.join(counts, "start", "left")
            .select(dates.period_label("start", freq).alias("period"), F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy("period"))


def reviews_by_year(df: DataFrame, column: str = "review_date") -> DataFrame:
    return df.groupBy(F.year(column).alias("review_year")).agg(F.count(F.lit(1)).alias("n")).orderBy("review_year")


def token_counts(df: DataFrame) -> DataFrame:
    return df.where(F.col("token_count").isNotNull()).select("review_id", F.col("token_count").cast("bigint"))


def histogram(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal bins between lowest and highest value (of the group); empty bins have no row."""
    keys = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    ends = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    if keys:
        placed = rows.join(ends, keys)
    else:
        placed = rows.withColumn("_e", ends.select(F.struct("_lo", "_hi").alias("e")).scalar()).select("_x", "_e.*")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    bin_no = F.when(F.col("_hi") > F.col("_lo"),
                    F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return (placed.groupBy(*keys, bin_no.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_lo").alias("_lo"), F.min(width).alias("_w"))
        .select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "n"))


def rating_vs_tokens(df: DataFrame) -> DataFrame:
    return df.where(F.col("rating").isNotNull() & F.col("token_count").isNotNull()).select(
        F.col("review_id").cast("string").alias("review_id"), "rating", "token_count")


def rating_token_correlation(df: DataFrame) -> DataFrame:
    """The scatter in numbers: pairs and their correlation."""
    return rating_vs_tokens(df).agg(F.count(F.lit(1)).alias("n"),
                                    F.corr("rating", F.col("token_count").cast("double")).alias("corr"))


def eda_meta(df: DataFrame) -> DataFrame:
    """Ranges and whole-number quartiles for filter controls; one row."""
    cut = lambda c, i: F.get(F.percentile(c, F.lit([0.25, 0.75])), F.lit(i)).cast("bigint")
    per_entity = reviews_per_entity(df).agg(F.struct(
        F.min("n_reviews").alias("reviews_per_entity_min"), F.max("n_reviews").alias("reviews_per_entity_max"),
        cut("n_reviews", 0).alias("rpe_q1"), cut("n_reviews", 1).alias("rpe_q3")).alias("s")).scalar()
    base = df.agg(
        F.min("review_date").alias("date_min"), F.max("review_date").alias("date_max"),
        F.count(F.lit(1)).alias("row_count"),
        F.min("token_count").cast("bigint").alias("token_min"), F.max("token_count").cast("bigint").alias("token_max"),
        cut("token_count", 0).alias("token_q1"), cut("token_count", 1).alias("token_q3"),
        F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"))
    return base.withColumn("_s", per_entity).select(*base.columns, "_s.*")


def entity_language_stats(df: DataFrame, tokens: str = "token_count") -> DataFrame:
    return df.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.count(tokens).alias("n_reviews"), F.sum(tokens).alias("total_tokens"), F.avg(tokens).alias("avg_tokens"))


def token_coverage_curve(df: DataFrame, tokens: str = "token_count", thresholds=fv.COVERAGE_THRESHOLDS) -> DataFrame:
    """Share of entities with at least so many tokens in total, and with fewer."""
    totals = entity_language_stats(df, tokens)
    shares = totals.agg(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.avg((F.col("total_tokens") >= t).cast("int")).alias("share_covered"),
                 F.avg((F.col("total_tokens") < t).cast("int")).alias("share_below")) for t in thresholds]).alias("s"))
    return shares.select(F.inline("s"))


def informative_share(df: DataFrame, min_rating: float = 4, tokens: str = "token_count",
                      informative: int = fv.INFORMATIVE_TOKENS, min_reviews: int = fv.MIN_REVIEWS,
                      top_n: int = 10) -> DataFrame:
    """Entities by their share of long reviews among well rated ones, best first."""
    long_enough = (F.col(tokens) >= informative).cast("int")
    return (
        df.where((F.col("rating") >= min_rating) & F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
            F.min_by("entity_name", "review_id").alias("entity_name"), F.count(F.lit(1)).alias("n_reviews"),
            F.sum(long_enough).alias("n_informative"), F.avg(long_enough).alias("share_informative"),
            F.avg(tokens).alias("avg_tokens"))
        .where(F.col("n_reviews") >= min_reviews)
        .orderBy(F.desc("share_informative"), "entity_id").limit(top_n)
    )

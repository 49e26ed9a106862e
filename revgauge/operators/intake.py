"""Standard columns, coercions and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revgauge import fixed_values as fv
from revgauge.functions import dates, numbers, text

REQUIRED = ("notification_page", "notification_name", "Content", "acf_rating")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"Missing expected columns: {missing}")
    return df


def coerce_dates(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Text to timestamp where the column exists; unreadable becomes NULL, or fails the job when ``strict``."""
    for c in columns:
        if c not in df.columns:
            continue
        parsed = dates.parse_date(c)
        if strict:
            message = F.concat(F.lit(f"{c} could not be parsed: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))
            parsed = F.when(parsed.isNull(), F.raise_error(message)).otherwise(parsed)
        df = df.withColumn(c, parsed)
    return df


def coerce_rating(df: DataFrame, column: str = "acf_rating", out: str = "rating") -> DataFrame:
    return df.withColumn(out, numbers.finite(F.trim(F.col(column).cast("string")).try_cast("double")))


def standardize_reviews(df: DataFrame) -> DataFrame:
    """Add the standard review columns to a raw export: entity id and name, raw text, rating, date."""
    require_columns(df, REQUIRED)
    df = coerce_dates(df, ["Date", "Post Modified Date"])
    date = F.col("Date") if "Date" in df.columns else F.lit(None).cast("timestamp_ntz")
    if "Post Modified Date" in df.columns:
        date = F.coalesce(date, F.col("Post Modified Date"))
    return coerce_rating(
        df.withColumns({
            "entity_id": text.collapse_edges(F.coalesce("notification_page", "notification_name")),
            "entity_name": text.collapse_edges("notification_name"),
            "review_text_raw": F.coalesce(F.col("Content"), F.lit("")),
            "review_date": date,
        }))


def with_entity_type(df: DataFrame, id_column: str = "entity_id", marker: str = fv.FIRM_MARKER) -> DataFrame:
    return df.withColumn(
        "entity_type", F.when(F.col(id_column).contains(marker), F.lit("firm")).otherwise(F.lit("advisor")))


def rename_project(df: DataFrame, renames: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Rename, then keep the wanted columns that exist, in the wanted order."""
    df = df.withColumnsRenamed(dict(renames))
    return df.select([c for c in keep if c in df.columns])


def token_count_fallback(df: DataFrame) -> DataFrame:
    if "clean_token_count" in df.columns and "token_count" not in df.columns:
        return df.withColumn("token_count", F.col("clean_token_count"))
    return df


def length_features(df: DataFrame, raw: str = "review_text_raw", clean: str = "review_text_clean") -> DataFrame:
    return df.withColumns({
        "raw_len": F.length(raw), "clean_len": F.length(clean), "word_len": text.word_count(clean),
        "token_count": text.word_count(raw), "clean_token_count": text.word_count(clean),
    })


def with_review_year(df: DataFrame, column: str = "review_date") -> DataFrame:
    return df.withColumn("review_year", F.year(column))


def sanitize_nulls(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become NULL."""
    floating = (T.DoubleType, T.FloatType)
    return df.select([numbers.finite(f.name).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
                      for f in df.schema.fields])


def vector_dim_check(df: DataFrame, column: str = "embedding") -> DataFrame:
    """How many vectors there are of each length."""
    return df.groupBy(F.size(column).alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "method",
                 value: str = "score") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def with_firm(reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach the firm of each entity from the distinct (entity, firm) pairs of the score table."""
    return reviews.join(scores.select("entity_id", "firm_id").distinct(), "entity_id", "left")

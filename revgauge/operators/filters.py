"""Row filters and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import text
from revgauge.functions.binding import settled
from revgauge.operators import corpus


def exclude_entities(df: DataFrame, excluded: DataFrame | Sequence[str], column: str = "entity_id") -> DataFrame:
    """Drop rows of listed entities (test accounts). The list is a table, or a few literals."""
    if isinstance(excluded, DataFrame):
        listed = excluded.select(F.col(excluded.columns[0]).alias(column))
        return df.join(listed, column, "left_anti")
    return df.where(~F.coalesce(F.col(column).isin(list(excluded)), F.lit(False)))


def exclusion_report(df: DataFrame, excluded: DataFrame | Sequence[str], column: str = "entity_id") -> DataFrame:
    """How many rows the exclusion drops and keeps."""
    kept = exclude_entities(df, excluded, column).agg(F.count(F.lit(1)).alias("n_kept"))
    return df.agg(F.count(F.lit(1)).alias("n_before")).select(
        "n_before", kept.scalar().alias("n_kept")).withColumn("n_dropped", F.col("n_before") - F.col("n_kept"))


def min_text_length(df: DataFrame, column: str = "review_text_clean", above: int = fv.MIN_TEXT_LENGTH) -> DataFrame:
    return df.where(F.length(column) > above)


def date_floor(df: DataFrame, column: str = "review_date", after_year: int = fv.DATE_FLOOR_YEAR) -> DataFrame:
    """Keep years after ``after_year``; written as a range so that it reaches the scan. NULL dates drop."""
    first = F.lit(f"{after_year + 1}-01-01 00:00:00").cast("timestamp_ntz")
    return df.where(F.col(column) >= first)


def embeddable_rows(df: DataFrame, column: str = "review_text_clean", min_tokens: int = fv.MIN_TOKENS_TO_ENCODE,
                    count: str | None = None):
    """Rows with enough words to encode (NULL and blank texts have none); ``count`` names a column to keep their number."""
    if count:
        return settled(df, count, text.word_count(column)).where(F.col(count) >= min_tokens)
    return df.where(text.word_count(column) >= min_tokens)


def eda_filter(df: DataFrame, *, scope: str | None = None, firm_id=None, entity_id=None, date_start: str | None = None,
               date_end: str | None = None, rating: float | None = None, min_tokens: int | None = None,
               max_tokens: int | None = None, min_reviews: int | None = None,
               max_reviews: int | None = None) -> DataFrame:
    """All given conditions together. The reviews-per-entity bounds count the rows that passed the others."""
    given = lambda x: x is not None and x != ""
    if given(entity_id):
        df = df.where(F.col("entity_id") == F.lit(entity_id))
    elif scope == "firm" and given(firm_id) and "firm_id" in df.columns:
        df = df.where(F.col("firm_id") == F.lit(firm_id))
    if date_start:
        df = df.where(F.col("review_date") >= F.lit(date_start).try_cast("timestamp_ntz"))
    if date_end:
        df = df.where(F.col("review_date") <= F.lit(date_end).try_cast("timestamp_ntz"))
    if rating is not None:
        df = df.where(F.col("rating") == F.lit(float(rating)))
    if min_tokens is not None:
        df = df.where(F.col("token_count") >= min_tokens)
    if max_tokens is not None:
        df = df.where(F.col("token_count") <= max_tokens)
    if min_reviews is not None or max_reviews is not None:
        n = F.col("n_reviews")
        fits = corpus.reviews_per_entity(df).where(
            (n >= (0 if min_reviews is None else min_reviews))
            & (F.lit(True) if max_reviews is None else n <= max_reviews))
        df = df.join(fits, "entity_id", "left_semi")
    return df


def premier_pool(entities: DataFrame, min_reviews: int = fv.PREMIER_REVIEWS) -> DataFrame:
    return entities.where(F.col("review_count") >= min_reviews)


def premier_pool_keep_self(entities: DataFrame, entity_id, min_reviews: int = fv.PREMIER_REVIEWS) -> DataFrame:
    """Peers of the entity's type with enough reviews, and the entity itself."""
    target = F.lit(entity_id)
    own_type = entities.where(F.col("entity_id") == target).agg(F.max("entity_type")).scalar()
    return entities.where((F.col("entity_type") == own_type)
                          & ((F.col("review_count") >= min_reviews) | (F.col("entity_id") == target)))


def reviews_of(reviews: DataFrame, entities: DataFrame) -> DataFrame:
    """Reviews of the entities in the given table."""
    return reviews.join(entities.select("entity_id"), "entity_id", "left_semi")


def quartile_ranges(bounds: DataFrame) -> DataFrame:
    """Low, medium and high ranges from one row of ``low, q1, q3, high`` (whole numbers)."""
    def span(name, low, high):
        return F.struct(F.lit(name).alias("category"), low.alias("range_min"), high.alias("range_max"))

    c = F.col
    return bounds.select(F.inline(F.array(span("low", c("low"), c("q1")), span("medium", c("q1") + 1, c("q3")),
                                          span("high", c("q3") + 1, c("high")))))


def whole_quartiles(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles cut to whole numbers, and maximum of a whole-number column."""
    cuts = F.percentile(column, F.lit([0.25, 0.75]))
    return df.agg(F.min(column).cast("bigint").alias("low"), F.get(cuts, F.lit(0)).cast("bigint").alias("q1"),
                  F.get(cuts, F.lit(1)).cast("bigint").alias("q3"), F.max(column).cast("bigint").alias("high"))


def quartile_category_filter(df: DataFrame, column: str, categories: Iterable[str], base: DataFrame | None = None):
    """Keep rows from the lowest to the highest bound of the picked categories; quartiles come from ``base``. No
    known category picked keeps the whole range."""
    picked = [c for c in categories if c in ("low", "medium", "high")] or ["low", "medium", "high"]
    ranges = quartile_ranges(whole_quartiles(df if base is None else base, column)).where(
        F.col("category").isin(picked))
    span = ranges.agg(F.struct(F.min("range_min").alias("lo"), F.max("range_max").alias("hi")).alias("span")).scalar()
    return df.withColumn("_span", span).where(
        F.col(column).between(F.col("_span.lo"), F.col("_span.hi"))).drop("_span")


def min_total_tokens(df: DataFrame, tokens: str = "token_count", at_least: int = fv.MIN_TOTAL_TOKENS) -> DataFrame:
    """Reviews of entities that have enough tokens in total."""
    totals = df.groupBy("entity_id").agg(F.sum(tokens).alias("_total")).where(F.col("_total") >= at_least)
    return reviews_of(df, totals)


def suspect_phrase_rate(df: DataFrame, column: str = "review_text_clean", phrases=fv.SUSPECT_PHRASES) -> DataFrame:
    hit = F.coalesce(text.any_phrase(column, phrases), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(hit).alias("n_suspect"),
                  F.avg(hit.cast("int")).alias("share"))


def name_mention_rate(df: DataFrame, column: str = "review_text_clean", name: str = "entity_name") -> DataFrame:
    """Share of reviews that contain the part of the name before its first comma."""
    head = F.lower(F.substring_index(name, ",", 1))
    hit = F.coalesce(F.contains(F.lower(column), head), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(hit).alias("n_mentions"),
                  F.avg(hit.cast("int")).alias("share"))


def review_lookup(df: DataFrame, review_id) -> DataFrame:
    """One review as a typed record, found by the text of its id."""
    wanted = {"Title": "title", "Content": "content", "review_date": "review_date", "rating": "rating",
              "token_count": "token_count", "entity_name": "entity_name", "reviewer_name": "reviewer_name",
              "notification_page": "review_url"}
    casts = {"rating": "double", "token_count": "bigint"}
    cols = [F.col(c).cast(casts[c]).alias(a) if c in casts else F.col(c).alias(a)
            for c, a in wanted.items() if c in df.columns]
    found = df.where(F.col("review_id").cast("string") == F.lit(str(review_id)))
    one = found.select(F.col("review_id").cast("string").alias("review_id"), *cols)
    return one.orderBy(*one.columns).limit(1)   # of copies of an id the first in order of its columns


def scored_review_lookup(scored: DataFrame, review_id, dims: Sequence[str]) -> DataFrame:
    keep = ["review_id", "entity_id", "entity_name", "entity_type", "review_text_raw", "reviewer_name", "review_date"]
    cols = [c for c in keep + [f"sim_{d}" for d in dims] if c in scored.columns]
    return scored.where(F.col("review_id") == F.lit(review_id)).select(cols).orderBy(*cols).limit(1)


def entity_reviews(scored: DataFrame, entity_id, dims: Sequence[str]) -> DataFrame:
    keep = ["review_id", "entity_id", "entity_name", "entity_type", "review_text_raw", "reviewer_name", "review_date"]
    cols = [c for c in keep + [f"sim_{d}" for d in dims] if c in scored.columns]
    return scored.where(F.col("entity_id") == F.lit(entity_id)).select(cols)

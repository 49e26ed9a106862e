"""The query surface: one method per question a user can ask, with checked parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.session import via_table
from revgauge.operators import (benchmark, compare, corpus, filters, firms, intake, lexical, ranking, sampling,
                                scoring)


def _within(name, value, low=None, high=None):
    if value is None:
        return
    if (low is not None and value < low) or (high is not None and value > high):
        raise ValueError(f"{name} must be between {low} and {high}")


def _one_of(name, value, allowed):
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")


def eda_blocks(reviews: DataFrame, *, lexical_n: int = 1, lexical_top_n: int = 20, exclude_stopwords: bool = False,
               custom_stopwords: Sequence[str] | None = None, time_freq: str = "month",
               meta_from: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report blocks over the same filtered reviews. Each block is lazy and reads only its own columns."""
    return {
        "summary": corpus.eda_summary(reviews),
        "quality": corpus.quality_summary(reviews, "reviewer_name", "review_text_clean", blank_is_empty=False),
        "coverage": corpus.coverage(reviews),
        "rating_distribution": corpus.rating_distribution(reviews),
        "reviews_over_time": corpus.reviews_over_time(reviews, time_freq),
        "reviews_per_entity": corpus.reviews_per_entity(reviews),
        "token_counts": corpus.token_counts(reviews),
        "rating_vs_tokens": corpus.rating_vs_tokens(reviews),
        "lexical": lexical.lexical_top_ngrams(reviews, n=lexical_n, top_n=lexical_top_n,
                                              exclude_stopwords=exclude_stopwords, custom_stopwords=custom_stopwords),
        "meta": corpus.eda_meta(reviews if meta_from is None else meta_from),
    }


class ReviewQueries:
    """Questions over stored tables.

    ``tables`` may hold ``reviews``, ``review_scores``, ``entity_scores``, ``partner_groups``, ``firm_scores``,
    ``firm_benchmarks``, ``firm_themes`` and ``manifest``. A question about an absent table raises ``LookupError``.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark, self.tables = spark, dict(tables)
        if "reviews" in self.tables:
            reviews = intake.token_count_fallback(self.tables["reviews"])
            if "firm_scores" in self.tables and "firm_id" not in reviews.columns:
                reviews = intake.with_firm(reviews, self.tables["firm_scores"])
            self.tables["reviews"] = reviews

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"{name} data not available")
        return self.tables[name]

    def _dims(self) -> list[str]:
        return scoring.dims_of(self._table("review_scores"), "sim_")

    # metadata and firms

    def metadata(self) -> DataFrame:
        return self._table("manifest")

    def stopwords(self) -> DataFrame:
        return lexical.report_stopwords(self.spark)

    def firms(self) -> DataFrame:
        return firms.firm_list(self._table("firm_scores"))

    def firm_summary(self, firm_id) -> DataFrame:
        return firms.firm_summary(self._table("firm_scores"), firm_id)

    def firm_dimensions(self, firm_id) -> DataFrame:
        return firms.firm_dimensions(self._table("firm_scores"), firm_id)

    def firm_entities(self, firm_id) -> DataFrame:
        return firms.firm_entities(self._table("firm_scores"), firm_id)

    def firm_entity(self, firm_id, entity_id) -> dict[str, DataFrame]:
        out = {"scores": firms.firm_entity_scores(self._table("firm_scores"), firm_id, entity_id)}
        if "firm_themes" in self.tables:
            out["themes"] = firms.firm_entity_themes(self._table("firm_scores"), self._table("firm_themes"), firm_id,
                                                     entity_id)
        return out

    def firm_benchmarks(self, firm_id) -> DataFrame:
        return self._table("firm_benchmarks")

    def firm_personas(self, firm_id) -> DataFrame:
        return firms.firm_personas(self._table("firm_scores"), firm_id)

    # reviews

    def eda_charts(self, *, scope: str = "global", firm_id=None, entity_id=None, date_start=None, date_end=None,
                   rating=None, min_tokens=None, max_tokens=None, min_reviews=None, max_reviews=None, lexical_n: int = 1,
                   lexical_top_n: int = 20, exclude_stopwords: bool = False, custom_stopwords=None,
                   time_freq: str = "month", token_categories: Sequence[str] = (),
                   review_categories: Sequence[str] = (), preset: str | None = None) -> dict[str, DataFrame]:
        """Every report block under one filter. ``meta`` describes the scope, not the filtered rows. Categories
        (low, medium, high) are quartile ranges of the scope.

        ``preset="eda"`` is the report of all reviews, whatever the other arguments: the stored tables
        ``eda_summary``, ``quality_summary``, ``coverage`` and ``top_tokens`` stand in for the blocks of that kind.
        """
        if preset == "eda":
            blocks = eda_blocks(self._table("reviews"))
            stored = {"summary": "eda_summary", "quality": "quality_summary", "coverage": "coverage", "lexical": "top_tokens"}
            return {**blocks, **{b: self.tables[t] for b, t in stored.items() if t in self.tables}}
        _one_of("scope", scope, ("global", "firm"))
        if scope == "firm" and firm_id is None and entity_id is None:
            raise ValueError("firm_id or entity_id is required when scope is 'firm'")
        _one_of("time_freq", time_freq, ("month", "quarter", "year"))
        _within("rating", rating, 0, 5)
        for name, v in (("min_tokens", min_tokens), ("max_tokens", max_tokens), ("min_reviews", min_reviews),
                        ("max_reviews", max_reviews)):
            _within(name, v, 0)
        _within("lexical_n", lexical_n, 1, 5)
        _within("lexical_top_n", lexical_top_n, 1, 500)
        reviews = self._table("reviews")
        base = filters.eda_filter(reviews, scope=scope, firm_id=firm_id, entity_id=entity_id)
        rows = filters.eda_filter(reviews, scope=scope, firm_id=firm_id, entity_id=entity_id, date_start=date_start,
                                  date_end=date_end, rating=rating, min_tokens=min_tokens, max_tokens=max_tokens)
        if token_categories and "all" not in token_categories:
            rows = filters.quartile_category_filter(rows, "token_count", token_categories, base)
        rows = filters.eda_filter(rows, min_reviews=min_reviews, max_reviews=max_reviews)
        if review_categories and "all" not in review_categories:
            counts = corpus.reviews_per_entity(rows)
            fits = filters.quartile_category_filter(counts, "n_reviews", review_categories,
                                                    corpus.reviews_per_entity(base))
            rows = filters.reviews_of(rows, fits)
        # ten blocks over the same rows: filter once, keep what the blocks read
        rows = via_table(rows, "eda-rows")
        return eda_blocks(rows, lexical_n=lexical_n, lexical_top_n=lexical_top_n, exclude_stopwords=exclude_stopwords,
                          custom_stopwords=custom_stopwords, time_freq=time_freq, meta_from=base)

    def review(self, review_id) -> DataFrame:
        return filters.review_lookup(self._table("reviews"), review_id)

    # review and entity scores

    def macro_sample(self, n: int = 100, seed: int = 42) -> DataFrame:
        return sampling.sample_reviews(self._table("review_scores"), n, seed)

    def macro_totals(self, min_reviews: int = 0) -> DataFrame:
        _within("min_reviews", min_reviews, 0)
        return scoring.macro_totals(self._table("review_scores"), self._dims(), self.tables.get("entity_scores"),
                                    min_reviews)

    def entities(self) -> DataFrame:
        return benchmark.entity_list(self._table("entity_scores"))

    def entity_reviews(self, entity_id) -> DataFrame:
        return filters.entity_reviews(self._table("review_scores"), entity_id, self._dims())

    def entity_profile(self, entity_id, method: str = "mean") -> DataFrame:
        _one_of("method", method, fv.METHODS)
        return ranking.entity_profile(self._table("entity_scores"), entity_id, method)

    def percentile_scores(self, entity_id, method: str = "mean", min_reviews: int = 0) -> DataFrame:
        _one_of("method", method, fv.METHODS)
        _within("min_reviews", min_reviews, 0)
        return ranking.premier_percentiles(self._table("entity_scores"), method, min_reviews).where(
            F.col("entity_id") == F.lit(entity_id))

    def population_medians(self, method: str = "mean", entity_type: str = "firm") -> DataFrame:
        _one_of("method", method, fv.METHODS)
        return benchmark.population_medians(self._table("entity_scores"), method, entity_type)

    def method_breakpoints(self, method: str = "mean", entity_type: str = "firm") -> DataFrame:
        _one_of("method", method, fv.METHODS)
        return benchmark.method_breakpoints(self._table("entity_scores"), method, entity_type)

    def scored_review(self, review_id) -> DataFrame:
        return filters.scored_review_lookup(self._table("review_scores"), review_id, self._dims())

    # benchmarks, leaderboard, comparisons

    def pool_stats(self, min_reviews: int = fv.PREMIER_REVIEWS) -> dict[str, DataFrame]:
        _within("min_reviews", min_reviews, 1)
        entities = self._table("entity_scores")
        return {"totals": benchmark.pool_totals(entities, min_reviews),
                "dimensions": benchmark.pool_dim_stats(entities, min_reviews)}

    def distributions(self, method: str = "mean", entity_type: str = "all", min_reviews: int = 0) -> DataFrame:
        _one_of("method", method, fv.METHODS)
        _one_of("entity_type", entity_type, ("all", "firm", "advisor"))
        _within("min_reviews", min_reviews, 0)
        return benchmark.score_distributions(self._table("entity_scores"), method, entity_type, min_reviews)

    def leaderboard(self, method: str = "mean", entity_type: str = "all", min_reviews: int = 0, top_n: int = 10,
                    dimension: str = "all") -> DataFrame:
        _one_of("method", method, fv.METHODS)
        _one_of("entity_type", entity_type, ("all", "firm", "advisor"))
        _within("min_reviews", min_reviews, 0)
        _within("top_n", top_n, 1, 50)
        return ranking.leaderboard(self._table("entity_scores"), method, entity_type, min_reviews, top_n, dimension)

    def partner_groups(self) -> DataFrame:
        return compare.partner_group_list(self._table("partner_groups"))

    def partner_group(self, code, method: str = "mean") -> DataFrame:
        _one_of("method", method, fv.METHODS)
        return compare.group_profiles(self._table("partner_groups"), self._table("entity_scores"), code, method)

    def comparison(self, entity_ids: Sequence, method: str = "mean") -> DataFrame:
        _one_of("method", method, fv.METHODS)
        return compare.entity_comparison(self._table("entity_scores"), entity_ids, method)

    def head_to_head(self, entity_a, entity_b, method: str = "mean") -> DataFrame:
        _one_of("method", method, fv.METHODS)
        return compare.head_to_head(self._table("entity_scores"), entity_a, entity_b, method)

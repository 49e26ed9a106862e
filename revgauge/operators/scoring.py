"""Dimension scores: dot products of vectors with a few query vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import vectors
from revgauge.session import small_rows

#: Query vectors go to every task.
MAX_QUERIES = 10_000


class QueryVectors:
    """Named query vectors, read once: settings, six in normal use. They become columns of the result, and one matrix
    product per batch of rows takes them all."""

    def __init__(self, names: Sequence[str], matrix: np.ndarray):
        self.names, self.matrix = list(names), np.asarray(matrix, dtype="float64")

    @classmethod
    def from_table(cls, table: DataFrame, name: str = "dim", vector: str = "query_vec",
                   order: Sequence[str] | None = None) -> QueryVectors:
        found = {r[0]: r[1] for r in small_rows(table.select(name, vector), MAX_QUERIES, "query vectors")}
        names = list(order) if order else sorted(found)
        return cls(names, np.array([found[n] for n in names]))

    def scores(self, vector) -> Column:
        return vectors.dots_with(vector, self.matrix)


def with_dots(df: DataFrame, queries: QueryVectors, columns: dict[str, str]) -> DataFrame:
    """Add ``{prefix}_{dim}`` for each vector column; ``columns`` maps vector column to prefix."""
    df = df.withColumns({f"_dots_{p}": queries.scores(v) for v, p in columns.items()})
    df = df.withColumns({f"{p}_{name}": F.get(f"_dots_{p}", F.lit(i))
                         for p in columns.values() for i, name in enumerate(queries.names)})
    return df.drop(*[f"_dots_{p}" for p in columns.values()])


def review_scores(reviews: DataFrame, queries: QueryVectors, vector: str = "embedding",
                  keep: Sequence[str] = ("review_id", "entity_id", "entity_name", "entity_type", "review_text_raw",
                                         "reviewer_name", "review_date")) -> DataFrame:
    """One ``sim_{dim}`` per query for every review; no shuffle."""
    kept = [c for c in keep if c in reviews.columns]
    return with_dots(reviews.select(*kept, vector), queries, {vector: "sim"}).drop(vector)


def merge_methods(means: DataFrame, weighted: DataFrame) -> DataFrame:
    """Entities that have both kinds of vectors."""
    extra = [c for c in weighted.columns if c == "entity_id" or c not in means.columns]
    return means.join(weighted.select(extra), "entity_id")


def attach_review_count(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    counts = reviews.groupBy("entity_id").agg(F.count(F.lit(1)).alias("review_count"))
    return (entities.drop("review_count").join(counts, "entity_id", "left")
            .withColumn("review_count", F.coalesce("review_count", F.lit(0))))


def attach_review_meta(scored: DataFrame, reviews: DataFrame, key: str = "review_hash") -> DataFrame:
    """Reviewer and date of scored reviews, matched by identity. ``reviews`` may hold copies of a review."""
    from revgauge.operators.dedup import keep_first

    meta = keep_first(reviews.select(key, "review_id", "reviewer_name", "review_date"), key).drop("review_id")
    return scored.join(meta, key, "left")


def entity_scores(means: DataFrame, weighted: DataFrame, queries: QueryVectors, types: DataFrame | None = None):
    """One row per entity with ``sim_{method}_{dim}``. ``types`` (entity_id, entity_type) is joined if given."""
    merged = merge_methods(means, weighted)
    scored = with_dots(merged, queries, {f"vector_{m}": f"sim_{m}" for m in fv.METHODS})
    scored = scored.withColumn("review_count", F.col("n_reviews"))
    if types is not None:
        scored = scored.join(types, "entity_id", "left")
    sims = [f"sim_{m}_{d}" for m in fv.METHODS for d in queries.names]
    return scored.select("entity_id", "entity_name", "entity_type", "review_count", *sims)


def dims_of(scored: DataFrame, prefix: str = "sim_mean_") -> list[str]:
    return [c[len(prefix):] for c in scored.columns if c.startswith(prefix)]


def long_scores(entities: DataFrame, methods: Sequence[str] = fv.METHODS, composite: str | None = None,
                dims: Sequence[str] | None = None) -> DataFrame:
    """(entity, method, dim, score) rows from the wide table, in the same task.

    ``composite`` adds a row with the mean over the dimensions: ``"strict"`` is NULL if one is missing,
    ``"present"`` averages those there are.
    """
    dims = list(dims or dims_of(entities))
    # one SQL expression: hundreds of separate Column calls would take longer to build than the query to run
    cells = []
    for m in methods:
        sims = [f"CAST(`sim_{m}_{d}` AS DOUBLE)" for d in dims]
        named = list(zip(dims, sims)) + ([("composite", _composite_sql(sims, composite))] if composite else [])
        cells += [f"named_struct('method', '{m}', 'dim', '{d}', 'score', {s})" for d, s in named]
    return entities.selectExpr("entity_id", "entity_name", "entity_type", "review_count",
                               f"inline(array({', '.join(cells)}))")


def _composite_sql(sims: Sequence[str], kind: str) -> str:
    if kind == "strict":
        return f"({' + '.join(sims)}) / {float(len(sims))}D"
    total = " + ".join(f"coalesce({s}, 0D)" for s in sims)
    present = " + ".join(f"int({s} IS NOT NULL)" for s in sims)
    return f"try_divide({total}, {present})"


def macro_totals(scored: DataFrame, dims: Sequence[str], entities: DataFrame | None = None,
                 min_reviews: int = 0) -> DataFrame:
    """Sum of each dimension over all reviews, or over reviews of entities with enough of them; one row."""
    if min_reviews > 0 and entities is not None:
        pool = entities.where(F.col("review_count") >= min_reviews).select("entity_id")
        scored = scored.join(pool, "entity_id", "left_semi")
    return scored.agg(*[F.sum(f"sim_{d}").alias(f"total_{d}") for d in dims],
                      F.count(F.lit(1)).alias("review_count"))


def dimension_rank(totals: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Dimensions ranked by corpus total (one row in, one row per dimension out)."""
    from pyspark.sql import Window

    cells = [F.struct(F.lit(d).alias("dim"), F.col(f"total_{d}").alias("total")) for d in dims]
    rows = totals.select(F.inline(F.array(*cells)))
    # one row per dimension: a single partition is enough
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "dim")))

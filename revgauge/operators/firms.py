"""Reports over firm score tables: firm_id, entity_id, dimension, score, confidence, review_count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.functions import numbers


def _firm(scores: DataFrame, firm_id) -> DataFrame:
    return scores.where(F.col("firm_id") == F.lit(firm_id))


def firm_list(scores: DataFrame) -> DataFrame:
    return scores.select("firm_id").distinct().orderBy("firm_id")


def firm_summaries(scores: DataFrame) -> DataFrame:
    """Distinct entities and dimensions, mean score and confidence (two decimals) of every firm."""
    return scores.groupBy("firm_id").agg(
        F.countDistinct("entity_id").alias("entity_count"), F.countDistinct("dimension").alias("dimension_count"),
        F.bround(F.avg("score"), 2).alias("avg_score"), F.bround(F.avg("confidence"), 2).alias("avg_confidence"))


def firm_summary(scores: DataFrame, firm_id) -> DataFrame:
    return firm_summaries(_firm(scores, firm_id))


def _means() -> list:
    return [F.avg(c).alias(c) for c in ("score", "confidence", "review_count")]


def firm_dimensions(scores: DataFrame, firm_id) -> DataFrame:
    return _firm(scores, firm_id).groupBy("dimension").agg(*_means()).orderBy(F.desc("score"), "dimension")


def firm_entities(scores: DataFrame, firm_id) -> DataFrame:
    return _firm(scores, firm_id).groupBy("entity_id").agg(*_means())


def firm_personas(scores: DataFrame, firm_id) -> DataFrame:
    return (_firm(scores, firm_id).groupBy("entity_id").agg(F.avg("score").alias("score"))
            .withColumn("persona", numbers.persona("score")))


def firm_entity_scores(scores: DataFrame, firm_id, entity_id) -> DataFrame:
    return _firm(scores, firm_id).where(F.col("entity_id") == F.lit(entity_id))


def firm_entity_themes(scores: DataFrame, themes: DataFrame, firm_id, entity_id) -> DataFrame:
    """Themes of an entity, if the firm has it."""
    known = firm_entity_scores(scores, firm_id, entity_id).select("entity_id")
    return themes.where(F.col("entity_id") == F.lit(entity_id)).join(known, "entity_id", "left_semi")

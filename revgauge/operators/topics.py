"""Topic clusters of reviews and sentences."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgauge.functions import text, vectors
from revgauge.operators import kmeans
from revgauge.session import small_rows

MAX_CLUSTERS = 10_000


def kmeans_topics(df: DataFrame, k: int = 20, vector: str = "embedding", seed: int = 42, max_iter: int = 20,
                  id_column: str = "review_id") -> DataFrame:
    """Rows with their cluster number; 0 is the largest cluster. Equal rows give equal numbers, however they are split.

    Rows whose vector is missing or not finite are left out; fewer different vectors than ``k`` give fewer clusters.
    """
    return kmeans.assign(df, kmeans.fit(df, k, vector, id_column, seed, max_iter), vector)


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def centroids(df: DataFrame, cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    return df.groupBy(cluster).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("centroid"))


def cluster_representatives(df: DataFrame, cluster: str = "cluster", vector: str = "embedding",
                            id_column: str = "review_id", top_n: int = 5) -> DataFrame:
    """Members nearest to their cluster's mean by cosine.

    Centroids are as many as clusters, a setting; their number is checked and they go to every task. One matrix
    product per batch takes all of them, a row keeps its own cluster's column, and each task forwards its best only:
    no vector is shuffled. Rows without a cluster, and zero vectors, stand for nothing.
    """
    rows = small_rows(centroids(df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()), cluster, vector), MAX_CLUSTERS, "clusters")
    best = Window.partitionBy(cluster).orderBy(F.desc("similarity"), id_column)
    slim = df.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull()).select(cluster, id_column, vector)
    if not rows:
        return slim.select(cluster, id_column, F.lit(0.0).alias("similarity"), F.lit(1).alias("rank")).where("false")
    m = np.array([r.centroid for r in rows], dtype="float64")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    units = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rows) for x in (r[cluster], i)])
    own = F.get(vectors.dots_with(vector, units), place[F.col(cluster)])
    scored = slim.select(cluster, id_column, F.try_divide(own, vectors.l2_norm(vector)).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)


def explode_sentences(df: DataFrame, column: str = "review_text_clean", id_column: str = "review_id",
                      min_length: int = 40) -> DataFrame:
    """One row per sentence of at least ``min_length`` characters, numbered from 0 in its review."""
    rows = df.select(id_column, F.posexplode(text.sentences(column)).alias("sentence_no", "sentence"))
    return (rows.withColumn("sentence", text.collapse_edges("sentence"))
            .where(F.length("sentence") >= min_length))


def relationship_sentences(sentences: DataFrame, column: str = "sentence") -> DataFrame:
    return sentences.where(text.keyword_sentence(column))

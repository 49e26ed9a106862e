"""Nearest vectors by cosine to a given set of query items.

For a few ids each task keeps a running best list per query while it streams its batches, so what reaches the final ranking is
``k`` rows per query and task, whatever the table's size; pairs are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revgauge.functions.vectors import matrix_of
from revgauge.operators.neighbors import nearest_join, unit_rows
from revgauge.session import small_rows

BLOCK = 256


def nearest(df: DataFrame, query_ids: Sequence | DataFrame, k: int, id_column: str = "review_id", vector: str = "embedding",
            other_entity: bool = False) -> DataFrame:
    """The ``k`` nearest rows to each query row, itself excluded; equal cosines are ordered by id.

    ``other_entity`` also excludes rows of the query row's entity. A few ids are answered in one scan, and one without a
    vector is an error. A table of ids, or a list of more than ``BLOCK``, is joined (see ``neighbors``).
    """
    if isinstance(query_ids, DataFrame):
        return nearest_join(df, query_ids, k, id_column, vector, other_entity)[0]
    ids = list(dict.fromkeys(query_ids))
    if not ids:
        raise ValueError("no query ids given")
    if len(ids) > BLOCK:
        asked = df.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(id_column, df.schema[id_column].dataType)]))
        known = df.where(F.col(vector).isNotNull()).select(id_column).distinct()
        if missing := [r[0] for r in asked.join(known, id_column, "left_anti").limit(10).collect()]:
            raise ValueError(f"no vector for query ids: {missing}")
        return nearest_join(df, asked, k, id_column, vector, other_entity)[0]
    id_type = df.schema[id_column].dataType
    group = "entity_id" if other_entity else id_column
    slim = df.where(F.col(vector).isNotNull()).select(
        F.col(id_column).alias("item"), F.col(group).alias("owner"), F.col(vector).alias("v"))
    found = {r.item: r for r in small_rows(slim.where(F.col("item").isin(ids)), BLOCK, "query rows")}
    if missing := [i for i in ids if i not in found]:
        raise ValueError(f"no vector for {len(missing)} query ids: {missing[:10]}")
    q_owner = [found[i].owner for i in ids]
    q_mat = unit_rows(np.array([found[i].v for i in ids], dtype="float64"))
    width = q_mat.shape[1]

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table | None] = [None] * len(ids)
        for b in batches:
            units = unit_rows(matrix_of(b.column("v"), width))
            items, owners = b.column("item"), b.column("owner")
            sims = units @ q_mat.T
            for j, owner in enumerate(q_owner):
                # a row without an owner belongs to nobody: it may be near anything but itself
                allowed = pc.not_equal(items, pa.scalar(ids[j], items.type))
                if owner is not None:
                    allowed = pc.and_(allowed, pc.fill_null(pc.not_equal(owners, pa.scalar(owner, owners.type)), True))
                t = pa.table({"item": items, "sim": pa.array(sims[:, j])}).filter(allowed)
                if best[j] is not None:
                    t = pa.concat_tables([best[j], t])
                if t.num_rows > k:
                    t = t.take(pc.select_k_unstable(t, k, [("sim", "descending"), ("item", "ascending")]))
                best[j] = t
        for j, t in enumerate(best):
            if t is not None and t.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[j]] * t.num_rows, t.column("item").type), t.column("item").combine_chunks(),
                     t.column("sim").combine_chunks()], names=["query_id", "item_id", "similarity"])

    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("item_id", id_type),
                           T.StructField("similarity", T.DoubleType())])
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return (slim.mapInArrow(best_of_task, schema)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def similar_reviews(reviews: DataFrame, query_ids: Sequence | DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    return nearest(reviews, query_ids, k, "review_id", vector)


def similar_reviews_other_entity(reviews: DataFrame, query_ids: Sequence | DataFrame, k: int = 5,
                                 vector: str = "embedding") -> DataFrame:
    return nearest(reviews, query_ids, k, "review_id", vector, other_entity=True)


def similar_entities(entities: DataFrame, query_ids: Sequence | DataFrame, k: int = 5, vector: str = "vector_mean") -> DataFrame:
    return nearest(entities, query_ids, k, "entity_id", vector)

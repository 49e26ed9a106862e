"""k-means whose result depends on the rows alone: not on their order, partitions or the number of tasks.

Seeds are drawn in rounds by exponential keys of a hash (k-means||), a heaviest-first rule leaves k of them, and Lloyd
steps follow. Sums are taken over whole numbers, so that it does not matter in which order tasks add them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revgauge.functions.vectors import matrix_of
from revgauge.session import small_rows, via_table

#: Distances held at once, in numbers; rows are taken in blocks of so many.
BLOCK = 1 << 22
#: Tasks whose partial sums go to the driver; more are merged by so many tasks first.
MERGE = 64
#: A row this near to a centre, in parts of its own squared length, is that centre.
SAME = 1e-9


def finite(vector: str) -> Column:
    """Whether a vector is there, has numbers, and all are finite."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the lowest of several) and the squared distance to it, for each row."""
    own = (centres * centres).sum(axis=1)
    place, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, BLOCK // len(centres))
    for a in range(0, len(x), step):
        part = x[a:a + step]
        d = own - 2 * (part @ centres.T)
        place[a:a + step] = at = d.argmin(axis=1)
        far[a:a + step] = np.maximum(0, d[np.arange(len(part)), at] + (part * part).sum(axis=1))
    return place, far


def _keys(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, id, vector): the key of an exponential race in which a row's rate is its squared distance."""
    for batch in batches:
        x = matrix_of(batch.column(2), centres.shape[1])
        _, far = nearest(x, centres)
        open_ = far > SAME * (x * x).sum(axis=1)
        key = -np.log(np.asarray(batch.column(0))[open_]) / far[open_]
        yield pa.record_batch([pa.array(key), *(c.filter(pa.array(open_)) for c in batch.columns[1:])], ["key", "id", "vector"])


def _sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(cluster, n, total): the task's rows of each cluster, counted and added as multiples of 2 ** -bits."""
    k, width = centres.shape
    n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for batch in batches:
        x = matrix_of(batch.column(0), width)
        place, _ = nearest(x, centres)
        order = np.argsort(place, kind="stable")
        there, first = np.unique(place[order], return_index=True)
        if len(there):
            total[there] += np.add.reduceat(np.rint(np.ldexp(x[order], bits)).astype(np.int64), first, axis=0)
            n += np.bincount(place, minlength=k)
    yield _table(n, total)


def _merge(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for batch in batches:
        at = np.asarray(batch.column(0))
        np.add.at(n, at, np.asarray(batch.column(1)))
        np.add.at(total, at, np.asarray(batch.column(2).flatten()).reshape(-1, width))
    yield _table(n, total)


def _table(n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[at].ravel()))
    return pa.record_batch([pa.array(at), pa.array(n[at]), lists], ["cluster", "n", "total"])


def _totals(points: DataFrame, centres: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    k, width = centres.shape
    schema = "cluster long, n long, total array<long>"
    tasks = points.rdd.getNumPartitions()
    parts = points.select("vector").mapInArrow(partial(_sums, centres=centres, bits=bits), schema)
    if tasks > MERGE:
        parts = parts.repartition(MERGE).mapInArrow(partial(_merge, k=k, width=width), schema)
    n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for r in small_rows(parts, MERGE * k, "partial sums"):
        n[r.cluster] += r.n
        total[r.cluster] += r.total
    return n, total


def _draw(points: DataFrame, seed: int, number: int) -> Column:
    """A number in (0, 1) from the hash of seed, round and id."""
    name = F.concat_ws(":", F.lit(str(seed)), F.lit(str(number)), F.col("id").cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") + 0.5) / 2.0**32


def _seeds(points: DataFrame, k: int, seed: int, rounds: int) -> np.ndarray:
    """The first row of a hash order, then in each round the 2 k winners of a race; rates are squared distances."""
    chosen = points.select(_draw(points, seed, 0).alias("u"), "id", "vector").orderBy("u", "id", "vector").limit(1).collect()
    centres = np.array([r.vector for r in chosen], dtype="float64")
    for number in range(1, rounds + 1):
        raced = points.select(_draw(points, seed, number).alias("u"), "id", "vector").mapInArrow(
            partial(_keys, centres=centres), f"key double, id {dict(points.dtypes)['id']}, vector array<double>")
        winners = raced.orderBy("key", "id", "vector").limit(2 * k).collect()
        if not winners:
            break
        centres = np.concatenate((centres, [r.vector for r in winners]))
    return centres[np.sort(np.unique(centres, axis=0, return_index=True)[1])]


def _reduce(seeds: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the seeds: the one with the most rows, then each time the one with the most rows times squared distance."""
    taken = [int(weight.argmax())]
    while len(taken) < min(k, len(seeds)):
        gain = weight * ((seeds[:, None, :] - seeds[None, taken[-1:], :]) ** 2).sum(axis=2)[:, 0]
        least = gain if len(taken) == 1 else np.minimum(least, gain)  # noqa: F821
        if least.max() <= 0:
            break
        taken.append(int(least.argmax()))
    return seeds[taken]


def fit(df: DataFrame, k: int, vector: str = "embedding", id_column: str = "review_id", seed: int = 42, max_iter: int = 20,
        rounds: int = 5) -> np.ndarray:
    """Centres of at most ``k`` clusters, the largest cluster first (ties: by coordinates).

    The driver holds at most 1 + 2 k * rounds seeds and k sums. Steps end when no centre moves, or after ``max_iter``;
    a centre that loses all its rows stays where it is. Rows without a finite vector take no part; no row: no centre.
    """
    points = via_table(df.where(finite(vector)).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector")),
                       "points")
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("top")).first()
    if not size.n:
        return np.zeros((0, 0))
    # whole-number sums stay below 2 ** 62
    bits = min(40, 62 - int(size.n).bit_length() - max(0, int(np.ceil(np.log2(size.top))) if size.top else 0))
    seeds = _seeds(points, k, seed, rounds)
    centres = _reduce(seeds, _totals(points, seeds, bits)[0], k)
    n = np.zeros(len(centres), np.int64)
    for _ in range(max_iter):
        n, total = _totals(points, centres, bits)
        moved = np.where(n[:, None] > 0, np.ldexp(total / np.maximum(n, 1)[:, None], -bits), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    order = sorted(range(len(centres)), key=lambda c: (-int(n[c]), *centres[c].tolist()))
    return centres[order]


def assign(df: DataFrame, centres: np.ndarray, vector: str = "embedding", out: str = "cluster") -> DataFrame:
    """Rows with a finite vector and the number of their nearest centre; all columns are kept."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def place(vectors: pa.Array) -> pa.Array:
        x = matrix_of(vectors, centres.shape[1])
        return pa.array(nearest(np.nan_to_num(x), centres)[0].astype(np.int32))

    rows = df.where(finite(vector))
    return rows.withColumn(out, place(F.col(vector)) if len(centres) else F.lit(None).cast("int"))

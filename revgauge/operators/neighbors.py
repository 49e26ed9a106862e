"""Exact nearest vectors for a table of query items, with most products pruned.

Angles between vectors obey the triangle inequality: a query at angle a from a pivot has no item within t of it among the
items whose angle from that pivot is below a - t or above a + t. Items are dealt to the cell of their nearest pivot and,
inside, to rings of equal angle; (cell, ring) is a unit. Small units are put together to blocks, so that a query that has
to meet everything is sent to some hundred blocks, not to thousands of units. A query first meets its own block; the k-th
similarity found there is a bound, and then only the blocks with a unit that may hold something better are met. Blocks and
their visitors are cut into tiles of bounded size, so neither a crowded block nor a popular one lands in one task, and no
query vectors are held by every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgauge.functions.vectors import matrix_of
from revgauge.session import small_rows, via_table

#: Pivots are the square root of the number of items, this many at most: they go to every task.
MAX_PIVOTS = 1024
#: Rings per radian.
RINGS = 16
#: Items, and visitors, of a tile.
TILE = 4096
#: Small units are put together up to this share of all items, and up to a tile.
SHARE = 64
#: Rows whose angles or products a task holds at once.
STEP = 512
#: Similarities are compared to this many digits; equal ones are ordered by id.
DIGITS = 9
#: What is added to a bound for rounding: to a similarity, and to an angle.
SLACK, TURN = 1e-8, 1e-6


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class Pivots(NamedTuple):
    units: np.ndarray
    ids: list
    owners: list

    @property
    def width(self) -> int:
        return self.units.shape[1]

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.units.T, -1.0, 1.0))


def _place(pivots: Pivots, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell and ring of each row, and its angles; vectors of zero are cell -1."""
    angles = pivots.angles(units)
    cell = angles.argmin(axis=1)
    ring = np.floor(angles[np.arange(len(cell)), cell] * RINGS)
    nothing = ~units.any(axis=1)
    cell[nothing], ring[nothing] = -1, 0
    return cell.astype(np.int32), ring.astype(np.int32), angles


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, STEP):
            yield b.slice(k, STEP)


def _assign(batches: Iterator[pa.RecordBatch], pivots: Pivots) -> Iterator[pa.RecordBatch]:
    for b in _steps(batches):
        cell, ring, _ = _place(pivots, unit_rows(matrix_of(b.column("v"), pivots.width)))
        yield pa.record_batch([*b.columns, pa.array(cell), pa.array(ring)], [*b.schema.names, "cell", "ring"])


def _blocks(pivots: Pivots, counted: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(cell, ring, block): units of neighbouring cells together, as long as they are few items; a large unit is its own."""
    near, place, last = pivots.units @ pivots.units.T, {-1: -1}, 0
    for k in range(len(near)):   # from each pivot on to the nearest of those left
        place[last] = k
        near[:, last] = -np.inf
        last = int(near[last].argmax())
    most = min(TILE, sum(n for *_, n in counted) // SHARE)
    out, block, held = [], 0, 0
    for cell, ring, n in sorted(counted, key=lambda u: (place[u[0]], u[1])):
        if held and held + n > most:
            block, held = block + 1, 0
        out.append((cell, ring, block))
        held += n
    return out


def _visits(batches: Iterator[pa.RecordBatch], pivots: Pivots, units: np.ndarray, k: int, other_entity: bool) -> Iterator[pa.RecordBatch]:
    """The blocks, but its own, that each query (item, owner, v, block, bound) has to meet; one row per query."""
    ids, belongs = np.array(pivots.ids, object), np.array(pivots.owners, object)
    cells, low, high, block = units[:, 0], units[:, 1] / RINGS, (units[:, 1] + 1) / RINGS, units[:, 2]
    for b in _steps(batches):
        rows = unit_rows(matrix_of(b.column("v"), pivots.width))
        _, _, angles = _place(pivots, rows)
        bound = b.column("bound").to_numpy(zero_copy_only=False)
        own = b.column("block").to_numpy()
        items, owners = b.column("item").to_pylist(), b.column("owner").to_pylist()
        met = []
        for i in range(len(rows)):
            # pivots are items too: the k-th of those allowed is a bound as well
            allowed = ids != items[i]
            if other_entity and owners[i] is not None:
                allowed &= belongs != owners[i]
            near = np.cos(angles[i, :len(ids)][allowed])
            kth = np.partition(near, -k)[-k] if len(near) >= k else -1.0
            least = max(kth, -1.0 if np.isnan(bound[i]) else bound[i]) - SLACK
            if not rows[i].any():
                least = -2.0   # as near to all
            reach = np.arccos(np.clip(least, -1.0, 1.0)) + TURN
            at = angles[i][cells]
            meet = (low <= at + reach) & (high >= at - reach)
            meet[cells < 0] = least <= 0
            meet |= least < -1.0
            found = np.unique(block[meet])
            met.append(found[found != own[i]].astype(np.int32))
        yield pa.record_batch([*(b.column(c) for c in ("item", "owner", "v")), pa.array(met, pa.list_(pa.int32()))],
                              ["item", "owner", "v", "met"])


def _best(similar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest entries above -inf; of equal ones the first."""
    n = similar.shape[1]
    if n > k:
        edge = np.partition(similar, n - k, axis=1)[:, n - k, None]
        take = similar > edge
        tie = similar == edge
        take |= tie & (np.cumsum(tie, axis=1) <= k - take.sum(axis=1, keepdims=True))
    else:
        take = np.ones(similar.shape, bool)
    return np.nonzero(take & (similar > -np.inf))


TILE_KEYS = ["block", "items", "queries"]


def _meet(batches: Iterator[pa.RecordBatch], width: int, k: int, other_entity: bool) -> Iterator[pa.RecordBatch]:
    """(query_id, item_id, similarity): the best of each tile for each of its queries, which stand before its items."""
    key, queries, units = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        columns = [t.column(c).to_numpy() for c in [*TILE_KEYS, "role"]]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part, own = t.slice(a, b - a), tuple(c[a] for c in columns[:-1])
            if own != key:
                key, queries, units = own, [], None
            if columns[-1][a] == 0:
                queries.append(part)
                continue
            if not queries:
                continue
            if units is None:
                asked = pa.concat_tables(queries).combine_chunks()
                units = unit_rows(matrix_of(asked.column("v").combine_chunks(), width))
            part = part.take(pc.sort_indices(part, [("item", "ascending")])).combine_chunks()
            there = unit_rows(matrix_of(part.column("v").combine_chunks(), width)).T
            same = []
            for column, always in (("item", True), ("owner", other_entity)):
                if always:
                    codes = pa.concat_arrays([x.column(column).combine_chunks() for x in (asked, part)]).dictionary_encode().indices
                    codes = codes.fill_null(-1).to_numpy()
                    same.append((codes[:len(units)], codes[len(units):]))
            for s in range(0, len(units), STEP):
                similar = np.round(units[s:s + STEP] @ there, DIGITS)
                for q, i in same:
                    # a row without an owner belongs to nobody: it may be near anything but itself
                    similar[(q[s:s + STEP, None] == i[None, :]) & (q[s:s + STEP, None] >= 0)] = -np.inf
                row, column = _best(similar, k)
                yield pa.record_batch([asked.column("item").combine_chunks().take(pa.array(row + s)),
                                       part.column("item").combine_chunks().take(pa.array(column)),
                                       pa.array(similar[row, column])], ["query_id", "item_id", "similarity"])


def _tiles(items: DataFrame, sizes: DataFrame, visits: DataFrame, width: int, k: int, other_entity: bool) -> DataFrame:
    """Every visitor against every item of the blocks it visits, in tiles."""
    spark = items.sparkSession
    visitors = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("query_parts"))
    # a row per block
    parts = F.broadcast(sizes.select("block", F.ceil(F.col("n") / TILE).cast("int").alias("item_parts")).join(
        F.broadcast(visitors), "block"))

    def dealt(rows: DataFrame, own: str, other: str, role: int) -> DataFrame:
        placed = rows.join(parts, "block")
        return placed.select(
            "block", F.pmod(F.xxhash64("item"), F.col(f"{own}_parts")).cast("int").alias("items" if role else "queries"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias("queries" if role else "items"),
            F.lit(role).alias("role"), "item", "owner", "v")

    both = dealt(visits, "query", "item", 0).unionByName(dealt(items, "item", "query", 1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = items.schema["item"].dataType.simpleString()
    return both.repartition(n, *TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "role").mapInArrow(
        partial(_meet, width=width, k=k, other_entity=other_entity), f"query_id {kind}, item_id {kind}, similarity double")


def nearest_join(df: DataFrame, queries: DataFrame, k: int, id_column: str = "review_id", vector: str = "embedding",
                 other_entity: bool = False, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, item_id, similarity, rank), (n_queries, n_items, products)): the ``k`` nearest rows by cosine to each
    row of ``df`` whose id is in ``queries``, itself excluded, and what it took.

    Similarities are rounded to 9 digits; equal ones are ordered by id. ``other_entity`` also excludes rows of the query
    row's entity. Rows without a vector are no items, and an id without one has no result. A vector of zero is at
    similarity 0 from all. All vectors have one length. ``products`` counts the pairs whose product was taken, of
    n_queries times n_items.
    """
    group = "entity_id" if other_entity else id_column
    slim = df.where(F.col(vector).isNotNull()).select(
        F.col(id_column).alias("item"), F.col(group).alias("owner"), F.col(vector).alias("v"))
    n = slim.count()
    wanted = pivots or min(MAX_PIVOTS, max(1, round(n**0.5)))
    # by a hash of the id; of twice as many, since vectors repeat
    sample = small_rows(slim.orderBy(F.xxhash64("item"), "item").limit(2 * wanted), 2 * MAX_PIVOTS, "pivots") if n else []
    m = unit_rows(np.array([r.v for r in sample], float)) if sample else np.zeros((0, 1))
    first = np.sort(np.unique(m, axis=0, return_index=True)[1])
    first = first[m[first].any(axis=1)][:wanted]
    # without any vector but zeros there is no cell but theirs
    chosen = Pivots(m[first] if len(first) else np.eye(1, m.shape[1]), [sample[i].item for i in first], [sample[i].owner for i in first])
    schema = ", ".join(f"{c} {t}" for c, t in slim.dtypes) + ", cell int, ring int"
    placed = via_table(slim.mapInArrow(partial(_assign, pivots=chosen), schema), "cells")
    # a row per unit: pivots times rings at most
    counted = [(r.cell, r.ring, r.n) for r in placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).collect()]
    blocks = _blocks(chosen, counted)
    units = df.sparkSession.createDataFrame(blocks, "cell int, ring int, block int")
    items = placed.join(F.broadcast(units), ["cell", "ring"]).select("item", "owner", "v", "block")
    sizes = items.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    ids = queries.select(F.col(id_column).alias("item"))
    asked = items.join(ids, "item", "left_semi")
    size = (chosen.width, k, other_entity)

    home = via_table(_tiles(items, sizes, asked, *size), "home")
    last = home.groupBy("query_id").agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("s")).select(
        F.col("query_id").alias("item"), F.get("s", F.lit(k - 1)).alias("bound"))
    table = np.array(blocks, np.int64).reshape(-1, 3)
    bounded = asked.join(last, "item", "left")
    met = ", ".join(f"{c} {t}" for c, t in slim.dtypes) + ", met array<int>"
    away = via_table(bounded.mapInArrow(partial(_visits, pivots=chosen, units=table, k=k, other_entity=other_entity), met), "visits")
    visits = away.withColumn("block", F.explode("met"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    found = home.unionByName(_tiles(items, sizes, visits, *size)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    times = asked.select("block").unionByName(visits.select("block")).groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    work = times.join(F.broadcast(sizes), "block").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("products"))
    work = work.select(F.lit(asked.count()).cast("long").alias("n_queries"), F.lit(n).cast("long").alias("n_items"), "products")
    return found, work

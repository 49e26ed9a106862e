"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgauge.llm.base import salted_join, shuffle_width, signed, stored, texts
from revgauge.llm.graph import components

BITS = 64
#: A fingerprint is cut into three blocks; of 4 differing bits some two blocks hold 2 at most.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Members of one bucket that are compared in place; a larger bucket is settled by whole-fingerprint balls.
BUCKET = 1024


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's word shingles (repeats count)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - width + 1].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist())),
                         np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        rows = hashes[k:k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for every row. A null text counts as empty; a text without words has fingerprint 0."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width, seed) for t in texts(batch, "text")), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(signed(found))], ["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, fp long")


def _ball(bits: list[int], radius: int) -> np.ndarray:
    """Masks of all sets of at most ``radius`` of the given bits."""
    masks, last = [0], [(0, -1)]
    for _ in range(radius):
        last = [(m | 1 << bits[j], j) for m, i in last for j in range(i + 1, len(bits))]
        masks += [m for m, _ in last]
    return np.array(masks, np.uint64)


def _variants(batches: Iterator[pa.RecordBatch], balls: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(key, fp): each fingerprint under every mask of each ball; a ball keeps the bits of ``keep`` and tags its keys."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for tag, keep, masks in balls:
            step = max(1, (1 << 18) // len(masks))
            for k in range(0, len(fps), step):
                part = fps[k:k + step]
                keys = ((part & np.uint64(keep))[:, None] ^ masks[None, :]).ravel()
                yield pa.record_batch([pa.array(np.full(len(keys), tag, np.int32)), pa.array(signed(keys)),
                                       pa.array(signed(np.repeat(part, len(masks))))], ["tag", "key", "fp"])


def _linked(fps: np.ndarray, within: int) -> np.ndarray:
    """For each fingerprint of a bucket the place of the first member that it is connected to by links."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= within
    label = np.arange(len(fps))
    while True:
        after = np.where(near, label[None, :], len(fps)).min(axis=1)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _verify(batches: Iterator[pa.RecordBatch], within: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tag, key). Of each bucket: links (a, b) that connect what lies within the distance, one per
    member at most, or, of a bucket over ``most`` members, (a, null) for each."""
    held_key, held, over = None, [], False

    def close() -> list[tuple[np.ndarray, np.ndarray | None]]:
        fps = np.concatenate(held) if held else np.zeros(0, np.uint64)
        if over:
            return [(fps, None)] if len(fps) else []
        if len(fps) < 2:
            return []
        at = _linked(fps, within)
        own = at != np.arange(len(fps))
        return [(fps[own], fps[at[own]])] if own.any() else []

    def rows(found: list) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in found])
        b = np.concatenate([np.zeros(len(x), np.uint64) if y is None else y for x, y in found])
        none = np.concatenate([np.full(len(x), y is None) for x, y in found])
        return pa.record_batch([pa.array(signed(a)), pa.array(signed(b), mask=none)], ["a", "b"])

    for batch in batches:
        tag, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        cut = np.flatnonzero((tag[1:] != tag[:-1]) | (key[1:] != key[:-1])) + 1
        edges = np.concatenate(([0], cut, [len(key)])) if len(key) else np.zeros(1, np.int64)
        found: list = []
        for k in np.flatnonzero(np.diff(edges) > 1).tolist() if len(edges) > 3 else range(len(edges) - 1):
            if 0 < k < len(edges) - 2 and edges[k + 1] - edges[k] == 2:
                a, b = fps[edges[k]:edges[k + 1]]
                if int(a ^ b).bit_count() <= within:
                    found.append((fps[edges[k] + 1:edges[k + 1]], fps[edges[k]:edges[k] + 1]))
                continue
            if 0 < k < len(edges) - 2:
                part = fps[edges[k]:edges[k + 1]]
                if len(part) > most:
                    found.append((part, None))
                else:
                    at = _linked(part, within)
                    own = at != np.arange(len(part))
                    found.append((part[own], part[at[own]]))
        # the first and the last bucket may go on in the neighbouring batches
        for k in sorted({0, len(edges) - 2}) if len(key) else []:
            this = (int(tag[edges[k]]), int(key[edges[k]]))
            if this != held_key:
                found += close()
                held_key, held, over = this, [], False
            held.append(fps[edges[k]:edges[k + 1]])
            if over or sum(map(len, held)) > most:
                over = True
                found += close()
                held = []
        if found:
            yield rows(found)
    if last := close():
        yield rows(last)


def links(fps: DataFrame, within: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among the distinct values of column ``fp`` that connect all values within ``within`` bits.

    Every fingerprint emits, for two of its three blocks at a time, all variants of those 43 bits within half the
    radius that they can hold; rows meet on variants, repeats are dropped and colliding pairs are verified on the whole
    fingerprint. Inside a bucket only as many links stay as are needed to connect its members. The members of a bucket
    larger than ``bucket`` emit all variants of the whole fingerprint within half the distance instead: any two that
    meet there are within the distance, and each variant links its members to the smallest of them.
    """
    spark, n = fps.sparkSession, shuffle_width(fps.sparkSession)
    distinct = fps.select("fp").where("fp is not null").distinct().repartition(n, "fp")   # each row becomes many
    reach = -(-(within * 2 // 3) // 2)   # two of three blocks hold two thirds of the differing bits at most
    balls = []
    for tag in range(3):
        bits = [b for k, (lo, hi) in enumerate(BLOCKS) if k != tag for b in range(lo, hi)]
        balls.append((tag, sum(1 << b for b in bits), _ball(bits, reach)))
    keyed = distinct.mapInArrow(partial(_variants, balls=balls), "tag int, key long, fp long")
    sorted_keys = keyed.repartition(n, "tag", "key").sortWithinPartitions("tag", "key")
    found = stored(sorted_keys.mapInArrow(partial(_verify, within=within, most=bucket), "a long, b long"), "links")
    whole = [(0, (1 << BITS) - 1, _ball(list(range(BITS)), within // 2))]
    spilt = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    meets = spilt.mapInArrow(partial(_variants, balls=whole), "tag int, key long, fp long")
    least = meets.groupBy("key").agg(F.min("fp").alias("b"))
    wide = meets.join(least, "key").where("fp != b").select(F.col("fp").alias("a"), "b")
    if spilt.isEmpty():
        wide = spark.createDataFrame([], "a long, b long")
    return found.where("b is not null").unionByName(wide).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", within: int = 4, width: int = 4,
                    seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints are connected by links of at most ``within``
    differing bits share the smallest doc_id among them.

    Equal fingerprints are one node, so a group of copies costs one row after the first combine. Rows without text or
    words have fingerprint zero and link like any other; an empty table gives no rows; repeated rows stay; other
    columns are ignored. A null doc_id takes the class of its text, and null only if no row of the class has an id.
    """
    marked = stored(fingerprints(docs, text, doc_id, width, seed), "fingerprints")
    classed = classes(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), within, bucket)
    return marked.join(classed.withColumnRenamed("least", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(nodes: DataFrame, within: int, bucket: int) -> DataFrame:
    """(fp, least) for (fp, first), one row per fingerprint: the least ``first`` of all fingerprints it is connected to.

    A fingerprint without links is its own class. The members of a linked class meet its least in several tasks,
    so that the largest class is not one task's work.
    """
    roots = components(links(nodes, within, bucket))
    classed = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", "root"), "classes")
    linked = classed.where("root is not null")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    return salted_join(linked, least, "root", "fp").select("fp", "least").unionByName(
        classed.where("root is null").select("fp", F.col("first").alias("least")))


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", within: int = 4, width: int = 4,
                  seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, all columns as they are, one of each class of ``near_duplicates``: the one with the
    smallest id; rows without an id come last, rows that share one are ordered by a hash of the text.

    Rows are named by id and hash of the text, and no copy of them is stored; of rows with the same name one stays too, the
    first as they are read. Every row belongs to a class, texts that are null, empty or without words to that of fingerprint
    zero; an empty table gives no rows.
    """
    order = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    marked = stored(fingerprints(docs.select(order.alias("first"), F.col(text).alias("text")), "text", "first", width, seed),
                    "fingerprints").withColumnRenamed("doc_id", "first")
    classed = classes(marked.groupBy("fp").agg(F.min("first").alias("first")), within, bucket)
    rows = docs.select(F.struct("*").alias("row"), order.alias("first"), F.monotonically_increasing_id().alias("n"))
    copies = marked.groupBy("first").agg(F.count("*").alias("copies"))
    winners = classed.select(F.col("least").alias("first"), F.lit(True).alias("won")).distinct()
    # the names that go, mostly far fewer than those that stay, and those of which one row of several stays
    others = stored(copies.join(winners, "first", "left").where("won is null or copies > 1"), "others")

    def against(chosen: DataFrame, how: str) -> DataFrame:
        a, b = rows["first"], chosen["first"]
        return rows.join(chosen, a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"]), how)

    left = against(others, "left_anti")
    several = others.where("won")
    if not several.isEmpty():
        same = Window.partitionBy("first").orderBy("n")
        one = against(several, "left_semi").withColumn("place", F.row_number().over(same)).where("place = 1")
        left = left.unionByName(one.drop("place"))
    return left.select("row.*")

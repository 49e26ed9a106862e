"""Exact repeats of long byte strings, by prefix doubling over a sparse suffix array.

A full suffix array has a row for every byte; its first rounds only tell short strings apart. Here the array starts at
half the threshold: of every string of ``length`` bytes one inner place is taken, the start of the half-length string
with the smallest name, so that equal strings take the same place. These places are some four per hundred bytes. Then

1. Spark sorts the places by the pair (name of the half-length string there, name of what stands around it as far as
   any string of the full length through it can reach). A place whose half is unique drops out, as does the only kind
   of surroundings of a half. Of equal surroundings the first place stands for all: whatever a later one covers is a
   repeat.
2. What is left, the first places of halves with differing surroundings, gives up all its strings of full length as
   rank pairs at the doubled offset, (name at p, name at p + half). Spark sorts these; each but the first of its pair is
   a repeat, and the threshold is reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import SpanHash, byte_columns, mix64, shuffle_width, signed, stored

#: Bytes worked on at once in a task; longer texts are taken in overlapping pieces.
PIECE = 1 << 18
#: ``place * PACK**2 + back * PACK + ahead`` keeps a place with the first and last string that it stands for.
PACK = 1 << 10


def again(x: np.ndarray, y: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the pair (x, y) stood before in the same text; rows come in the order of their places."""
    order = np.lexsort((doc, y, x))   # stable: equal rows stay in order
    a, b, c = x[order], y[order], doc[order]
    again = np.zeros(len(x), bool)
    again[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
    return again


def _places(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(half, around, doc_id, place) of the places of every text; ``known``: a repeat of a place before in this text."""
    k = length // 2
    width = length - k + 1
    spans = SpanHash(PIECE + 4 * length)
    low = np.uint64(0xFFFFFFFF)
    for batch in batches:
        flat, at = byte_columns(batch, "text")
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for s in range(0, len(flat), PIECE):
            a, b = max(0, s - length), min(len(flat), s + PIECE + 2 * length)
            if b - a < length:
                continue
            # the text that each of the piece's bytes belongs to
            i, j = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
            row = np.repeat(np.arange(i, j), np.diff(np.clip(at[i:j + 1], a, b)))
            prefix = spans.prefix(flat[a:b])
            starts = np.arange(b - a - k + 1)
            half = spans.name(prefix, starts, starts + k)
            # the name's upper half, then the place: the leftmost of the smallest
            v = (half & ~low) | starts.astype(np.uint64)
            step = 1
            while step * 2 <= width:
                v = np.minimum(v[:-step], v[step:])
                step *= 2
            if width > step:
                v = np.minimum(v[:step - width], v[width - step:])
            p = np.arange(s, min(s + PIECE, a + len(v)))   # the strings that start in this piece
            p = p[at[row[p - a] + 1] - p >= length]
            if not len(p):
                continue
            place = (v[p - a] & low).astype(np.int64) + a
            new = np.concatenate(([True], (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1)))
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(p)])) - 1
            place, lo, hi = place[first], p[first], p[last]
            doc = row[place - a]
            begin = np.maximum(place - (length - k), at[doc])
            end = np.minimum(place + length, at[doc + 1])
            reach = (place - begin) * PACK + (end - place)
            around = mix64(spans.name(prefix, begin - a, end - a) + reach.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            where = (place - at[doc]) * PACK**2 + (place - lo) * PACK + (place - hi)
            x = signed(half[place - a])
            yield pa.record_batch([pa.array(x), pa.array(signed(around)), pa.array(ids[doc]), pa.array(where),
                                   pa.array(again(x, around, doc))], ["x", "y", "doc_id", "at", "known"])


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(name at p, name at p + half, doc_id, p) of every string of full length that the given places stand for."""
    k = length // 2
    spans = SpanHash(PIECE + 4 * length)
    for batch in batches:
        flat, at = byte_columns(batch, "text")
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, where in enumerate(batch.column(2).to_pylist()):
            where = np.unique(np.array(where, np.int64))   # each row of a repeated id hands on its places
            place = where // PACK**2
            lo, n = place - where // PACK % PACK, where // PACK % PACK - where % PACK + 1
            p = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            while len(p):
                s = int(p[0])
                part, p = p[p < s + PIECE], p[p >= s + PIECE]
                prefix = spans.prefix(flat[at[i] + s:min(at[i + 1], at[i] + s + PIECE + length)])
                q = part - s
                x, y = signed(spans.name(prefix, q, q + k)), signed(spans.name(prefix, q + k, q + length))
                doc = np.full(len(q), ids[i])
                yield pa.record_batch([pa.array(x), pa.array(y), pa.array(doc), pa.array(part), pa.array(again(x, y, doc))],
                                      ["x", "y", "doc_id", "at", "known"])


def _rerank(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (x, y, doc_id, at): of each pair (x, y) all but the first place (kind 1), and the first places of
    every x that has several y (kind 2). ``at // scale`` is the place. Rows marked ``known`` are repeats of places in their
    own text and pass by. State: the current pair, and one waiting row."""
    pair: tuple = (None, None)
    head: tuple = (None, None)
    kinds, waiting = 0, []
    for batch in batches:
        known = batch.filter(batch.column(4))
        if known.num_rows:
            yield pa.record_batch([known.column(2), known.column(3), pa.array(np.ones(known.num_rows, np.int32))],
                                  ["doc_id", "at", "kind"])
            batch = batch.filter(pc.invert(batch.column(4)))
        if not batch.num_rows:
            continue
        x, y, doc, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        new_x = np.concatenate(([x[0] != pair[0]], x[1:] != x[:-1]))
        new_y = np.concatenate(([bool(new_x[0]) or y[0] != pair[1]], y[1:] != y[:-1])) | new_x
        lead = np.maximum.accumulate(np.where(new_y, np.arange(len(x)), -1))
        carried = lead < 0
        lead_doc, lead_at = doc[lead], at[lead] // scale
        if carried.any():
            lead_doc, lead_at = np.where(carried, head[0], lead_doc), np.where(carried, head[1], lead_at)
        first = (doc == lead_doc) & (at // scale == lead_at)
        run = np.cumsum(new_x)
        classes = np.bincount(run, new_y, minlength=run[-1] + 1)
        classes[0] += kinds
        out_doc, out_at, kind = [doc[~first]], [at[~first]], [np.ones((~first).sum(), np.int32)]
        several = first & (classes[run] >= 2)
        if waiting and classes[0] >= 2:
            out_doc.append(np.array([d for d, _ in waiting], doc.dtype))
            out_at.append(np.array([a for _, a in waiting], np.int64))
            kind.append(np.full(len(waiting), 2, np.int32))
        out_doc.append(doc[several])
        out_at.append(at[several])
        kind.append(np.full(several.sum(), 2, np.int32))
        if run[-1] > 0 or classes[0] >= 2:
            waiting = []
        if classes[run[-1]] == 1:
            mine = np.flatnonzero((run == run[-1]) & first)
            waiting = waiting + list(zip(doc[mine].tolist(), at[mine].tolist(), strict=True))
        kinds, pair, head = int(classes[run[-1]]), (x[-1], y[-1]), (lead_doc[-1], lead_at[-1])
        yield pa.record_batch([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_at)),
                               pa.array(np.concatenate(kind))], ["doc_id", "at", "kind"])


def rerank(rows: DataFrame, by: list[str], scale: int, partitions: int) -> DataFrame:
    """(doc_id, at, kind) of the repeats and the undecided among rows (x, y, doc_id, at, known); see ``_rerank``.

    Rows meet on ``by``. A text that repeats itself thousands of times sends one row to the place where its pair is
    ranked: its known repeats are dealt out by their places.
    """
    meet = F.when(F.col("known"), F.xxhash64("doc_id", "at")).otherwise(F.xxhash64(*by))
    ordered = rows.repartition(partitions, meet).sortWithinPartitions("x", "y", "doc_id", "at")
    return ordered.mapInArrow(partial(_rerank, scale=scale), "doc_id long, at long, kind int")


def _cut(batches: Iterator[pa.RecordBatch], length: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    """Joins the repeated strings of a text to spans, and cuts them out."""
    for batch in batches:
        flat, at = byte_columns(batch, "text")
        n_bytes, spans, kept = np.diff(at), [], []
        for i, found in enumerate(batch.column(2).to_pylist()):
            data = flat[at[i]:at[i + 1]]
            if not found:
                spans.append([])
                kept.append(data.tobytes())
                continue
            found = np.sort(np.array(found, np.int64))
            lo = found // PACK
            hi = np.maximum.accumulate(lo + found % PACK + length)
            new = np.concatenate(([True], lo[1:] > hi[:-1]))
            start = lo[new]
            end = hi[np.concatenate((np.flatnonzero(new)[1:], [len(lo)])) - 1]
            edge = np.zeros(len(data) + 1, np.int8)
            edge[start], edge[end] = 1, -1
            kept.append(data[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes())
            spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        yield pa.record_batch(
            [batch.column(0), pa.array(n_bytes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"])


def repeated_spans(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id",
                   as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: the maximal byte spans covered by strings of ``length`` bytes that also
    start earlier (in a smaller doc_id, or before in the same text), and the bytes left without them. ``as_text`` gives
    what is left as a string: a character of which a part is cut goes as a whole.

    Texts are UTF-8 bytes, judged on the input; no match crosses texts; overlaps count. A null text counts as empty.
    Ids are integers and name a text: a row that repeats an id and its text gets the same answer as the first, and is
    no earlier copy of it. A row with a null id is neither compared nor cut. An empty table gives no rows; other columns
    are ignored. ``length`` is at least 4 and below 1,024.
    """
    if not 4 <= length < PACK:
        raise ValueError(f"length must lie between 4 and {PACK - 1}")
    spark = docs.sparkSession
    n = shuffle_width(spark)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = slim.where("doc_id is not null")
    pairs = "x long, y long, doc_id long, at long, known boolean"

    def ranked(rows: DataFrame, by: list[str], scale: int) -> DataFrame:
        return rerank(rows, by, scale, n)

    places = stored(ranked(named.mapInArrow(partial(_places, length=length), pairs), ["x"], PACK**2), "places")
    undecided = places.where("kind = 2").groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    strings = named.join(undecided, "doc_id").select("doc_id", "text", "at").mapInArrow(partial(_strings, length=length), pairs)
    later = stored(ranked(strings, ["x", "y"], 1).where("kind = 1").select("doc_id", "at"), "strings")
    back, ahead = F.shiftright("at", 10) % PACK, F.col("at") % PACK
    place = F.shiftrightunsigned("at", 20)
    covered = places.where("kind = 1").select("doc_id", ((place - back) * PACK + back - ahead).alias("found")).unionByName(
        later.select("doc_id", (F.col("at") * PACK).alias("found")))
    covered = covered.groupBy("doc_id").agg(F.collect_list("found").alias("found"))
    joined = slim.join(covered, "doc_id", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(
        partial(_cut, length=length, as_text=as_text),
        f"doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}")

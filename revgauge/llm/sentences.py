"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import mix64, shuffle_width, signed, stored, texts
from revgauge.llm.suffix import again, rerank

#: A sentence ends after stops that stand before a blank, or at a line's end.
END = re.compile(rb"[.!?]+(?=[\s\"')\]]|$)[\"')\]]*\s*|\n\s*|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)+\s*")
#: A sentence of more words than ``LONG`` counts as several: it is cut at the stops inside it.
PAUSE = re.compile(rb"[,;:]+\s+")
LONG = 12
#: So many bytes of a sentence count as a word if it has fewer words.
BYTES = 10
#: A run's place is its first sentence, then its number of sentences in so many bits.
LENGTH_BITS = 20


def split(text: bytes) -> list[int]:
    """The offsets at which sentences end, each with the blanks behind it; the last is the text's length."""
    ends = [m.end() for m in END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    out: list[int] = []
    for a, b in zip([0, *ends[:-1]], ends):
        if b - a > 2 * LONG and len(text[a:b].split()) > LONG:
            out += [m.end() for m in PAUSE.finditer(text, a, b) if m.end() < b]
        out.append(b)
    return out


def runs(weight: np.ndarray, size: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shortest runs of at least ``size`` sentences and ``words`` words that begin with a sentence, and
    of those that end with one."""
    total = np.concatenate(([0], np.cumsum(weight)))
    n = len(weight)
    here = np.arange(n + 1)
    end = np.maximum(here + size, np.searchsorted(total, total + words, "left"))
    first = np.minimum(here - size, np.searchsorted(total, total - words, "right") - 1)
    pairs = np.concatenate((here[end <= n] * (n + 1) + end[end <= n], first[first >= 0] * (n + 1) + here[first >= 0]))
    return np.divmod(np.unique(pairs), n + 1)


def _runs(batches: Iterator[pa.RecordBatch], size: int, words: int) -> Iterator[pa.RecordBatch]:
    """(x, y, doc_id, at): two names of every run, and its place: first sentence and number of sentences."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        out: list[list] = [[], [], [], []]
        for row, text in enumerate(texts(batch, "text")):
            ends = split(text)
            if len(ends) < size:
                continue
            parts = [text[a:b].lower().split() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            name = np.fromiter((xxh64_intdigest(b" ".join(p)) for p in parts), np.uint64, len(parts))
            first, end = runs(np.fromiter((max(len(p), sum(map(len, p)) // BYTES) for p in parts), np.int64, len(parts)), size, words)
            length = end - first
            x, y = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
            for k in range(int(length.max(initial=0))):
                more = length > k
                own = name[first[more] + k]
                x[more] = mix64(x[more] * np.uint64(3) + own)
                y[more] = mix64(y[more] * np.uint64(5) + (own ^ np.uint64(0x5851F42D4C957F2D)))
            for column, values in zip(out, (x, y, np.full(len(first), row), first << LENGTH_BITS | length), strict=True):
                column.append(values)
        if out[0]:
            x, y, row, at = (np.concatenate(c) for c in out)
            x, y = signed(x), signed(y)
            yield pa.record_batch([pa.array(x), pa.array(y), pa.array(ids[row]), pa.array(at), pa.array(again(x, y, row))],
                                  ["x", "y", "doc_id", "at", "known"])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, total = [], [], []
        for text, places in zip(texts(batch, "text"), batch.column(2).to_pylist(), strict=True):
            ends = split(text)
            edge = np.zeros(len(ends) + 1, np.int64)
            at = np.array(places or [], np.int64)
            first, length = at >> LENGTH_BITS, at & (1 << LENGTH_BITS) - 1
            np.add.at(edge, first, 1)
            np.add.at(edge, first + length, -1)
            covered = (np.cumsum(edge)[:-1] > 0).tolist()
            starts = [0, *ends][:len(ends)]
            kept.append(b"".join(text[a:b] for a, b, c in zip(starts, ends, covered, strict=True) if not c).decode())
            removed.append([i for i, c in enumerate(covered) if c])
            total.append(len(ends))
        yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.list_(pa.int64())),
                               pa.array(kept, pa.string())], ["doc_id", "n_sentences", "removed", "kept"])


def drop_repeated_spans(docs: DataFrame, size: int = 2, words: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_sentences, removed, kept) per row: the numbers of the sentences that lie in a run of consecutive
    sentences seen before (in a smaller doc_id, or earlier in the text), and the text without them.

    A run has at least ``size`` sentences and ``words`` words, and as many sentences as it needs for that: the shortest
    one from each sentence on, and the shortest one that ends with it. Ten bytes count as a word in sentences of longer
    words or without blanks. All runs of all texts are hashed (case and blanks aside); Spark sorts the hashes of all
    documents with their places, and every place of a hash but the first marks its run. Sentences end at stops
    before a blank and at line ends. A null text is empty; ids are integers that name a text, rows that repeat an id
    get the same answer; a row with a null id is left whole; an empty table gives no rows; other columns are ignored.
    """
    if not 0 < size + words < 1 << LENGTH_BITS:
        raise ValueError("size and words are too large")
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = slim.where("doc_id is not null").mapInArrow(
        partial(_runs, size=size, words=words), "x long, y long, doc_id long, at long, known boolean")
    later = stored(rerank(named, ["x", "y"], 1, shuffle_width(spark)).where("kind = 1").select("doc_id", "at"), "runs")
    marked = later.groupBy("doc_id").agg(F.collect_list("at").alias("runs"))
    joined = slim.join(marked, "doc_id", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_drop, "doc_id long, n_sentences long, removed array<long>, kept string")

"""Order MinHash fingerprints: minimal occurrence-numbered k-mers in their text order, hashed as tuples.

A function of the fingerprint takes the k-mers with the smallest hashes, each told apart from its repeats by a number,
and hashes them in the order in which they stand: two texts agree in it only if they share k-mers in the same order, so
the share of agreeing functions follows the edit distance, where the plain MinHash is blind to moved parts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import mix64, shuffle_width, texts

#: Repeats of a k-mer are told by the upper 40 bits of its hash; a text's places fit the lower ones, or are sorted apart.
PLACE = 24
#: k-mers whose hashes are taken at once under all functions.
CHUNK = 2048
#: No k-mer, as (value, place) in one number.
NONE = np.uint64(2**64 - 1)
LOW = np.uint64(2**32 - 1)


class OrderMinHash:
    """Fingerprints of ``functions`` 16-bit elements from tuples of ``size`` k-mers of ``k`` code points.

    A text shorter than ``k`` is one k-mer, a text with fewer than ``size`` k-mers has shorter tuples, an empty text has
    empty ones.
    """

    def __init__(self, k: int = 8, size: int = 2, functions: int = 64) -> None:
        self.k, self.size, self.functions = k, size, functions
        rng = np.random.default_rng(20240229)
        self.odd = rng.integers(0, 2**32, functions, dtype=np.uint32)[:, None] | np.uint32(1)
        self.base, self.repeat, self.link = (int(x) | 1 for x in rng.integers(0, 2**64, 3, dtype=np.uint64))

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every k-mer: windows of 1, 2, 4, ... code points are joined to windows of k."""
        n, have = len(codes), 1
        if n == 0:
            return np.zeros(0, np.uint64)
        k = min(self.k, n)
        part = codes.astype(np.uint64) + np.uint64(1)
        while have < k:
            step = min(have, k - have)   # the last windows may overlap: they still name their code points
            part = part[:n - have - step + 1] * np.uint64(pow(self.base, have, 2**64)) + part[step:n - have + 1]
            have += step
        return mix64(part ^ np.uint64(k))

    def _numbered(self, grams: np.ndarray, split: int, ends: int) -> np.ndarray:
        """How often each k-mer came before. Places from ``ends`` on follow those before ``split``, not those between."""
        n = len(grams)
        if n < 1 << PLACE:
            packed = np.sort(grams >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(n, dtype=np.uint64))
            name, place = packed >> np.uint64(PLACE), (packed & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        else:
            place = np.argsort(grams >> np.uint64(PLACE), kind="stable")
            name = (grams >> np.uint64(PLACE))[place]
        again = np.flatnonzero(name[1:] == name[:-1]) + 1
        number = np.zeros(n, np.int64)
        if len(again):
            first = np.ones(n, bool)
            first[again] = False
            start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            passed = np.concatenate(([0], np.cumsum((place >= split) & (place < ends))))
            rank = np.arange(n) - start
            number[place] = rank - np.where(place >= ends, passed[:-1] - passed[start], 0)
        return number.astype(np.uint64)

    def _least(self, grams: np.ndarray, number: np.ndarray, at: int) -> np.ndarray:
        """Per function the smallest hashes with their places, counted from ``at``: value * 2**32 + place, rising."""
        mixed = (mix64(grams + number * np.uint64(self.repeat)) >> np.uint64(32)).astype(np.uint32)
        least = np.full((self.functions, self.size), NONE)
        room = np.empty((self.functions, min(CHUNK, len(mixed))), np.uint32)
        for a in range(0, len(mixed), CHUNK):
            part = mixed[a:a + CHUNK]
            hashed = np.multiply(part, self.odd, out=room[:, :len(part)])
            rows = np.arange(self.functions)
            if a:
                rows = np.flatnonzero(hashed.min(axis=1) < (least[:, -1] >> np.uint64(32)))
                if not len(rows):
                    continue
                hashed = hashed[rows]
            line, found = np.arange(len(rows)), [least[rows]]
            for _ in range(min(self.size, hashed.shape[1])):
                best = hashed.argmin(axis=1)
                found.append((hashed[line, best].astype(np.uint64) << np.uint64(32) | (best + (at + a)).astype(np.uint64))[:, None])
                hashed[line, best] = LOW
            least[rows] = np.sort(np.concatenate(found, axis=1), axis=1)[:, :self.size]
        return least

    def _joined(self, grams: np.ndarray, *parts: np.ndarray) -> np.ndarray:
        """The elements: the k-mers with the smallest hashes of all parts, in the order of their places, hashed."""
        least = np.sort(np.concatenate(parts, axis=1), axis=1)[:, :self.size]
        place = np.sort(least & LOW, axis=1)   # of a missing one beyond any other
        out = np.zeros(self.functions, np.uint64)
        for j in range(min(self.size, len(grams))):
            out = mix64((out ^ grams[place[:, j]]) * np.uint64(self.link))
        return (out >> np.uint64(48)).astype(np.uint16)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The fingerprint of a text given as code points."""
        grams = self.grams(codes)
        return self._joined(grams, self._least(grams, self._numbered(grams, len(grams), len(grams)), 0))

    def of_edited(self, codes: np.ndarray, keep: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints of a text and of the same with all after ``keep`` code points replaced by ``end``; the k-mers
        of the part that stays are taken once."""
        edited = np.concatenate((codes[:keep], end))
        if min(len(codes), len(edited), keep) < self.k:
            return self.of(codes), self.of(edited)
        own, split = self.grams(codes), keep - self.k + 1
        new = self.grams(edited[split:]) if len(edited) - split >= self.k else own[:0]
        grams = np.concatenate((own, new))
        number = self._numbered(grams, split, len(own))
        start, rest, other = (self._least(grams[a:b], number[a:b], min(a, split)) for a, b in
                              ((0, split), (split, len(own)), (len(own), len(grams))))
        return self._joined(own, start, rest), self._joined(np.concatenate((own[:split], new)), start, other)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _key(doc_id, h: int) -> tuple:
    """Ids ascending, rows without one first; rows of one id by the hash of their text."""
    return (0, h) if doc_id is None else (1, doc_id, h)


def in_order(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(code, doc_id, h, text): all rows in buckets of the ascending ids, sorted, each bucket in one partition.

    A bucket's own rows have the even ``code`` 2 b; after them, with 2 b + 1, stands the first row of the next bucket (of
    the first one after the last): every row is followed by its successor, and texts are shuffled once. Cuts come from a
    shuffle of ids and hashes alone, and only one pair per bucket reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    firsts = (rows.select("doc_id", "h").repartitionByRange(shuffle_width(spark), "doc_id", "h")
              .groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "h")).alias("first")).select("first.*"))
    cuts = sorted(_key(*r) for r in firsts.collect())
    n = max(1, len(cuts))

    @F.arrow_udf("array<int>")
    def codes(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for key in map(_key, ids.to_pylist(), hashes.to_pylist()):
            b = max(0, bisect_right(cuts, key) - 1)
            out.append([2 * b, 2 * ((b - 1) % n) + 1] if cuts and key == cuts[b] else [2 * b])
        return pa.array(out, pa.list_(pa.int32()))

    placed = rows.select(F.explode(codes("doc_id", "h")).alias("code"), "doc_id", "h", "text")
    return placed.repartitionById(n, F.shiftright("code", 1)).sortWithinPartitions("code", "doc_id", "h", "text")


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = 8, size: int = 2, functions: int = 64, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 4 code points replaced by the first as many (or all) of the next document by
    ascending id; after the last comes the first, and a lone row follows itself. Likeness is the share of equal elements.
    A null text counts as empty. Rows without an id come first and rows of one id stand side by side, both in the order of
    their texts' hashes; no row is dropped. A text takes some hundred bytes of memory per code point.
    """
    minhash = OrderMinHash(k, size, functions)
    ordered = in_order(docs, text, doc_id)
    kind = ordered.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, done, current, waiting = None, [], None, None

        def finish(own: np.ndarray) -> None:
            if waiting is not None:
                done.append((*waiting[0], likeness(waiting[1], own)))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * 7
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)

        for batch in batches:
            id_type = batch.column(1).type
            for code, who, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "text"), strict=True):
                if current is None and code % 2:
                    continue   # more copies of the next bucket's first row
                body = raw.decode("utf-8", "replace")
                if current is not None:
                    was, before = current
                    cut = len(before) // 4
                    keep = len(before) - cut
                    own, edited = minhash.of_edited(code_points(before), keep, code_points(body[:cut]))
                    finish(own)
                    digest = hashlib.sha256((before[:keep] + body[:cut]).encode()).hexdigest()
                    waiting = ((was, len(before), digest, _hex(own), _hex(edited), likeness(own, edited)), own)
                if code % 2:
                    finish(minhash.of(code_points(body)))
                    current = waiting = None
                else:
                    current = (who, body)
            yield out()
            done.clear()

    return ordered.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
                              "edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

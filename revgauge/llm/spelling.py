"""Spelling variants: words at one edit from a far more frequent word, found in a bit-sliced position index.

For every (position, letter) the index holds a bitset over a block of words. One pass over the letters of a query keeps
four bitsets: words equal so far, and words equal so far but for one replaced letter, one letter more (read one position
ahead) or one letter less (one position behind). All queries of a block advance together, 64 words a machine word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import shuffle_width, stored, texts

#: Words of at least 6 letters at one edit share their first or their last 3 letters: blocks are made of these.
SHORTEST, SHARED = 6, 3
#: Words of a block that are compared at once; a larger block is cut into tiles of (queries, indexed words).
TILE = 2048
#: Distinct runs that a task holds before it hands their counts on.
HELD = 200_000
#: Every one out of so many (document, run) pairs gets a planted misspelling.
PLANTED = 199


def planted(doc_id: str, run: str) -> str:
    """The run as the document has it, or with one letter deleted, by a hash of both."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % PLANTED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counts(batches: Iterator[pa.RecordBatch], rewrite: Callable[[str, str], str] | None) -> Iterator[pa.RecordBatch]:
    """(word, n): counts of a task's words, handed on whenever there are ``HELD``. Shorter runs cannot become words."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}").findall
    found: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        # a run of 6 that lost a letter is no word
        kept = [(w, n) for w, n in found.items() if len(w) >= SHORTEST]
        return pa.record_batch([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    for batch in batches:
        # bytes.lower touches A-Z alone
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
            own = Counter(runs(text.lower().decode("utf-8", "replace")))
            if rewrite is None:
                found.update(own)
            else:
                for w, n in own.items():
                    found[rewrite(doc_id or "", w)] += n
            if len(found) >= HELD:
                yield out()
                found.clear()
    yield out()


def vocabulary(docs: DataFrame, least: int = 5, rewrite: Callable[[str, str], str] | None = None, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """(word, n): maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, of at least 6 letters
    and at least ``least`` occurrences in all texts. ``rewrite(doc_id, run)`` may change a run before it is counted. A
    null text has no runs, a null id counts as an empty one, repeated rows count each time."""
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    parts = slim.mapInArrow(partial(_counts, rewrite=rewrite), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """Bitsets over words: which of them have a given letter at a given position."""

    def __init__(self, words: list[str]) -> None:
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(words))))}
        length = np.fromiter(map(len, words), np.int64, len(words))
        self.longest, self.width = int(length.max()), -(-len(words) // 64)
        letter = np.fromiter((self.letters[w] for w in "".join(words)), np.int64, int(length.sum()))
        word = np.repeat(np.arange(len(words)), length)
        position = np.arange(len(letter)) - np.repeat(np.cumsum(length) - length, length)
        # a row for each (position, letter) that occurs, after one without words
        rows, row = np.unique(position * len(self.letters) + letter, return_inverse=True)
        self.at = np.zeros((self.longest + 1, len(self.letters) + 1), np.int32)
        self.at.ravel()[rows // len(self.letters) * (len(self.letters) + 1) + rows % len(self.letters)] = np.arange(1, len(rows) + 1)
        self.bits = self._packed(row + 1, word, len(rows) + 1)
        sizes, row = np.unique(length, return_inverse=True)
        self.sizes = {int(s): bits for s, bits in zip(sizes, self._packed(row, np.arange(len(words)), len(sizes)), strict=True)}

    def _packed(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.width), np.uint64)
        np.bitwise_or.at(out, (row, word // 64), np.uint64(1) << (word % 64).astype(np.uint64))
        return out

    def of_size(self, size: int) -> np.ndarray:
        return self.sizes.get(size, np.zeros(self.width, np.uint64))

    def near(self, queries: list[str], but_first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) places of all pairs at exactly one edit; without those that share the first ``but_first``
        letters."""
        order = sorted(range(len(queries)), key=lambda i: -len(queries[i]))
        size = np.array([len(queries[i]) for i in order])
        letter = np.full((len(order), int(size[0])), len(self.letters), np.int64)   # the last column: no such letter
        for r, i in enumerate(order):
            letter[r, :size[r]] = [self.letters.get(c, len(self.letters)) for c in queries[i]]
        shape = (len(order), self.width)
        same, other = np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64)
        more, less, left_out = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), None
        for p in range(min(int(size[0]), self.longest + 1)):
            m = int(np.searchsorted(-size, -p, side="left"))   # queries with a letter here
            here, ahead, behind = (self._with(p + step, letter[:m, p]) for step in (0, 1, -1))
            z = same[:m]
            more[:m] = (more[:m] | z) & ahead
            less[:m] = less[:m] & behind | z
            other[:m] = other[:m] & here | z & ~here
            same[:m] = z & here
            if p + 1 == but_first:
                left_out = same.copy()
        found = np.zeros(shape, np.uint64)
        for s in np.unique(size).tolist():
            if s > self.longest + 1:
                continue
            rows = size == s
            found[rows] = (other[rows] & self.of_size(s) | (more[rows] | same[rows]) & self.of_size(s + 1)
                           | less[rows] & self.of_size(s - 1))
        if left_out is not None:
            found &= ~left_out
        row, block = np.nonzero(found)
        bits = np.unpackbits(found[row, block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        return np.array(order)[row[hit]], block[hit] * 64 + bit

    def _with(self, position: int, letter: np.ndarray) -> np.ndarray:
        if not 0 <= position < self.longest:
            return np.zeros((len(letter), self.width), np.uint64)
        return self.bits[self.at[position, letter]]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, whole, from batches sorted by ``keys``."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        changed = np.zeros(batch.num_rows, bool)
        changed[0] = bool(held) and any(held[-1].column(k)[-1] != t.column(k)[0] for k in keys)
        for k in keys:
            c = t.column(k)
            changed[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy()
        at = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if held and changed[a]:
                yield pa.concat_tables(held)
                held = []
            if b > a:
                held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


KEYS = ["kind", "shared", "queries", "indexed"]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best struct<less, word>) of the queries of each tile that have a near word in it."""
    for tile in _groups(batches, KEYS):
        words, n, role = (tile.column(c).to_pylist() for c in ("word", "n", "role"))
        asked = [i for i, r in enumerate(role) if r & 1]
        known = [i for i, r in enumerate(role) if r & 2]
        if not asked or not known:
            continue
        index = PositionIndex([words[i] for i in known])
        # pairs with the same first letters are found in the block of these
        q, w = index.near([words[i] for i in asked], SHARED if tile.column("kind")[0].as_py() else 0)
        best: dict[int, tuple[int, str]] = {}
        for a, b in zip(q.tolist(), w.tolist(), strict=True):
            found = (-n[known[b]], words[known[b]])
            best[a] = min(best.get(a, found), found)
        if best:
            count = np.bincount(q, minlength=len(asked))
            yield pa.record_batch(
                [pa.array([words[asked[a]] for a in best]), pa.array([int(count[a]) for a in best], pa.int64()),
                 pa.array([x for x, _ in best.values()], pa.int64()), pa.array([x for _, x in best.values()], pa.string())],
                ["word", "n_near", "less", "near"])


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near long, less long, near string) for each of ``words`` (word, n; distinct, 6 letters or more) that has
    another at exactly one edit: how many, and of these the one of largest n (``less`` is -n; ties: smallest by code
    point).

    A word lies in the blocks of its first and of its last three letters. A block of b words is cut into g = b / ``tile``
    parts by hash, and each pair of parts is a tile of its own, so a common ending takes more tasks and no larger ones.
    """
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.substring("word", 1, SHARED).alias("shared")),
                              F.struct(F.lit(1).alias("kind"), F.expr(f"right(word, {SHARED})").alias("shared"))))
    blocks = words.select("word", "n", kinds.alias("b")).select("word", "n", "b.kind", "b.shared")
    sizes = blocks.groupBy("kind", "shared").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    # two rows for each three letters of the 90 at most
    placed = blocks.join(F.broadcast(sizes), ["kind", "shared"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    with_all = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    is_own = F.col("other") == F.col("own")
    asked = with_all.select("word", "n", "kind", "shared", F.col("own").alias("queries"), F.col("other").alias("indexed"),
                            F.when(is_own, 3).otherwise(1).alias("role"))
    known = with_all.where(~is_own).select("word", "n", "kind", "shared", F.col("other").alias("queries"),
                                           F.col("own").alias("indexed"), F.lit(2).alias("role"))
    width = shuffle_width(words.sparkSession)
    tiles = asked.unionByName(known).repartition(width, *KEYS).sortWithinPartitions(*KEYS)
    found = tiles.mapInArrow(_near, "word string, n_near long, less long, near string")
    best = F.min(F.struct("less", "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.less", "best.near")


def variants(words: DataFrame, times: int = 5, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of ``words`` (word, n).

    ``form`` is the near word of largest n if that is at least ``times`` the word's own, else null; ``root`` follows forms
    to the last. Every step multiplies n by ``times`` or more, so chains are short and without circles; pointers are
    doubled until none moves.
    """
    words = stored(words, "words")
    near = near_words(words, tile)
    formed = words.join(near, "word", "left").withColumn("_far", -F.col("less") >= times * F.col("n"))
    formed = stored(formed.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("if(_far, near, null)").alias("form"),
        F.expr("if(_far, -less, null)").alias("form_n")), "forms")
    # few words have a form; (word, root) of these
    reached = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        reached = stored(reached, "roots")
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reached.join(onward, "root", "left_semi").isEmpty():
            break
        reached = reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(reached, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, least: int = 5, times: int = 5, rewrite: Callable[[str, str], str] | None = None,
                   text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The words of a corpus with their spelling groups: word, form, root, n, n_near, form_n (see ``vocabulary`` and
    ``variants``). A corpus without words gives no rows."""
    found = variants(vocabulary(docs, least, rewrite, text, doc_id), times)
    return found.select("word", "form", "root", "n", "n_near", "form_n")

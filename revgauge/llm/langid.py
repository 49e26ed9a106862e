"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgauge.llm.base import verdict

#: Characters worked on at once; longer texts are counted in pieces.
PIECE = 1 << 20
#: Most languages that can be told apart; their profiles go to every task.
LANGUAGES = 2000
UNKNOWN = "und"


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams of one to three letters, word edges as blanks, with their counts."""
    found = []
    for k in range(0, len(text), PIECE):
        codes = np.frombuffer(text[k:k + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.concatenate(([0], np.where(is_letter[codes], codes, 0), [0]))
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]   # blanks count once
        two = codes[:-1] << 21 | codes[1:]
        three = codes[:-2] << 42 | two[1:]
        one = codes[1:-1]
        every = np.concatenate((one[one != 0], two, three[one != 0]))
        found.append(np.unique(every, return_counts=True))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return totals(np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found]))


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts of the task, combined before they are shuffled."""
    is_letter = letters()
    held: dict[str, list] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            g, n = totals(np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts]))
            yield pa.record_batch([pa.array([lang] * len(g)), pa.array(g), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = grams(text, is_letter)
            held.setdefault(lang, []).append(part)
            size += len(part[0])
            if size > 2_000_000:
                yield from out()
                size = 0
    yield from out()


def profiles(docs: DataFrame, top: int = 300, per_lang: int = 2000, text: str = "text", lang: str = "lang",
             key: str = "doc_id") -> DataFrame:
    """(lang, gram, rank): the ``top`` most frequent n-grams of each language, most frequent first, ties by n-gram.

    Learned from rows with a text and a language: from all of a language with up to ``per_lang`` rows, else from about
    that many, picked by a hash of ``key``.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("dice"))
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).select(
        F.col("lang").alias("name"), F.when(F.col("n") <= per_lang, 2.0).otherwise(per_lang / F.col("n")).alias("share"))
    known = share.limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not known:
        return docs.sparkSession.createDataFrame([], "lang string, gram long, rank int")
    names = [r.name for r in known]
    shares = F.create_map(*[F.lit(x) for r in known for x in (r.name, r.share)])
    picked = rows.where(F.col("lang").isin(names) & (F.pmod("dice", F.lit(1 << 20)) / (1 << 20) < shares[F.col("lang")]))
    counts = picked.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.select("lang", "gram", F.row_number().over(by).alias("rank")).where(F.col("rank") <= top)


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], known: np.ndarray, ranks: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """``ranks[l, g]``: rank of n-gram ``known[g]`` in language l, ``top`` + 1 where it has none."""
    is_letter = letters()
    for batch in batches:
        picked, scores = [], []
        for text in batch.column(1).to_pylist():
            g, n = grams(text or "", is_letter)
            if not (g < 1 << 21).any() or not langs or not (g[g < 1 << 21] > 0).any():
                picked.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = np.lexsort((g, -n))[:top]
            own, mine = np.arange(1, len(order) + 1), g[order]
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            theirs = ranks[:, at]
            gap = np.where((known[at] == mine) & (theirs <= top), np.abs(theirs - own), top)
            distance = gap.sum(axis=1) / (len(order) * top)
            best = int(distance.argmin())
            picked.append(langs[best])
            if len(langs) > 1:
                rest = float(np.delete(distance, best).min())
                both = rest + float(distance[best])
                scores.append(rest / both if both else 0.5)
            else:
                scores.append(max(0.0, 1.0 - float(distance[best])))
        yield pa.record_batch([batch.column(0), pa.array(picked), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, profile: DataFrame, top: int = 300, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) per row: the language whose profile is nearest to the ranks of the text's ``top`` most
    frequent n-grams, by summed out-of-place distance (an n-gram that a profile lacks counts ``top``).

    ``score`` is the runner-up's share of the two smallest distances: 0.5 for a tie, 1 for a perfect match. A null text,
    a text without letters, and any text if no language was learned give ``und`` and 0. Ties go to the first language by
    name; repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _judge(profile, top), f"doc_id {kind}, lang_pred string, score double")


def _judge(profile: DataFrame, top: int) -> Callable:
    rows = profile.collect()   # at most LANGUAGES * top rows
    langs = sorted({r.lang for r in rows})
    known = np.unique(np.array([r.gram for r in rows], np.int64))
    ranks = np.full((len(langs), len(known)), top + 1, np.int32)
    place = {name: i for i, name in enumerate(langs)}
    for r in rows:
        ranks[place[r.lang], np.searchsorted(known, r.gram)] = r["rank"]
    return partial(_predict, langs=langs, known=known, ranks=ranks, top=top)


def identified(docs: DataFrame, profile: DataFrame, top: int = 300, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``predict`` gives a language.

    Each row is judged by its own text, so rows that share an id or have none are told apart; no shuffle. Null and
    letterless texts go, and all rows if no language was learned; repeated rows stay; an empty table gives no rows.
    """
    good = verdict(_judge(profile, top), lambda part: pa.record_batch([part, part], ["doc_id", "text"]),
                   lambda found: pc.not_equal(found.column(1), UNKNOWN))
    return docs.where(good(text))

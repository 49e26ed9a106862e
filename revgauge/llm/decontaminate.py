"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import texts, verdict

#: Bytes of item texts in one automaton; a larger test set is scanned in several blocks.
BLOCK = 8 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
_WORD = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: A-Z become a-z, whatever is no word byte becomes a blank; every byte keeps its place.
NORMAL = bytes(b if (b := (c + 32 if 65 <= c <= 90 else c)) in _WORD else 32 for c in range(256))


def windows(items: list[tuple[str | None, str | None]], size: int) -> dict[str, tuple[int, set[str]]]:
    """Each window as the automaton reads it, with its number of words and the ids of its items."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = (text or "").encode().translate(NORMAL).split()
        for k in range(max(1, len(words) - size + 1) if words else 0):
            part = words[k:k + size]
            ids = found.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), set()))[1]
            if item is not None:
                ids.add(item)
    return found


def _scan(batches: Iterator[pa.RecordBatch], items: list, size: int) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, (n, ids) in windows(items, size).items():
        automaton.add_word(key, (len(key), n, sorted(ids)))
    automaton.make_automaton()
    search = automaton.iter if len(automaton) else None
    for batch in batches:
        before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        n_words, hits, names = [], [], []
        for text, (spans, ids) in zip(texts(batch, "text"), before, strict=True):
            plain = text.translate(NORMAL)
            words = plain.split()
            n_words.append(len(words))
            found = list(search(f" {b' '.join(words).decode('latin-1')} ")) if search and words else []
            if not found:
                hits.append(spans or [])
                names.append(ids or [])
                continue
            blank = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            begins = np.concatenate(([0], blank[:-1]))   # where each word's leading blank stands
            edge = np.diff(np.concatenate(([True], np.frombuffer(plain, np.uint8) == 32, [True])).astype(np.int8))
            starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            cover = np.zeros(len(words) + 1, np.int64)
            for s in spans or []:
                cover[s["first_word"]] += 1
                cover[s["first_word"] + s["n_words"]] -= 1
            got = set(ids or [])
            first = np.searchsorted(begins, [e - n + 1 for e, (n, _, _) in found])
            for k, (_, (_, n, own)) in zip(first.tolist(), found, strict=True):
                cover[k] += 1
                cover[k + n] -= 1
                got.update(own)
            hit = np.concatenate(([0], np.cumsum(cover[:-1]) > 0, [0])).astype(np.int8)
            a, b = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
            hits.append([{"start": int(starts[x]), "end": int(ends[y - 1]), "first_word": int(x), "n_words": int(y - x)}
                         for x, y in zip(a, b, strict=True)])
            names.append(sorted(got))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hits, SPANS), pa.array(names, pa.list_(pa.string())),
                               pa.array(n_words, pa.int64())], ["doc_id", "text", "spans", "items", "n_words"])


def _blocks(items: DataFrame) -> Iterator[list]:
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text or "")
        if held >= BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def passages(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", doc_id: str = "doc_id",
             item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, n_words, spans, items) per row: the stretches of words that lie in a window of ``size`` consecutive
    words of a test item, each with its byte offsets in the original text, and the ids (as sorted strings) of the items
    found.

    Both sides are normalised alike: A-Z lower-cased, words are runs of digits, letters and non-ASCII characters. An
    item of fewer words is one window, an item without words none. One scan of each text finds all windows of a block
    of items; the texts of a block are bounded in bytes, a larger test set is taken block by block in the same pass.
    Null texts have no words. Items with a null id count as hits without a name; repeated rows are kept (documents) or
    harmless (items); an empty table on either side gives no rows or no hits; other columns are ignored.
    """
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, text string, spans array<struct<start:long,end:long,first_word:long,n_words:long>>, " \
             "items array<string>, n_words long"
    found = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.lit(None).cast("array<struct<start:long,end:long,first_word:long,n_words:long>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"))
    slim = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    for block in [*_blocks(slim)] or [[]]:
        found = found.select("doc_id", "text", "spans", "items").mapInArrow(partial(_scan, items=block, size=size), schema)
    return found.select("doc_id", "n_words", "spans", "items")


def _unknown(part: pa.Array) -> pa.RecordBatch:
    nothing = pa.nulls(len(part))
    return pa.record_batch([part, part, nothing, nothing], ["doc_id", "text", "spans", "items"])


def clean(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", item_text: str = "text",
          item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text ``passages`` finds nothing.

    Each row is judged by its own text, so rows that share an id or have none are told apart; no shuffle. Null texts and
    repeated rows stay; no items leave all rows; an empty table gives no rows. Blocks of items are scanned in turn, each
    over the rows that are left.
    """
    slim = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    left = docs
    for block in _blocks(slim):
        found_nothing = verdict(partial(_scan, items=block, size=size), _unknown,
                                lambda found: pc.equal(pc.list_value_length(found.column(2)), 0))
        left = left.where(found_nothing(text))
    return left

"""Sequence packing: length combinations weighted by non-negative least squares, leftovers packed greedily."""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import texts

#: Tokens and documents that are packed together; a block fits a task many times over.
BLOCK_TOKENS, BLOCK_DOCS = 4 << 20, 8192
#: Length classes of a window, and the most pieces of one combination.
CLASSES, DEPTH = 64, 3
#: Share of every length class that is kept back to fill the gaps of the combinations.
FILLER = 0.06
#: Words whose ids a task remembers.
REMEMBERED = 400_000
#: A text without these characters splits at blanks as the tokenizer itself splits; any other text is encoded whole.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧]|<\\|")
#: Words that are letters and then marks: the two parts are encoded apart.
PARTS = "^(?P<letters>[a-zà-öø-ɏ]*)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
#: How a tokenizer must fold and split texts for its words to be encoded apart.
FOLDED = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Encoder:
    """Token ids of texts. Blank-separated words are encoded once and remembered; no merge crosses a blank.

    This holds for tokenizers that fold case and blanks and split as ``FOLDED`` and ``SPLIT`` say, which is read from the
    tokenizer's file; texts of any other tokenizer are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        setting = json.loads(self.tokenizer.to_str())
        suffix = setting["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix) and setting["normalizer"] == FOLDED and setting["pre_tokenizer"] == SPLIT and (
            setting["model"]["type"] == "BPE" and not setting["model"]["dropout"])
        # the model alone: it takes parts of words, in signs that stand for bytes, and closes each with the suffix
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]   # bytes that stand for themselves
        others = iter(range(256, 512))
        self.sign = {b: b if b in shown else next(others) for b in range(256)}
        self.sign[32] = 32   # parts are divided by it
        self.place: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start, self.length, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that are not empty, end to end, and how many each has."""
        text = parts.to_pylist()
        lines = [" ".join(text[a:a + 512]).encode().decode("latin-1").translate(self.sign) for a in range(0, len(text), 512)]
        ids = [np.array(e.ids, np.uint32) for e in self.parts.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(text):
            raise ValueError("the tokenizer does not close every part of a word")
        return flat, np.diff(ends, prepend=0)

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, end to end, and how many each has: those of its letters, then those of its marks."""
        found = pc.extract_regex(words, PARTS)
        odd = np.flatnonzero(np.asarray(found.is_null()))
        both = pa.concat_arrays([pc.fill_null(pc.struct_field(found, k), "") for k in (0, 1)])
        coded = both.dictionary_encode()
        known = np.asarray(pc.binary_length(coded.dictionary)) > 0
        flat, own = self._part_ids(coded.dictionary.filter(pa.array(known)))
        n = np.zeros(len(known), np.int64)
        n[known] = own
        first = np.cumsum(n) - n
        at = np.asarray(coded.indices).reshape(2, -1).T.ravel()
        whole = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words.take(pa.array(odd)).to_pylist()]
        # words that are not letters and marks have empty parts: their ids stand behind all others and are taken last
        length, begin = n[at].reshape(-1, 2), first[at].reshape(-1, 2)
        length[odd, 0] = [len(w) for w in whole]
        begin[odd, 0] = len(flat) + np.cumsum(length[odd, 0]) - length[odd, 0]
        flat = np.concatenate([flat, *(np.array(w, np.uint32) for w in whole)])
        return _spans(flat, begin.ravel(), length.ravel()), length.sum(axis=1)

    def _learn(self, words: pa.Array) -> np.ndarray:
        flat, length = self._word_ids(words)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[:self.used], np.zeros(len(self.pool) + len(flat), np.uint32)))
        self.pool[self.used:self.used + len(flat)] = flat
        at = np.arange(len(self.start), len(self.start) + len(words))
        self.place.update(zip(words.to_pylist(), at.tolist(), strict=True))
        self.start = np.concatenate((self.start, self.used + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))
        self.used += len(flat)
        return at

    def _forget(self) -> None:
        """Keeps the half of the words that was used most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:REMEMBERED // 2])
        words = list(self.place)
        self.place = {words[p]: i for i, p in enumerate(kept.tolist())}
        start, self.length, self.uses = self.start[kept], self.length[kept], self.uses[kept]
        self.pool = _spans(self.pool, start, self.length)
        self.used = len(self.pool)
        self.start = np.cumsum(self.length) - self.length

    def encode(self, documents: list[str]) -> list[np.ndarray]:
        plain = [self.by_word and not PLAIN.search(text) for text in documents]
        whole = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(documents, plain, strict=True) if not p],
                                                      add_special_tokens=False))
        if len(self.place) > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array([t.lower() for t, p in zip(documents, plain, strict=True) if p],
                                                   pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        place = np.fromiter(map(self.place.get, words.to_pylist(), itertools.repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = self._learn(words.take(pa.array(new)))
        indices = np.asarray(coded.indices)
        self.uses[place] += np.bincount(indices, minlength=len(words))
        at = place[indices]
        n = self.length[at]
        ids = _spans(self.pool, self.start[at], n)
        last = np.concatenate(([0], np.cumsum(n)))[np.cumsum(np.asarray(split.value_lengths()))].tolist()
        own = (ids[a:b] for a, b in zip([0, *last[:-1]], last))
        return [next(own) if p else np.array(next(whole).ids, np.uint32) for p in plain]


def _spans(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of a pool that begin at ``start``, end to end."""
    return pool[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per Python process: what one task learned about words serves the next."""
    return Encoder(path)


def combinations(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """One column for each way to fill a window exactly with up to ``depth`` pieces, counting the pieces of a class."""
    ways = [w for k in range(1, depth + 1) for w in itertools.combinations_with_replacement(range(1, classes + 1), k)
            if sum(w) == classes]
    out = np.zeros((classes + 1, len(ways)))
    for j, way in enumerate(ways):
        for c in way:
            out[c, j] += 1
    return out[1:]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes ``|a x - b|`` small: accelerated projected gradient steps."""
    gram, target = a.T @ a, a.T @ b
    step = 1.0 / np.linalg.norm(gram, 2)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0.0, y - step * (gram @ y - target))
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def plan(lengths: np.ndarray, window: int, ways: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents with the given lengths once.

    Whole windows are cut off first. The rest lengths are put in classes, rounded up; least squares give the number of
    times that each combination is used, rounded down to what is there. What is left is cut to fill the gaps, then
    packed end to end; the last, partly filled sequence is cut into powers of two, which need no padding.
    """
    out = [[(i, s, window)] for i, n in enumerate(lengths.tolist()) for s in range(0, n - window + 1, window)]
    rest = lengths % window
    unit = window // len(ways)
    order = np.argsort(rest, kind="stable")
    order = order[rest[order] > 0]
    kind = -(-rest[order] // unit)
    queues = {c: order[kind == c].tolist() for c in np.unique(kind).tolist()}
    there = np.zeros(len(ways))
    for c, q in queues.items():
        there[c - 1] = len(q)
    gaps: list[list] = []
    repeat = np.floor(nnls(ways, there * (1 - FILLER))).astype(int) if len(order) else np.zeros(0, int)
    for j in np.flatnonzero(repeat).tolist():
        need = [(c + 1, int(k)) for c, k in enumerate(ways[:, j]) if k]
        for _ in range(min([int(repeat[j]), *(len(queues.get(c, ())) // k for c, k in need)])):
            piece = [queues[c].pop() for c, k in need for _ in range(k)]
            gaps.append([(i, int(lengths[i] - rest[i]), int(rest[i])) for i in piece])
    left = [(i, int(lengths[i] - rest[i]), int(rest[i])) for c in sorted(queues) for i in queues[c]][::-1]
    for sequence in gaps:
        _fill(sequence, left, window)
    while left:
        gaps.append([])
        _fill(gaps[-1], left, window)
    out += gaps
    if out and (used := sum(n for _, _, n in out[-1])) < window:
        left = out.pop()[::-1]
        while used:
            size = 1 << used.bit_length() - 1
            out.append([])
            _fill(out[-1], left, size)
            used -= size
    return out


def _fill(sequence: list, left: list, window: int) -> None:
    """Moves tokens from the end of ``left`` into the sequence until it is full, cutting the last document."""
    room = window - sum(n for _, _, n in sequence)
    while room and left:
        i, s, n = left.pop()
        if n > room:
            left.append((i, s + room, n - room))
            n = room
        sequence.append((i, s, n))
        room -= n


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    known, ways = encoder(path), combinations()
    number = TaskContext.get().partitionId() << 40
    block: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        nonlocal number
        lengths = np.array([len(ids) for _, ids in block], np.int64)
        rows: list[tuple] = []
        for sequence in plan(lengths, window, ways):
            offset = 0
            for i, s, n in sequence:
                part = block[i][1][s:s + n]
                rows.append((block[i][0], s, n, zlib.crc32(part.astype("<u4").tobytes()), len(block[i][1]), number, offset,
                             part if with_ids else None))
                offset += n
            number += 1
        cols = list(zip(*rows, strict=True)) or [()] * 8
        arrays = [pa.array(cols[0], doc_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array([p.astype(np.int32) for p in cols[7]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(arrays, names)

    for batch in batches:
        doc_type = batch.schema.field(0).type
        docs, part, size = batch.column(0).to_pylist(), [], 0
        for k, text in enumerate(texts(batch, "text")):
            part.append(text.decode())
            size += len(text)
            if size >= 1 << 22 or k == len(docs) - 1:
                for i, ids in enumerate(known.encode(part), k + 1 - len(part)):
                    block.append((docs[i], np.append(ids, np.uint32(end)).astype(np.uint32)))
                    held += len(ids) + 1
                part, size = [], 0
                if held >= BLOCK_TOKENS or len(block) >= BLOCK_DOCS:
                    yield out()
                    block, held = [], 0
    if block:
        yield out()


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, text: str = "text", doc_id: str = "doc_id",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document's tokens are the tokenizer's ids without special tokens, then ``end``; a null text is empty and so has
    that one token. Every token lies in exactly one piece. Documents are tokenised and packed where they are read, in
    blocks of bounded size, so no text or token is shuffled; the histogram of a block's lengths is solved in its task.
    Only the last sequence of a block is not full: its tokens are cut into sequences whose lengths are powers of two.
    Ids need not be unique: pieces of a row follow from its place in the block. An empty table gives no rows; other
    columns are ignored. ``tokenizer`` is the path of a tokenizer file, readable wherever tasks run.
    """
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (
        ", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        partial(_pack, path=tokenizer, window=window, end=end, with_ids=with_ids), schema)

"""LM scoring by masked pseudo-likelihood with a bidirectional window network."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import shuffle_width, signed, stored, texts

#: Frequent words with a place of their own in the vocabulary; the first of them are classes of their own.
WORDS, HEADS, ENDINGS = 8192, 32, 64
#: Words on each side, numbers per word, hidden units.
SIDE, WIDTH, HIDDEN = 2, 16, 24
CLASSES = HEADS + ENDINGS
#: Every word of every text is masked with this chance in each pass over the corpus.
MASKED = 0.1
BATCH, RATE, PASSES = 2048, 0.15, 2
#: Distinct words that a counting task holds before it hands them on.
HELD = 300_000
SLICES = 32


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(held)
        n = pa.array([held[w] for w in words], pa.int64())
        ends = pa.array([ending(w) for w in words], pa.int32())
        held.clear()
        return pa.record_batch([pa.array(words, pa.binary()), ends, n], ["word", "ending", "n"])

    for batch in batches:
        for text in texts(batch, "text"):
            held.update(text.lower().split())
            if len(held) > HELD:
                yield out()
    yield out()


@dataclass
class Vocabulary:
    """Word places: frequent words, then one place per ending for all other words, then the edge of a text."""

    place: dict[bytes, int]
    classes: np.ndarray    # class of each place
    inner: np.ndarray      # log-probability of a place's word within its class; of a rare word, without its own count
    prior: np.ndarray      # log-probability of each class, where the network starts

    @property
    def edge(self) -> int:
        return len(self.classes)

    def ids(self, text: bytes) -> np.ndarray:
        get, base = self.place.get, len(self.place)
        found = [k if (k := get(w)) is not None else base + ending(w) for w in text.lower().split()]
        return np.array(found, np.int32)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) of every word of every text."""
    counted = docs.select("text").mapInArrow(_count, "word binary, ending int, n long")
    return stored(counted.groupBy("word", "ending").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The driver gets the ``WORDS`` most frequent words and sums per ending."""
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    sums = {r.ending: r.n for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect()}
    place = {bytes(r.word): i for i, r in enumerate(top)}
    classes = np.array([i if i < HEADS else HEADS + r.ending for i, r in enumerate(top)] + [HEADS + k for k in range(ENDINGS)], np.int64)
    n = np.array([r.n for r in top] + [0] * ENDINGS, float)
    mass = np.zeros(ENDINGS)
    for r in top:
        mass[r.ending] += r.n
    for k, total in sums.items():
        n[len(top) + k] = total - mass[k]
    n[len(top):] = np.maximum(n[len(top):], 0.5)
    total = np.bincount(classes, n, CLASSES)
    share = np.log(n) - np.log(total[classes])
    share[len(top):] = -np.log(total[HEADS:])
    return Vocabulary(place, classes, share, np.log(np.maximum(total, 0.5) / max(1.0, total.sum())))


class Network:
    """Words around a place -> tanh layer -> softmax over classes."""

    SHAPES = {"words": (0, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "inner_bias": (HIDDEN,), "outer": (HIDDEN, CLASSES),
              "outer_bias": (CLASSES,)}

    def __init__(self, places: int, flat: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(11)
        self.parts, at = {}, 0
        for name, shape in self.SHAPES.items():
            shape = (places, *shape[1:]) if name == "words" else shape
            size = int(np.prod(shape))
            if flat is not None:
                self.parts[name] = flat[at:at + size].reshape(shape).astype(np.float32)
            else:
                scale = 0.0 if "bias" in name else 0.1 if name == "words" else 1 / np.sqrt(shape[0])
                self.parts[name] = (rng.standard_normal(shape) * scale).astype(np.float32)
            at += size
        self.seen = {name: np.full(p.shape, 1e-2, np.float32) for name, p in self.parts.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input, hidden values, and log-probabilities of the classes, for rows of surrounding places."""
        x = self.parts["words"][around].reshape(len(around), -1)
        hidden = np.tanh(x @ self.parts["inner"] + self.parts["inner_bias"])
        out = hidden @ self.parts["outer"] + self.parts["outer_bias"]
        out -= out.max(axis=1, keepdims=True)
        return x, hidden, out - np.log(np.exp(out).sum(axis=1, keepdims=True))

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        """One adaptive gradient step on the mean log-probability of the masked classes."""
        x, hidden, out = self.forward(around)
        error = np.exp(out)
        error[np.arange(len(target)), target] -= 1.0
        error /= len(target)
        back = (error @ self.parts["outer"].T) * (1 - hidden**2)
        grads = {"outer": hidden.T @ error, "outer_bias": error.sum(axis=0), "inner": x.T @ back, "inner_bias": back.sum(axis=0)}
        for name, g in grads.items():
            self._move(name, slice(None), g)
        spread = (back @ self.parts["inner"].T).reshape(-1, WIDTH)
        rows, at = np.unique(around.ravel(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(rows)))
        self._move("words", rows, np.add.reduceat(spread[order], starts, axis=0))

    def _move(self, name: str, rows, g: np.ndarray) -> None:
        self.seen[name][rows] += g * g
        self.parts[name][rows] -= RATE * g / np.sqrt(self.seen[name][rows])


def _laid_out(found: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with edges between them, and where their words stand."""
    pad = np.full(SIDE, edge, np.int32)
    parts, where, at = [pad], [], SIDE
    for ids in found:
        parts += [ids, pad]
        where.append(np.arange(at, at + len(ids)))
        at += len(ids) + SIDE
    return np.concatenate(parts), np.concatenate(where) if where else np.zeros(0, np.int64)


def _around(laid: np.ndarray, where: np.ndarray) -> np.ndarray:
    steps = np.array([k for k in range(-SIDE, SIDE + 1) if k])
    return laid[where[:, None] + steps]


def _train(batches: Iterator[pa.RecordBatch], words: Vocabulary, start: np.ndarray | None, number: int) -> Iterator[pa.RecordBatch]:
    """(slice, part, n, weights): the weights of a network trained on the task's texts, in slices."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    net, rng, n = Network(words.edge + 1, start), np.random.default_rng((number, part)), 0
    if start is None:
        net.parts["outer_bias"][:] = words.prior
    rest: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(least: int) -> None:
        nonlocal rest, n
        if sum(len(t) for _, t in rest) < max(1, least):
            return
        around, target = (np.concatenate([r[k] for r in rest]) for k in (0, 1))
        full = len(target) if not least else len(target) // BATCH * BATCH
        for k in range(0, full, BATCH):
            net.step(around[k:k + BATCH], target[k:k + BATCH])
        n += full
        rest = [(around[full:], target[full:])]

    for batch in batches:
        for group in _groups(texts(batch, "text")):
            laid, where = _laid_out([words.ids(t) for t in group], words.edge)
            where = where[rng.random(len(where)) < MASKED]
            rest.append((_around(laid, where), words.classes[laid[where]]))
            learn(BATCH)
    learn(0)
    for k, weights in enumerate(np.array_split(net.flat(), SLICES)):
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()),
                               pa.array([weights.astype(np.float32)], pa.list_(pa.float32()))], ["slice", "part", "n", "weights"])


def _groups(found: Iterator[bytes], size: int = 1 << 19) -> Iterator[list[bytes]]:
    group, held = [], 0
    for text in found:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slice, part): the mean weights of each slice, by the number of words learned from."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, n, weights in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            own = sums.setdefault(k, [0, 0.0])
            own[0] += n
            own[1] = own[1] + n * weights.values.to_numpy().astype(float)
    for k, (n, total) in sums.items():
        mean = total / n if n else None
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([mean], pa.list_(pa.float64()))], ["slice", "weights"])


def train(docs: DataFrame, words: Vocabulary, passes: int = PASSES) -> np.ndarray:
    """Weights learned from masked words of all texts: in each pass every task trains on its texts from the common
    weights, and the results are averaged slice by slice. A slice's rows are streamed; the driver gets one network."""
    start = None
    for number in range(passes):
        learned = docs.select("text").mapInArrow(
            partial(_train, words=words, start=start, number=number), "slice int, part int, n long, weights array<float>")
        ordered = learned.repartition(min(SLICES, shuffle_width(docs.sparkSession)), "slice").sortWithinPartitions("slice", "part")
        rows = {r["slice"]: r.weights for r in ordered.mapInArrow(_average, "slice int, weights array<double>").collect()}
        if len(rows) < SLICES or any(w is None for w in rows.values()):
            break    # no word anywhere
        start = np.concatenate([np.array(rows[k], np.float32) for k in range(SLICES)])
    return Network(words.edge + 1, start).flat()


def _rare(batches: Iterator[pa.RecordBatch], place: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(key, word, times): how often each text, named by its digest, holds each word that has no place of its own."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        keys, words, times, sizes = [], [], [], []
        for text in texts(batch, "text"):
            own = Counter(w for w in text.lower().split() if w not in place)
            keys.append(xxh3_64_intdigest(text))
            sizes.append(len(own))
            words += [xxh3_64_intdigest(w) for w in own]
            times += own.values()
        yield pa.record_batch([pa.array(signed(np.repeat(np.array(keys, np.uint64), sizes))), pa.array(signed(np.array(words, np.uint64))),
                               pa.array(times, pa.int32())], ["key", "word", "times"])


def _named(batches: Iterator[pa.RecordBatch], place: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(word, log_n): the digest and the log of the count of each word that has no place of its own."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        rows = [(xxh3_64_intdigest(w), n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in place]
        words, n = np.array([w for w, _ in rows], np.uint64), np.array([n for _, n in rows], float)
        yield pa.record_batch([pa.array(signed(words)), pa.array(np.log(n))], ["word", "log_n"])


def rare_shares(docs: DataFrame, counts: DataFrame, words: Vocabulary) -> DataFrame:
    """(key, rare): the mean log count of a text's words without a place of their own. Equal texts have one row: the
    copies weigh both sums alike. Words and texts meet by 64-bit digests; no word is frequent among these."""
    held = docs.select("text").mapInArrow(partial(_rare, place=words.place), "key long, word long, times int")
    named = counts.select("word", "n").mapInArrow(partial(_named, place=words.place), "word long, log_n double")
    met = held.join(named.hint("shuffle_merge"), "word")
    return met.groupBy("key").agg((F.sum(F.col("times") * F.col("log_n")) / F.sum("times")).alias("rare"))


def _score(batches: Iterator[pa.RecordBatch], words: Vocabulary, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, log_prob, key, n_rare); ``log_prob`` lacks the log counts of the ``n_rare`` rare words."""
    from xxhash import xxh3_64_intdigest

    net = Network(words.edge + 1, weights)
    for batch in batches:
        n, total, n_rare = [], [], []
        keys = np.array([xxh3_64_intdigest(t) for t in texts(batch, "text")], np.uint64)
        for group in _groups(texts(batch, "text")):
            ids = [words.ids(t) for t in group]
            laid, where = _laid_out(ids, words.edge)
            logs = np.zeros(len(where))
            for k in range(0, len(where), BATCH):
                at = where[k:k + BATCH]
                own = laid[at]
                out = net.forward(_around(laid, at))[2]
                logs[k:k + BATCH] = out[np.arange(len(at)), words.classes[own]] + words.inner[own]
            sizes = np.array([len(i) for i in ids])
            ends = np.cumsum(sizes)
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            n += sizes.tolist()
            total += (sums[ends] - sums[ends - sizes]).tolist()
            n_rare += [int((i >= len(words.place)).sum()) for i in ids]
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(signed(keys)),
                               pa.array(n_rare, pa.int64())], ["doc_id", "n_words", "log_prob", "key", "n_rare"])


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", passes: int = PASSES) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob, pseudo_perplexity) per row.

    A word's conditional log-probability given ``SIDE`` words on each side is the network's for the word's class plus
    the word's share of its class in the corpus, by the word's own count; their sum scores the document. Words are
    blank-separated, A-Z lower-cased. The vocabulary counts all words of all documents, training masks words of every document, and scoring
    covers every word. A null or empty text has 0 words, log-probability 0 and a null mean; repeated rows count and are
    scored alike; an empty table gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = word_counts(slim)
    words = vocabulary(counts)
    weights = train(slim, words, passes)
    scored = slim.mapInArrow(partial(_score, words=words, weights=weights),
                             f"doc_id {dict(slim.dtypes)['doc_id']}, n_words long, log_prob double, key long, n_rare long")
    rare = F.when(F.col("n_rare") > 0, F.col("n_rare") * F.col("rare")).otherwise(0.0)
    scored = scored.join(rare_shares(slim, counts, words), "key", "left").select(
        "doc_id", "n_words", (F.col("log_prob") + rare).alias("log_prob"))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return scored.withColumn("mean_log_prob", mean).withColumn("pseudo_perplexity", F.exp(-mean))

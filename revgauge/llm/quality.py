"""Quality classifier: regularised quadratic discriminant on transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import stored, texts

NAMES = ("words", "word_length", "word_spread", "distinct", "distinct_pairs", "top_word", "upper", "digits", "symbols",
         "stops", "line_length", "repeated_lines", "entropy")
#: What is added to a share before its logarithm is taken.
LEAST = 1e-3
#: Words of a text whose statistics count half.
SHORT = 25


def statistics(text: bytes) -> list[float]:
    """One text's statistics, on scales that are roughly normal for ordinary texts. Empty texts give finite values."""
    words = text.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, int(counts.sum()))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum()) + int(counts[128:].sum())
    stops = int(counts[[33, 44, 46, 58, 59, 63]].sum())
    digits, blanks = int(counts[48:58].sum()), int(counts[[32, 9, 10, 11, 12, 13]].sum())
    symbols = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) - stops
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    often = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = counts[counts > 0] / size

    def share(x: float, of: float) -> float:
        return float(np.log(x / max(1.0, of) + LEAST))

    return [
        float(np.log1p(len(words))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        len(often) / n**0.9, share(n - len(set(zip(words, words[1:]))) - 1 if words else 0, n),
        share(max(often.values(), default=0), n + 20.0), share(upper, upper + lower), share(digits, size), share(symbols, size),
        share(stops, size), float(np.log1p((size - blanks) / max(1, len(lines)))),
        share(len(lines) - len(set(lines)), len(lines)), float(-(p * np.log2(p)).sum()) if len(p) else 0.0]


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, x array<double>) per row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in texts(batch, "text")]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch], d: int, scale: Scale | None) -> Iterator[pa.RecordBatch]:
    """(label, at, value): of each label the number of rows, sums and products of a task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        x = np.concatenate((np.ones((len(label), 1)), x if scale is None else scale.apply(x)), axis=1)
        for k in np.unique(label).tolist():
            own = x[label == k]
            sums[k] = sums.get(k, 0.0) + own.T @ own
    for k, s in sums.items():
        n = s.size
        yield pa.record_batch([pa.array(np.full(n, k, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(s.ravel())],
                              ["label", "at", "value"])


class Scale:
    """Statistics as deviations from the mean of the labelled rows. The deviations of a text of n words count
    n / (n + ``SHORT``): a few words say little, and a short text is not a bad one."""

    def __init__(self, sums: dict[int, np.ndarray]) -> None:
        every = sum(sums.values())
        n = every[0, 0]
        self.mean = every[0, 1:] / n
        self.scale = np.sqrt(np.maximum(np.diag(every)[1:] / n - self.mean**2, 1e-6))

    def apply(self, x: np.ndarray) -> np.ndarray:
        n = np.expm1(x[:, :1])
        z = (x - self.mean) / self.scale * (n / (n + SHORT))
        z[:, 0] = (np.maximum(x[:, 0], np.log1p(2 * SHORT)) - self.mean[0]) / self.scale[0]
        return z


class Discriminant:
    """Two normal densities with shrunken covariances, kept as inverse Cholesky factors."""

    def __init__(self, sums: dict[int, np.ndarray], scale: Scale | None, shrink: float, pool: float) -> None:
        self.ready = all(k in sums and sums[k][0, 0] >= 2 for k in (0, 1))
        if not self.ready:
            self.only = 1.0 if 1 in sums and 0 not in sums else 0.0 if 0 in sums and 1 not in sums else 0.5
            return
        self.scale = scale
        every = sums[0] + sums[1]
        d = len(every) - 1
        inside, self.centre, self.factor, self.offset = [], [], [], []
        for k in (0, 1):
            n, m = sums[k][0, 0], sums[k][0, 1:] / sums[k][0, 0]
            inside.append(sums[k][1:, 1:] / n - np.outer(m, m))
            self.centre.append(m)
        weight = np.array([sums[k][0, 0] for k in (0, 1)]) / every[0, 0]
        shared = weight[0] * inside[0] + weight[1] * inside[1]
        for k in (0, 1):
            cov = (1 - pool) * inside[k] + pool * shared
            cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            lower = np.linalg.cholesky(cov)
            self.factor.append(np.linalg.inv(lower))
            self.offset.append(np.log(weight[k]) - np.log(np.diag(lower)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.only)
        z = self.scale.apply(x)
        density = [self.offset[k] - 0.5 * (((z - self.centre[k]) @ self.factor[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(rows: DataFrame, shrink: float = 0.05, pool: float = 0.05) -> Discriminant:
    """Learns from all rows (label 0 or 1, x array<double>); only sums of products reach the driver.

    Each class covariance is drawn towards the common one by ``pool`` and towards a round one by ``shrink``. Rows with
    another or no label are ignored. Without both classes every score is 1, 0 (the only class seen) or 0.5 (none).
    """
    d = len(NAMES)
    used = rows.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), "x")

    def gather(scale: Scale | None) -> dict[int, np.ndarray]:
        parts = used.mapInArrow(partial(_moments, d=d, scale=scale), "label int, at int, value double")
        sums: dict[int, np.ndarray] = {}
        for r in parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():   # 2 * (d + 1) ** 2 rows
            sums.setdefault(r.label, np.zeros((d + 1) ** 2))[r["at"]] = r.value
        return {k: s.reshape(d + 1, d + 1) for k, s in sums.items()}

    sums = gather(None)
    if len(sums) < 2:
        return Discriminant(sums, None, shrink, pool)
    scale = Scale(sums)
    return Discriminant(gather(scale), scale, shrink, pool)


def classify(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7, text: str = "text", doc_id: str = "doc_id",
             label: str = "quality", shrink: float = 0.05, pool: float = 0.05) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document.

    ``held_out`` is a boolean expression on ``doc_id``; labels of such rows are not learned from. Documents without a
    label, with a null text or id are scored too; a label that repeats counts each time; tables may be empty.
    """
    found = stored(features(docs, text, doc_id), "statistics")
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("label is not null")
    model = fit(found.where(~held_out).join(known, "doc_id").select("label", "x"), shrink, pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.record_batch([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

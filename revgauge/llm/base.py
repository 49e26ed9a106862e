"""Shared helpers of the training-data operators: table reading, scratch tables, Arrow text batches, byte hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgauge.session import scratch_dir


#: Spark's setting that removes the shuffle files of a query at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: it is computed once and outlives its executors.

    The shuffle files of the write go when it ends, not when the driver next collects garbage."""
    path, conf = scratch_dir(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: str = "doc_id"):
    """crc32 of the id written as text, modulo 4; 2 marks held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def salted_join(rows: DataFrame, small: DataFrame, key: str, by: str, salts: int = 8) -> DataFrame:
    """Inner join on ``key`` of which ``small`` has one row each: the rows of a key meet it in up to ``salts`` tasks,
    dealt out by a hash of column ``by``."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def byte_columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and the offset at which each row starts (null: empty)."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """Each row's text as bytes (null: empty)."""
    flat, at = byte_columns(batch, name)
    data = flat.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b]


def verdict(judge: Callable, ask: Callable, keep: Callable):
    """A boolean column function of a text: ``judge`` answers each batch that ``ask`` makes of an array of texts with one
    batch of findings, and ``keep`` turns these into booleans. Rows wait in the JVM; only texts go to Python."""
    @F.arrow_udf("boolean")
    def good(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in judge(ask(part) for part in parts):
            yield keep(found)

    return good


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class SpanHash:
    """64-bit names of byte spans from one pass over the bytes: equal spans have equal names wherever they lie.

    A span's name is the scrambled polynomial of its bytes, each byte replaced by a random odd number.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, longest: int) -> None:
        rng = np.random.default_rng(20240229)
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        self.up = self._powers(self.BASE, longest)
        self.down = self._powers(pow(self.BASE, -1, 2**64), longest)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        return np.cumprod(powers, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:len(data)], out=out[1:])
        return out

    def name(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

"""An append store of keyed rows: runs of files with an index, merged level by level.

A run is one sorted set of files with rows in the order of a hash of their key; beside it lies its index: of each file the
range of hashes and a Bloom filter of them. A batch of keys opens only files that may hold one. When a level has as many
runs as the fan-out, they are merged into one of the next level, so the number of runs grows with the logarithm of the
number of batches. The manifest lists the runs that count; a new version of it is one new file, which is there or not:
whatever a crash leaves behind before that is not listed, and ``vacuum`` removes it. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revgauge.session import is_absent, scratch_dir

#: Bits per key of a filter, and hashes per key: about 1 in 120 keys that are not there seems to be.
BITS, HASHES = 10, 7
#: Parts in which the keys of a batch meet a file's filter.
SALTS = 8
MANIFEST = "version long, batch long, run string, level int, n_rows long"


def _spots(h: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash in a filter of ``size`` bits."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(size)).astype(np.int64)


def _describe(table: pa.Table) -> pa.Table:
    """One file's index row from the hashes of its keys."""
    h = table.column("h").to_numpy()
    bits = np.zeros(max(64, -(-BITS * len(h) // 8) * 8), bool)
    bits[_spots(h, len(bits)).ravel()] = True
    return pa.table({"file": table.column("file")[:1], "least": [int(h.min())], "most": [int(h.max())], "n": [len(h)],
                     "bloom": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file): files whose filter, which comes first of its part, has one of the hashes that follow."""
    file, bits, hit = None, None, False
    for batch in batches:
        filters = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([0, *filters], [*filters, batch.num_rows], strict=True):
            rows = batch.slice(a, b - a)
            if b > a and rows.column(2)[0].is_valid:
                file, hit = rows.column(0)[0].as_py(), False
                bits, rows = np.frombuffer(rows.column(2)[0].as_py(), np.uint8), rows.slice(1)
            if rows.num_rows and not hit:
                spots = _spots(rows.column(3).to_numpy(), 8 * len(bits))
                hit = bool((bits[spots >> 3] >> (7 - (spots & 7)) & 1).all(axis=1).any())
                if hit:
                    yield pa.record_batch([pa.array([file])], ["file"])


class KeyedStore:
    """``key`` names the key's column. With ``newest`` a key may come again, and the row with the largest value there
    counts; without it keys are written once."""

    def __init__(self, spark: SparkSession, root: str, key: str, newest: str | None = None, fanout: int = 4,
                 rows_per_file: int = 1_000_000) -> None:
        self.spark, self.root, self.key, self.newest = spark, root.rstrip("/"), key, newest
        self.fanout, self.rows_per_file = fanout, rows_per_file

    # files

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, path: str) -> None:
        files, path = self._path(path)
        files.delete(path, True)

    def _folders(self, path: str) -> list[str]:
        files, path = self._path(path)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    # manifest

    def manifest(self) -> list:
        """The rows of the newest version: few, since runs are merged. Empty before the first batch."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").collect()
        except AnalysisException as e:
            if not is_absent(e):
                raise
            return []
        newest = max(r.version for r in rows)
        return [r for r in rows if r.version == newest]

    def _swap(self, old: list, runs: list[tuple[str, int, int]], batch: int) -> None:
        """Make ``runs`` (run, level, n_rows) the store's content in place of the manifest ``old``."""
        version = old[0].version + 1 if old else 0
        rows = [(version, batch, *r) for r in runs] or [(version, batch, None, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _runs(self, manifest: list | None = None) -> list[tuple[str, int, int]]:
        return [(r.run, r.level, r.n_rows) for r in (self.manifest() if manifest is None else manifest) if r.run]

    def last_batch(self) -> int:
        rows = self.manifest()
        return rows[0].batch if rows else -1

    # reading

    def _read(self, what: str, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/runs/{r}/{what}" for r in runs])

    def rows(self) -> DataFrame | None:
        """The store's rows; None while there are none."""
        runs = [r for r, _, n in self._runs() if n]
        return self._latest(self._read("data", runs).drop("_h"), len(runs)) if runs else None

    def _latest(self, rows: DataFrame, runs: int = 2) -> DataFrame:
        if self.newest is None or runs < 2:
            return rows
        order = Window.partitionBy(self.key).orderBy(F.desc(self.newest))
        return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

    def files_for(self, keys: DataFrame) -> list[str]:
        """The files that may hold one of the keys: by range of hashes, then by filter.

        Every key meets at most one file of a run by range. A filter travels to the tasks of its file, the keys of a file
        in ``SALTS`` parts; paths alone reach the driver.
        """
        runs = [r for r, _, n in self._runs() if n]
        if not runs:
            return []
        index = self._read("index", runs)
        byte = lambda c: F.shiftright(c, 56)
        asked = keys.select(F.xxhash64(self.key).alias("h")).distinct().withColumn("byte", byte("h"))
        ranges = index.select("file", "least", "most", F.explode(F.sequence(byte("least"), byte("most"))).alias("byte"))
        near = asked.join(ranges, "byte").where("h between least and most")
        met = near.select("file", F.pmod("h", F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("bloom"), "h")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        filters = index.select("file", salts.alias("salt"), "bloom", F.lit(None).cast("long").alias("h"))
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = met.unionByName(filters).repartition(width, "file", "salt").sortWithinPartitions("file", "salt", F.col("bloom").isNull())
        return [r.file for r in both.mapInArrow(_hits, "file string").distinct().collect()]

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch whose key is not stored; opens only files that may hold one."""
        files = self.files_for(batch)
        if not files:
            return batch
        return batch.join(self.spark.read.parquet(*files).select(self.key), self.key, "left_anti")

    # writing

    def _write(self, rows: DataFrame, n: int) -> str:
        run = uuid.uuid4().hex
        parts = max(1, -(-n // self.rows_per_file))
        placed = rows.withColumn("_h", F.xxhash64(self.key))
        placed.repartitionByRange(parts, "_h").sortWithinPartitions("_h").write.parquet(f"{self.root}/runs/{run}/data")
        keys = self.spark.read.parquet(f"{self.root}/runs/{run}/data").select(
            F.col("_metadata.file_path").alias("file"), F.col("_h").alias("h"))
        keys.groupBy("file").applyInArrow(_describe, "file string, least long, most long, n long, bloom binary").write.parquet(
            f"{self.root}/runs/{run}/index")
        return run

    def append(self, rows: DataFrame, batch: int | None = None) -> None:
        """Add rows as a run of their own, then merge levels that are full. Without ``newest`` the rows must be new.

        ``batch`` numbers a micro-batch; one that is not above the last stored is there already and changes nothing.
        """
        old = self.manifest()
        last = old[0].batch if old else -1
        if batch is not None and batch <= last:
            return
        held = scratch_dir(self.spark, "batch")
        rows.write.parquet(held)   # computed once
        fresh = self.spark.read.schema(rows.schema).parquet(held)
        n = fresh.count()
        runs = self._runs(old)
        self._swap(old, [*runs, (self._write(fresh, n), 0, n)] if n else runs, last + 1 if batch is None else batch)
        self._delete(held)
        self.merge()

    def merge(self) -> None:
        """Merge every level that holds ``fanout`` runs into one run of the next, and remove what no longer counts."""
        merged = False
        while True:
            old = self.manifest()
            runs = self._runs(old)
            levels = [level for _, level, _ in runs]
            full = min((x for x in set(levels) if levels.count(x) >= self.fanout), default=None)
            if full is None:
                break
            part = [r for r in runs if r[1] == full]
            rows = self._latest(self._read("data", [r for r, *_ in part]).drop("_h"))
            n = sum(r[2] for r in part) if self.newest is None else rows.count()
            self._swap(old, [r for r in runs if r[1] != full] + [(self._write(rows, n), full + 1, n)], old[0].batch)
            merged = True
        if merged:
            self.vacuum()

    def prune(self, snapshot: DataFrame) -> None:
        """Keep stored rows whose key the snapshot still holds; runs that lose nothing stay as they are."""
        old = self.manifest()
        runs, kept = self._runs(old), []
        for run, level, n in runs:
            rows = self._read("data", [run]).drop("_h")
            left = rows.join(snapshot.select(self.key), self.key, "left_semi")
            m = left.count()
            if m == n:
                kept.append((run, level, n))
            elif m:
                kept.append((self._write(left, m), level, m))
        if kept != runs:
            self._swap(old, kept, old[0].batch)
            self.vacuum()

    def vacuum(self) -> None:
        """Remove runs and manifest files that the newest version does not need; readers of an older one must be done."""
        live = {r for r, *_ in self._runs()}
        for run in self._folders(f"{self.root}/runs"):
            if run not in live:
                self._delete(f"{self.root}/runs/{run}")
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").select("version", F.col("_metadata.file_path").alias("f"))
        versions = rows.collect()
        newest = max(r.version for r in versions)
        for f in {r.f for r in versions if r.version < newest}:
            self._delete(f)

"""Session set-up and scratch storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []   # the folder of a local session without a setting


def local_session(app: str = "revgauge", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # vectors are averaged by object aggregation; by default it sorts all rows once a task has met 128 entities.
        # 8,192 running sums of 384 doubles are 25 MB a task
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "8192")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path for a table that cuts lineage or feeds a later read.

    The folder lies in the shared directory named by ``spark.checkpoint.dir``. Only a session that is one process and
    names none gets a folder of its own, one for the process, which is removed when it ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="revgauge-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = _OWN[0]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def via_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: later uses neither recompute it nor lose it with an
    executor."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_absent(error: AnalysisException) -> bool:
    """Whether a read failed because there is nothing at the path; any other failure must be raised."""
    return (error.getCondition() or "").split(".")[0] in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def spread(source: DataFrame, key: str) -> DataFrame:
    """Spread a source table that comes in fewer pieces than there are cores (one small or unsplittable file) before
    work that is heavy per row. Large tables have more pieces than cores and pass unchanged, without a shuffle."""
    cores = source.sparkSession.sparkContext.defaultParallelism
    return source.repartition(cores, key) if source.rdd.getNumPartitions() < cores else source


#: Characters of text in a piece whose words or n-grams one task counts.
PIECE = 1 << 25


def in_pieces(source: DataFrame, key: str, length: str) -> DataFrame:
    """Deal a source table of texts out by ``key`` in pieces of some ``PIECE`` characters, for work whose memory grows with the
    text of a task. A join by ``key`` that follows keeps the pieces and shuffles no text again. Column ``length`` is read to
    count the pieces only. Small tables are spread."""
    pieces = -(-(source.agg(F.sum(length)).first()[0] or 0) // PIECE)
    if pieces <= source.sparkSession.sparkContext.defaultParallelism:
        return spread(source, key)
    return source.repartition(int(pieces), key)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small (queries, group codes) on the driver; more than ``limit`` is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows

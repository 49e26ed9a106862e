"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage works on all that its predecessor kept; ``run`` writes each stage and reads it again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgauge.llm import decontaminate, langid, packing, simhash, suffix
from revgauge.llm.base import crc_mod, stored, table
from revgauge.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: null texts and texts without a letter. Each row is judged by
    its own text, also where ids repeat or are null."""
    return langid.identified(docs, stored(langid.profiles(docs.where(crc_mod() != 2)), "profiles"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one with the smallest doc_id, rows without an id last; of
    rows that share an id one by a hash of the text."""
    return simhash.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte covered by a 100-byte string that starts earlier in the corpus out of the texts; a character of
    which a part is cut goes as a whole. Documents of which nothing is left go.

    Texts are ordered by doc_id. Rows that share one come after all others, each a text of its own, ordered by id and a
    hash of the text; rows without an id are neither compared nor cut."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    shared = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if not shared.isEmpty():
        rows = stored(_own_ids(rows, shared.select("id")), "rows")
    cut = suffix.repeated_spans(rows, doc_id="id", as_text=True).where(F.size("spans") > 0).select(F.col("doc_id").alias("id"), "kept")
    left = rows.select("row", "id").join(cut, "id", "left").where("kept is null or length(trim(kept)) > 0")
    row = F.col("row")
    text = F.coalesce("kept", row["text"])
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def _own_ids(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with a new id, above all others, for each row whose id is among ``shared``."""
    last = rows.agg(F.max("id").alias("last")).scalar()
    h = F.xxhash64("text")
    late = rows.join(shared, "id", "left_semi").repartitionByRange("id", h).sortWithinPartitions("id", h)
    late = late.withColumn("id", last + 1 + F.monotonically_increasing_id())
    return rows.join(shared, "id", "left_anti").unionByName(late)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a test item. Each row is judged by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; one row per piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_array_dedup", repeated_passages),
          ("decontamination", decontamination), ("packing", sequences)]
#: Rank profiles, fingerprints and tokens cannot be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Registered queries of the training-data operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgauge.llm import decontaminate, html, langid, lm, orderhash, outliers, packing, quality, sentences, simhash, spelling, suffix, whitening
from revgauge.llm.base import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, d: str) -> DataFrame:
    found = suffix.repeated_spans(table(spark, d, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op2_benchmark_decontamination", f"""
  WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
        FROM benchmark),
  win AS (SELECT DISTINCT item, list_slice(w, i, i + least(10, len(w)) - 1) AS w
          FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT len(w) AS n FROM win),
  runs AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS w
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
  hits AS (SELECT r.doc_id, r.i, r.n, v.item FROM runs r JOIN win v ON r.w = v.w),
  words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hits) GROUP BY 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op2(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.passages(table(spark, d, "documents"), table(spark, d, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n_words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_packing")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), tokenizer_path())


@query("op10_language_id")
def op10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    learned = langid.profiles(docs.where(crc_mod() != 2))
    return langid.predict(docs, learned).select(
        "doc_id", (crc_mod() == 2).alias("held_out"), "lang_pred", "score")


@query("op6_robust_outliers")
def op6(spark: SparkSession, d: str) -> DataFrame:
    found = outliers.quality_rules(table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.round("d2", 6).alias("distance2"))


@query("op7_quality_discriminant")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"), crc_mod() == 2)


@query("op4_sentence_spans")
def op4(spark: SparkSession, d: str) -> DataFrame:
    found = sentences.drop_repeated_spans(table(spark, d, "documents"))
    return found.select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"),
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "kept")


@query("op9_html_main_text")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return html.main_text(table(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op1_lm_scoring")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return lm.score(table(spark, d, "documents"))


@query("op11_order_minhash")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return orderhash.fingerprints(table(spark, d, "documents"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return spelling.group_variants(table(spark, d, "documents"), rewrite=spelling.planted)


@query("op13_embedding_whitening")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))

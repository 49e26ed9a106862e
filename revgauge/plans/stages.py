"""The batch stages, from raw export to entity scores. Each takes and returns DataFrames; ``run_all`` stores the
tables between them so that no stage recomputes an earlier one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import text
from revgauge.functions.binding import settled
from revgauge.operators import corpus, dedup, encode, filters, intake, lexical, rollup, scoring
from revgauge.operators.groups import hash_group_assignment, real_groups
from revgauge.sources.artifacts import write_artifacts
from revgauge.sources.reviews import raw_file_meta, read_reviews_csv


def standard_stage(raw: DataFrame, excluded: DataFrame | Sequence[str] = ()) -> DataFrame:
    """Standard columns, test entities dropped; the quality reports are taken here."""
    rows = intake.standardize_reviews(raw)
    if "ID" in rows.columns:
        rows = rows.withColumn("review_id", F.col("ID").try_cast("bigint"))
    if isinstance(excluded, DataFrame) or len(excluded):
        rows = filters.exclude_entities(rows, excluded)
    return rows


def clean_stage(standard: DataFrame) -> DataFrame:
    """Clean text with its lengths and token counts; near-empty reviews dropped."""
    cleaned = settled(standard, "review_text_clean", text.clean_text("review_text_raw"))
    cleaned = filters.min_text_length(cleaned)
    return intake.length_features(cleaned).drop("word_len")


def prepared_stage(clean: DataFrame) -> DataFrame:
    """Rows to encode: recent, distinct, decoded, prompts stripped, long enough, with their number of words and hash."""
    rows = dedup.drop_exact_duplicates(filters.date_floor(clean))
    body = text.strip_prompts(text.collapse_whitespace(text.html_unescape("review_text_clean")))
    rows = filters.embeddable_rows(settled(rows, "review_text_processed", body), "review_text_processed", count="total_tokens_raw")
    return dedup.with_review_hash(rows)


def with_ngrams(rows: DataFrame) -> DataFrame:
    """Tokens without stopwords, their pairs and triples: wide columns, so built after rows have been dropped."""
    rows = rows.withColumn("tokens_processed", text.remove_stopwords(text.tokenize_ws("review_text_processed")))
    return rows.withColumns({"n_tokens_processed": F.size("tokens_processed"),
                             "bigrams": text.ngrams("tokens_processed", 2),
                             "trigrams": text.ngrams("tokens_processed", 3)})


def embed_stage(clean: DataFrame, store: DataFrame | None = None, full: bool = False,
                make_encoder: Callable | None = None, size: int = fv.VECTOR_SIZE) -> DataFrame:
    """New rows only: names removed and text encoded to unit vectors. Append the result to the store."""
    fresh = with_ngrams(dedup.incremental_delta(prepared_stage(clean), store, full))
    fresh = fresh.withColumn("review_text_processed", text.remove_entity_name("review_text_processed", "entity_name"))
    return encode.encode_text(fresh, "review_text_processed", make_encoder, size=size)


def weighted_stage(clean: DataFrame, make_encoder: Callable | None = None, size: int = fv.VECTOR_SIZE,
                   half_life: float = fv.HALF_LIFE_YEARS) -> DataFrame:
    """Second pass over all clean reviews: full name removed, raw vectors, half-life weights, entity roll-up."""
    rows = clean.where(F.length(F.trim("review_text_clean")) > 0)
    rows = rows.withColumn("_text", text.strip_name_literal("review_text_clean", "entity_name"))
    rows = encode.encode_text(rows, "_text", make_encoder, size=size, normalize=False).drop("_text")
    return rollup.entity_weighted_vectors(rollup.with_half_life_weight(rows, half_life))


def query_vectors(spark: SparkSession, make_encoder: Callable | None = None, size: int = fv.VECTOR_SIZE,
                  queries: dict[str, str] | None = None) -> scoring.QueryVectors:
    queries = queries or fv.DIMENSION_QUERIES
    table = spark.createDataFrame(list(queries.items()), "dim string, query_text string")
    encoded = encode.encode_text(table, "query_text", make_encoder, out="query_vec", size=size)
    return scoring.QueryVectors.from_table(encoded, order=list(queries))


def score_stage(embedded: DataFrame, weighted: DataFrame, queries: scoring.QueryVectors, as_of=None):
    """Review scores and entity scores."""
    typed = intake.with_entity_type(embedded)
    reviews = scoring.review_scores(typed, queries, keep=(
        "review_hash", "review_id", "entity_id", "entity_name", "entity_type", "review_text_raw", "reviewer_name",
        "review_date"))
    means = rollup.entity_vectors(embedded.withColumn("token_count", F.col("total_tokens_raw")), as_of=as_of)
    merged = intake.with_entity_type(scoring.merge_methods(means, weighted))
    scored = scoring.with_dots(merged, queries, {f"vector_{m}": f"sim_{m}" for m in fv.METHODS})
    sims = [f"sim_{m}_{d}" for m in fv.METHODS for d in queries.names]
    entities = scored.select("entity_id", "entity_name", "entity_type", F.col("n_reviews").alias("review_count"), *sims)
    return reviews, entities


def group_stage(clean: DataFrame, entities: DataFrame, groups: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Real groups when the export names them, otherwise entities dealt to the given (code, name) groups in turn."""
    if "partner_group" in clean.columns:
        return real_groups(clean)
    table = clean.sparkSession.createDataFrame([(c, n, i) for i, (c, n) in enumerate(groups)], "code string, name string, position long")
    return hash_group_assignment(entities, table)


def run_all(spark: SparkSession, csv_path: str, out: str, excluded=(), store: DataFrame | None = None,
            full: bool = False, make_encoder: Callable | None = None, size: int = fv.VECTOR_SIZE,
            groups: Sequence[tuple[str, str]] = (), as_of=None) -> dict[str, DataFrame]:
    """All stages; returns the stored tables by name."""
    def stored(name, df, partitions=None):
        path = f"{out}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    # ranges of the export are uneven, and a small one is a single range: spread it before the cleaning work
    raw = read_reviews_csv(spark, csv_path)
    standard = stored("reviews_standard", standard_stage(raw, excluded).hint("rebalance"))
    clean = stored("reviews_clean", clean_stage(standard))
    fresh = stored("embedded_new", embed_stage(clean, store, full, make_encoder, size))
    incremental = store is not None and not full and "review_hash" in store.columns
    embedded = dedup.union_by_name(store, fresh) if incremental else fresh
    weighted = stored("entity_vectors_weighted", weighted_stage(clean, make_encoder, size))
    reviews, entities = score_stage(embedded, weighted, query_vectors(spark, make_encoder, size), as_of)
    tables = {
        "reviews_clean": clean, "embedded": embedded, "entity_vectors_weighted": weighted,
        "review_dimension_scores": stored("review_dimension_scores", reviews),
        "entity_dimension_scores": stored("entity_dimension_scores", entities),
    }
    tables["partner_groups"] = stored(
        "partner_groups", group_stage(clean, tables["entity_dimension_scores"], groups)
    ) if groups or "partner_group" in clean.columns else None
    summaries = {
        "raw_file_meta": raw_file_meta(spark, csv_path), "quality_summary": corpus.quality_summary(standard),
        "missing_report": corpus.missing_report(standard), "eda_summary": corpus.eda_summary(clean),
        "coverage": corpus.coverage(clean), "top_tokens": lexical.top_tokens(clean),
        "top_bigrams": lexical.top_bigrams(clean),
    }
    kinds = {"quality_summary": "json", "eda_summary": "json", "coverage": "json", "raw_file_meta": "jsonl",
             "missing_report": "csv", "top_tokens": "csv", "top_bigrams": "csv"}
    write_artifacts(summaries, f"{out}/summaries", kinds)
    return {**{k: v for k, v in tables.items() if v is not None}, **summaries}

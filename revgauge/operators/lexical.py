"""Word and n-gram reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import text
from revgauge.session import small_rows, via_table


#: n-grams that a task's summary follows, and the tasks that merge summaries before the last one.
TRACKED, MERGE = 196_608, 64
#: Candidates, and characters of them, that go to every task; beyond either all n-grams are counted.
CANDIDATES, CHARACTERS = 50_000, 1 << 24


def _ngram_rows(df: DataFrame, tokens, n: int) -> DataFrame:
    return df.select(F.explode(text.ngrams(tokens, n)).alias("ngram"))


def ngram_counts(df: DataFrame, tokens, n: int = 1) -> DataFrame:
    """Occurrences of each n-gram over all rows of an array column; counted per task before the shuffle.

    Most long n-grams are distinct. What a task counts stays in its memory if ``df`` comes in pieces of ``session.PIECE``
    characters (see ``session.in_pieces``).
    """
    return _counts(_ngram_rows(df, tokens, n))


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


def heavy_candidates(rows: DataFrame, top_n: int, tracked: int = TRACKED) -> list[str] | None:
    """n-grams among which the ``top_n`` most frequent are for certain, or None if the summaries cannot tell.

    Each task keeps a frequent-items summary, and only summaries travel. No estimate is off by more than
    3.5 / ``tracked`` of all occurrences, and what a summary does not follow is no more frequent than that. So if the
    ``top_n``-th best estimate is above twice this error, all true winners are followed and lie within twice the error
    below it.
    """
    parts = (rows.where("ngram is not null").withColumn("part", F.spark_partition_id() % MERGE).groupBy("part")
             .agg(F.expr(f"approx_top_k_accumulate(ngram, {tracked})").alias("summary"), F.count(F.lit(1)).alias("total")))
    # by a constant key: no rows give no summary
    whole = parts.withColumn("all", F.lit(True)).groupBy("all").agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"),
                                                                 F.sum("total").alias("total"))
    items = via_table(whole.select("total", F.expr(f"inline(approx_top_k_estimate(summary, {tracked}))")), "summary")
    best = items.orderBy(F.desc("count")).limit(top_n).collect()
    error = best[0].total * 3.5 / tracked if best else 0
    if len(best) < top_n or best[-1]["count"] <= 2 * error:
        return None
    near = items.where(F.col("count") >= best[-1]["count"] - 2 * error)
    size = near.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("item")).alias("length")).first()
    if size.n > CANDIDATES or size.length > CHARACTERS:
        return None
    return [r["item"] for r in small_rows(near.select("item"), CANDIDATES, "candidates")]


def _top(rows: DataFrame, top_n: int, tracked: int = TRACKED) -> DataFrame:
    """The most frequent n-grams and their exact counts. Where summaries name the candidates, only these are counted, so
    that the corpus's n-grams are not shuffled; else all are."""
    candidates = heavy_candidates(rows, top_n, tracked) if top_n > 0 else None
    if candidates:
        few = rows.sparkSession.createDataFrame([(c,) for c in candidates], "ngram string")
        rows = rows.join(F.broadcast(few), "ngram", "left_semi")
    return _counts(rows).orderBy(F.desc("n"), "ngram").limit(top_n)


def top_tokens(df: DataFrame, column: str = "review_text_clean", top_n: int = 40) -> DataFrame:
    return _top(_ngram_rows(df, text.tokenize_simple(column), 1), top_n).withColumnRenamed("ngram", "token")


def top_bigrams(df: DataFrame, column: str = "review_text_clean", top_n: int = 40) -> DataFrame:
    return _top(_ngram_rows(df, text.tokenize_simple(column), 2), top_n).withColumnRenamed("ngram", "bigram")


def active_stopwords(exclude: bool, custom: Sequence[str] | None = None) -> list[str]:
    """Off: none. On with a list: that list, trimmed and lower-cased. On without one: the default list."""
    if not exclude:
        return []
    if custom:
        return sorted({w.lower().strip() for w in custom if w})
    return sorted(set(fv.REPORT_STOPWORDS))


def lexical_top_ngrams(df: DataFrame, column: str = "review_text_clean", n: int = 1, top_n: int = 20,
                       exclude_stopwords: bool = False, custom_stopwords: Sequence[str] | None = None) -> DataFrame:
    words = active_stopwords(exclude_stopwords, custom_stopwords)
    tokens = text.tokenize_simple(column)
    if words:
        tokens = F.filter(tokens, lambda t: ~t.isin(words))
    return _top(_ngram_rows(df, tokens, n), top_n)


def stopword_union(spark: SparkSession) -> DataFrame:
    """The English and the domain list as one sorted table of distinct words, with their origin."""
    lists = [("english", fv.ENGLISH_STOPWORDS), ("domain", fv.DOMAIN_STOPWORDS)]
    words = [(w, origin) for origin, ws in lists for w in ws]
    return (spark.createDataFrame(words, "word string, origin string")
            .groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origin"))
            .orderBy("word"))


def report_stopwords(spark: SparkSession) -> DataFrame:
    """The n-gram report's default list, sorted."""
    return spark.createDataFrame([(w,) for w in active_stopwords(True)], "word string")


def cluster_keywords(df: DataFrame, cluster: str = "cluster", column: str = "review_text_clean", top_n: int = 15,
                     stopwords: Sequence[str] | None = None) -> DataFrame:
    """Most frequent words per cluster without stopwords. Only the best of each task reach the final ranking."""
    from pyspark.sql import Window

    words = sorted(set(fv.ENGLISH_STOPWORDS)) if stopwords is None else list(stopwords)
    counts = (df.select(cluster, F.explode(text.tokenize_simple(column)).alias("term"))
              .where(~F.col("term").isin(words)).groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("n")))
    best = Window.partitionBy(cluster).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)

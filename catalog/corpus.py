"""Corpus reports."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, shaped, table
from revgauge.operators import corpus, filters
from revgauge.plans.surface import ReviewQueries


def _describe(col, p):
    return (f"count({col}) AS {p}_count, round(avg({col}), 6) AS {p}_mean, round(stddev_samp({col}), 6) AS {p}_std, "
            f"CAST(min({col}) AS DOUBLE) AS {p}_min, quantile_cont({col}, 0.25) AS {p}_p25, "
            f"quantile_cont({col}, 0.5) AS {p}_p50, quantile_cont({col}, 0.75) AS {p}_p75, "
            f"CAST(max({col}) AS DOUBLE) AS {p}_max")


def summary_sql(src="f1"):
    return f"""SELECT t.reviews, r.rpe_count AS entities, r.*, t.* EXCLUDE (reviews), g.rating_counts FROM
(SELECT count(*) AS reviews, {_describe("token_count", "tokens")},
  round(avg(CAST(token_count < 20 AS INT)), 6) AS pct_under_20_tokens,
  round(avg(CAST(token_count < 50 AS INT)), 6) AS pct_under_50_tokens FROM {src}) t,
(SELECT string_agg(coalesce(CAST(rating AS VARCHAR), 'none') || ':' || n, ',' ORDER BY rating NULLS FIRST) AS rating_counts
  FROM (SELECT rating, count(*) AS n FROM {src} GROUP BY rating)) g,
(SELECT {_describe("n", "rpe")} FROM (SELECT count(*) AS n FROM {src} GROUP BY entity_id)) r"""


def flat_ratings(summary):
    one = lambda s: F.concat(F.coalesce(s["rating"].cast("string"), F.lit("none")), F.lit(":"), s["n"].cast("string"))
    return summary.withColumn("rating_counts", F.array_join(F.transform("rating_counts", one), ","))


@query("quality_summary", f"""WITH {v.F1} SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_cols,
  count(DISTINCT entity_id) AS n_entities, count(DISTINCT entity_name) AS n_names,
  strftime(min(review_date), '%Y-%m-%d %H:%M:%S') AS date_min, strftime(max(review_date), '%Y-%m-%d %H:%M:%S') AS date_max,
  round(avg(CAST(rating IS NULL AS INT)), 6) AS rating_missing_frac,
  round(avg(CAST(trim(review_text_raw) = '' AS INT)), 6) AS text_empty_frac FROM f1""")
def quality_summary(spark, d):
    return shaped(corpus.quality_summary(v.text_reviews(spark, d)))


@query("missing_report", f"""WITH {v.F1}, n AS (SELECT count(*) AS n, {", ".join(
    f"count(*) FILTER ({c} IS NULL) AS {c}" for c in (
        "review_id", "entity_id", "entity_name", "entity_type", "review_date", "reviewer_name", "rating",
        "review_text_raw", "review_text_clean", "token_count"))} FROM f1)
SELECT column_name, round(missing_count / n, 6) AS missing_frac, missing_count
FROM n UNPIVOT (missing_count FOR column_name IN (review_id, entity_id, entity_name, entity_type, review_date,
  reviewer_name, rating, review_text_raw, review_text_clean, token_count))""")
def missing_report(spark, d):
    return shaped(corpus.missing_report(v.text_reviews(spark, d)))


@query("eda_summary", f"WITH {v.F1} {summary_sql()}")
def eda_summary(spark, d):
    return flat_ratings(shaped(corpus.eda_summary(v.text_reviews(spark, d))))


@query("describe_column", """SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean,
  round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
  round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75,
  max(o_totalprice) AS max FROM orders""")
def describe_column(spark, d):
    return shaped(corpus.describe_column(table(spark, d, "orders"), "o_totalprice"), 4)


@query("coverage", f"""WITH {v.F1}, c AS (SELECT count(*) AS n FROM f1 GROUP BY entity_id)
SELECT count(*) AS entities_total, {", ".join(f"round(avg(CAST(n < {k} AS INT)), 6) AS pct_entities_lt{k}" for k in (3, 5, 10))},
  median(n) AS median_reviews_per_entity, round(quantile_cont(n, 0.9), 6) AS p90_reviews_per_entity FROM c""")
def coverage(spark, d):
    return shaped(corpus.coverage(v.text_reviews(spark, d)))


@query("rating_distribution", f"WITH {v.F1} SELECT rating, count(*) AS n FROM f1 GROUP BY rating")
def rating_distribution(spark, d):
    return shaped(corpus.rating_distribution(v.text_reviews(spark, d)))


@query("reviews_per_entity", f"WITH {v.F1} SELECT entity_id, count(*) AS n_reviews FROM f1 GROUP BY entity_id")
def reviews_per_entity(spark, d):
    return shaped(corpus.reviews_per_entity(v.text_reviews(spark, d)))


def _time_sql(freq, step, label):
    return f"""WITH late AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 10 YEAR ELSE o_orderdate END AS d FROM orders),
c AS (SELECT date_trunc('{freq}', d) AS s, count(*) AS n FROM late GROUP BY ALL),
cal AS (SELECT unnest(generate_series(min(s), max(s), INTERVAL '{step}')) AS s FROM c)
SELECT {label} AS period, coalesce(n, 0) AS n FROM cal LEFT JOIN c USING (s)"""


def _over_time(freq, step, label, name):
    @query(name, _time_sql(freq, step, label))
    def run(spark, d):
        # a fifth of the orders comes ten years later: the periods between must show as 0
        later = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS"))
        late = table(spark, d, "orders").withColumn("o_orderdate", later.otherwise(F.col("o_orderdate")))
        return shaped(corpus.reviews_over_time(late, freq, "o_orderdate"))


_over_time("month", "1 month", "strftime(s, '%Y-%m')", "reviews_over_time")
_over_time("quarter", "3 months", "year(s) || '-Q' || quarter(s)", "reviews_over_time_quarter")
_over_time("year", "1 year", "CAST(year(s) AS VARCHAR)", "reviews_over_time_year")
_over_time("day", "1 day", "strftime(s, '%Y-%m-%d')", "reviews_over_time_day")


@query("reviews_by_year", """SELECT year(o_orderdate) AS review_year, count(*) AS n FROM orders GROUP BY ALL""")
def reviews_by_year(spark, d):
    return shaped(corpus.reviews_by_year(table(spark, d, "orders"), "o_orderdate"))


@query("token_counts", f"WITH {v.F1} SELECT review_id, token_count FROM f1")
def token_counts(spark, d):
    return shaped(corpus.token_counts(v.text_reviews(spark, d)))


@query("token_histogram", f"""WITH {v.F1}, e AS (SELECT min(token_count) AS lo, max(token_count) AS hi FROM f1),
b AS (SELECT lo, hi, CAST(least(floor((token_count - lo) / ((hi - lo) / 60.0::DOUBLE)), 59) AS BIGINT) AS bin FROM f1, e)
SELECT bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 60.0::DOUBLE, 6) AS bin_start, count(*) AS n
FROM b GROUP BY bin""")
def token_histogram(spark, d):
    return shaped(corpus.histogram(v.text_reviews(spark, d), "token_count", 60))


@query("rating_vs_tokens", f"""WITH {v.F1} SELECT CAST(review_id AS VARCHAR) AS review_id, rating, token_count FROM f1
WHERE rating IS NOT NULL""")
def rating_vs_tokens(spark, d):
    return shaped(corpus.rating_vs_tokens(v.text_reviews(spark, d)))


@query("rating_token_correlation", f"""WITH {v.F1} SELECT count(*) AS n, round(corr(rating, token_count), 6) AS corr
FROM f1 WHERE rating IS NOT NULL""")
def rating_token_correlation(spark, d):
    return shaped(corpus.rating_token_correlation(v.text_reviews(spark, d)))


@query("eda_meta", f"""WITH {v.F1}, c AS (SELECT count(*) AS n FROM f1 GROUP BY entity_id)
SELECT strftime(min(review_date), '%Y-%m-%d %H:%M:%S') AS date_min, strftime(max(review_date), '%Y-%m-%d %H:%M:%S')
  AS date_max, count(*) AS row_count, min(token_count) AS token_min, max(token_count) AS token_max,
  CAST(floor(quantile_cont(token_count, 0.25)) AS BIGINT) AS token_q1,
  CAST(floor(quantile_cont(token_count, 0.75)) AS BIGINT) AS token_q3, min(rating) AS rating_min, max(rating) AS rating_max,
  (SELECT min(n) FROM c) AS reviews_per_entity_min, (SELECT max(n) FROM c) AS reviews_per_entity_max,
  (SELECT CAST(floor(quantile_cont(n, 0.25)) AS BIGINT) FROM c) AS rpe_q1,
  (SELECT CAST(floor(quantile_cont(n, 0.75)) AS BIGINT) FROM c) AS rpe_q3 FROM f1""")
def eda_meta(spark, d):
    return shaped(corpus.eda_meta(v.text_reviews(spark, d)))


@query("entity_language_stats", f"""WITH {v.F1} SELECT entity_id, count(*) AS n_reviews,
  CAST(sum(token_count) AS BIGINT) AS total_tokens, round(avg(token_count), 6) AS avg_tokens FROM f1 GROUP BY entity_id""")
def entity_language_stats(spark, d):
    return shaped(corpus.entity_language_stats(v.text_reviews(spark, d)))


@query("token_coverage_curve", f"""WITH {v.F1}, t AS (SELECT sum(token_count) AS s FROM f1 GROUP BY entity_id)
SELECT CAST(threshold AS BIGINT) AS threshold, round(avg(CAST(s >= threshold AS INT)), 6) AS share_covered,
  round(avg(CAST(s < threshold AS INT)), 6) AS share_below
FROM t, (SELECT unnest([500, 1000, 1500, 2000, 3000]) AS threshold) GROUP BY threshold""")
def token_coverage_curve(spark, d):
    return shaped(corpus.token_coverage_curve(v.text_reviews(spark, d), thresholds=(500, 1000, 1500, 2000, 3000)))


@query("informative_share", f"""WITH {v.F1} SELECT entity_id, arg_min(entity_name, review_id) AS entity_name,
  count(*) AS n_reviews, CAST(sum(CAST(token_count >= 75 AS INT)) AS BIGINT) AS n_informative,
  round(avg(CAST(token_count >= 75 AS INT)), 6) AS share_informative, round(avg(token_count), 6) AS avg_tokens
FROM f1 WHERE rating >= 1 GROUP BY entity_id HAVING count(*) >= 2 ORDER BY avg(CAST(token_count >= 75 AS INT)) DESC,
  entity_id LIMIT 10""")
def informative_share(spark, d):
    return shaped(corpus.informative_share(v.text_reviews(spark, d), min_rating=1, min_reviews=2))


_FILTER = """fl AS (SELECT * FROM f1 WHERE review_date >= TIMESTAMP '2024-01-01 06:00:00'
  AND review_date <= TIMESTAMP '2024-01-03' AND token_count >= 20 AND token_count <= 900),
ff AS (SELECT * FROM fl WHERE entity_id IN (SELECT entity_id FROM fl GROUP BY entity_id HAVING count(*) BETWEEN 3 AND 9))"""
_ARGS = {"date_start": "2024-01-01 06:00:00", "date_end": "2024-01-03", "min_tokens": 20, "max_tokens": 900,
         "min_reviews": 3, "max_reviews": 9}


@query("eda_filter_entity_zero", f"WITH {v.F1} SELECT review_id, entity_id FROM f1 WHERE entity_id = 0")
def eda_filter_entity_zero(spark, d):
    return shaped(filters.eda_filter(v.text_reviews(spark, d), entity_id=0).select("review_id", "entity_id"))


@query("eda_filter_rating_firm", f"WITH {v.F1} SELECT review_id, rating, entity_id % 3 AS firm_id FROM f1 "
       "WHERE rating = 1 AND entity_id % 3 = 0")
def eda_filter_rating_firm(spark, d):
    rows = v.text_reviews(spark, d).withColumn("firm_id", F.col("entity_id") % 3)
    return shaped(filters.eda_filter(rows, scope="firm", firm_id=0, rating=1).select("review_id", "rating", "firm_id"))


@query("eda_filter", f"WITH {v.F1}, {_FILTER} SELECT review_id, entity_id, token_count FROM ff")
def eda_filter(spark, d):
    return shaped(filters.eda_filter(v.text_reviews(spark, d), **_ARGS).select("review_id", "entity_id", "token_count"))


def _epoch(c):
    return F.unix_seconds(F.col(c).cast("timestamp")).cast("double")


def _cells(block, df, key=None):
    """(block, key, value) rows: the columns of a one-row block, or one column of a block by its key."""
    num = lambda f: (_epoch(f.name) if "timestamp" in f.dataType.typeName() else F.col(f.name).cast("double"))
    if key is None:
        cells = [F.struct(F.lit(f.name).alias("key"), num(f).alias("value")) for f in df.schema.fields]
        return df.select(F.lit(block).alias("block"), F.inline(F.array(*cells)))
    name, value = key
    return df.select(F.lit(block).alias("block"), F.coalesce(F.col(name).cast("string"), F.lit("none")).alias("key"),
                     F.col(value).cast("double").alias("value"))


def payload_rows(blocks):
    """The ten blocks of a report as one table."""
    ratings = blocks["summary"].select(F.inline("rating_counts"))
    rows = _cells("summary", blocks["summary"].drop("rating_counts")).unionByName(_cells("summary_ratings", ratings, ("rating", "n")))
    keyed = {"rating_distribution": ("rating", "n"), "reviews_over_time": ("period", "n"), "reviews_per_entity": ("entity_id", "n_reviews"),
             "token_counts": ("review_id", "token_count"), "rating_vs_tokens": ("review_id", "token_count"), "lexical": ("ngram", "n")}
    for name in ("quality", "coverage", "meta", *keyed):
        rows = rows.unionByName(_cells(name, blocks[name], keyed.get(name)))
    return rows


def _one_row_sql(block, sql):
    return f"""SELECT '{block}' AS block, key, CAST(value AS DOUBLE) AS value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({sql}))
  UNPIVOT INCLUDE NULLS (value FOR key IN (COLUMNS(*)))"""


def payload_sql(f1, filtered, scope="f1"):
    ff = "ff"
    per = f"(SELECT count(*) AS n FROM {ff} GROUP BY entity_id)"
    scope_per = f"(SELECT count(*) AS n FROM {scope} GROUP BY entity_id)"
    summary = summary_sql(ff).replace(", g.rating_counts FROM", " FROM")
    quality = f"""SELECT count(*) AS n_rows, 10 AS n_cols, count(DISTINCT entity_id) AS n_entities, count(DISTINCT reviewer_name) AS n_names,
      floor(epoch(min(review_date))) AS date_min, floor(epoch(max(review_date))) AS date_max, avg(CAST(rating IS NULL AS INT)) AS rating_missing_frac,
      avg(CAST(review_text_clean IS NULL AS INT)) AS text_empty_frac FROM {ff}"""
    coverage = f"""SELECT count(*) AS entities_total, {", ".join(f"avg(CAST(n < {k} AS INT)) AS pct_entities_lt{k}" for k in (3, 5, 10))},
      median(n) AS median_reviews_per_entity, quantile_cont(n, 0.9) AS p90_reviews_per_entity FROM {per}"""
    meta = f"""SELECT floor(epoch(min(review_date))) AS date_min, floor(epoch(max(review_date))) AS date_max, count(*) AS row_count,
      min(token_count) AS token_min, max(token_count) AS token_max, floor(quantile_cont(token_count, 0.25)) AS token_q1,
      floor(quantile_cont(token_count, 0.75)) AS token_q3, min(rating) AS rating_min, max(rating) AS rating_max,
      (SELECT min(n) FROM {scope_per}) AS reviews_per_entity_min, (SELECT max(n) FROM {scope_per}) AS reviews_per_entity_max,
      (SELECT floor(quantile_cont(n, 0.25)) FROM {scope_per}) AS rpe_q1, (SELECT floor(quantile_cont(n, 0.75)) FROM {scope_per}) AS rpe_q3
      FROM {scope}"""
    rating = f"SELECT coalesce(CAST(rating AS VARCHAR), 'none') AS key, CAST(count(*) AS DOUBLE) AS value FROM {ff} GROUP BY rating"
    terms = f"SELECT unnest(regexp_extract_all(lower(review_text_clean), '[a-z0-9'']{{2,}}')) AS key FROM {ff}"
    return f"""WITH {f1}, {filtered}, p AS ({_one_row_sql("summary", summary)}
UNION ALL {_one_row_sql("quality", quality)} UNION ALL {_one_row_sql("coverage", coverage)} UNION ALL {_one_row_sql("meta", meta)}
UNION ALL SELECT 'summary_ratings', * FROM ({rating}) UNION ALL SELECT 'rating_distribution', * FROM ({rating})
UNION ALL SELECT 'reviews_over_time', strftime(date_trunc('month', review_date), '%Y-%m'), count(*) FROM {ff} GROUP BY ALL
UNION ALL SELECT 'reviews_per_entity', CAST(entity_id AS VARCHAR), count(*) FROM {ff} GROUP BY ALL
UNION ALL SELECT 'token_counts', CAST(review_id AS VARCHAR), token_count FROM {ff}
UNION ALL SELECT 'rating_vs_tokens', CAST(review_id AS VARCHAR), token_count FROM {ff} WHERE rating IS NOT NULL
UNION ALL SELECT 'lexical', key, n FROM (SELECT key, count(*) AS n FROM ({terms}) GROUP BY key ORDER BY n DESC, key LIMIT 20))
SELECT block, key, round(value, 4) + 0.0 AS value FROM p"""


@query("eda_payload", payload_sql(v.F1, _FILTER))
def eda_payload(spark, d):
    """All ten blocks of a filtered report, from one stored table of the filtered rows; ``meta`` describes the scope."""
    blocks = ReviewQueries(spark, {"reviews": v.text_reviews(spark, d)}).eda_charts(**_ARGS)
    return shaped(payload_rows(blocks), 4)


@query("eda_preset", f"""WITH {v.F1}, p AS ({_one_row_sql("quality", """SELECT count(*) AS n_rows, 10 AS n_cols,
  count(DISTINCT entity_id) AS n_entities, count(DISTINCT entity_name) AS n_names, floor(epoch(min(review_date))) AS date_min,
  floor(epoch(max(review_date))) AS date_max, avg(CAST(rating IS NULL AS INT)) AS rating_missing_frac,
  avg(CAST(trim(review_text_raw) = '' AS INT)) AS text_empty_frac FROM f1""")}
UNION ALL SELECT 'reviews_per_entity', CAST(entity_id AS VARCHAR), count(*) FROM f1 GROUP BY ALL)
SELECT block, key, round(value, 4) + 0.0 AS value FROM p""")
def eda_preset(spark, d):
    """The stored quality summary counts entity names, the live block reviewers; filters do not apply."""
    reviews = v.text_reviews(spark, d)
    tables = {"reviews": reviews, "quality_summary": corpus.quality_summary(reviews)}
    blocks = ReviewQueries(spark, tables).eda_charts(preset="eda", **_ARGS)
    rows = _cells("quality", blocks["quality"]).unionByName(
        _cells("reviews_per_entity", blocks["reviews_per_entity"], ("entity_id", "n_reviews")))
    return shaped(rows, 4)


@query("quartile_category_filter", f"""WITH {v.F1}, b AS (SELECT min(token_count) AS lo,
  CAST(floor(quantile_cont(token_count, 0.25)) AS BIGINT) AS q1, CAST(floor(quantile_cont(token_count, 0.75)) AS BIGINT) AS q3
  FROM f1)
SELECT review_id, token_count FROM f1, b WHERE token_count BETWEEN lo AND q3""")
def quartile_category_filter(spark, d):
    rows = filters.quartile_category_filter(v.text_reviews(spark, d), "token_count", ["medium", "low"])
    return shaped(rows.select("review_id", "token_count"))


@query("quartile_ranges", f"""WITH {v.F1}, b AS (SELECT min(token_count) AS lo, max(token_count) AS hi,
  CAST(floor(quantile_cont(token_count, 0.25)) AS BIGINT) AS q1, CAST(floor(quantile_cont(token_count, 0.75)) AS BIGINT) AS q3
  FROM f1)
SELECT 'low' AS category, lo AS range_min, q1 AS range_max FROM b UNION ALL SELECT 'medium', q1 + 1, q3 FROM b
UNION ALL SELECT 'high', q3 + 1, hi FROM b""")
def quartile_ranges(spark, d):
    return shaped(filters.quartile_ranges(filters.whole_quartiles(v.text_reviews(spark, d), "token_count")))


@query("min_total_tokens", f"""WITH {v.F1} SELECT review_id FROM f1 WHERE entity_id IN (
  SELECT entity_id FROM f1 GROUP BY entity_id HAVING sum(token_count) >= 1500)""")
def min_total_tokens(spark, d):
    return shaped(filters.min_total_tokens(v.text_reviews(spark, d), at_least=1500).select("review_id"))

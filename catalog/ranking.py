"""Percentiles, tiers, profiles, leaderboards, pools and comparisons."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, shaped, table
from revgauge.functions import numbers, text
from revgauge.operators import benchmark, compare, filters, ranking, scoring

A, B = 7, 11
_EN = "entity_id, entity_name, entity_type, review_count, method, dim, raw, percentile, normalized, tier"


def _long(spark, d, methods=("mean", "penalized", "weighted")):
    return scoring.long_scores(v.entity_scores(spark, d), methods)


@query("percentile_rank", f"""WITH {v.ES} SELECT entity_id, method, dim, percentile FROM (
  SELECT *, {v.rank_sql("entity_type, method, dim")} FROM es)""")
def percentile_rank(spark, d):
    return shaped(ranking.percentile_rank(_long(spark, d)).select("entity_id", "method", "dim", "percentile"))


@query("percentile_rank_ties", f"""SELECT o_orderkey, percentile FROM (
  SELECT o_orderkey, {v.rank_sql("o_orderpriority")} FROM (
    SELECT o_orderkey, o_orderpriority, floor(o_totalprice / 1000) AS score FROM orders))""")
def percentile_rank_ties(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority",
                                            F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"))
    return shaped(ranking.percentile_rank(rows, ["o_orderpriority"]).select("o_orderkey", "percentile"))


@query("minmax_normalize", f"""WITH {v.ES} SELECT entity_id, method, dim, normalized FROM (
  SELECT *, {v.rank_sql("entity_type, method, dim")} FROM es)""")
def minmax_normalize(spark, d):
    return shaped(ranking.minmax_normalize(_long(spark, d)).select("entity_id", "method", "dim", "normalized"))


@query("tier_from_percentile", f"""WITH {v.ES}, p AS (SELECT entity_id, method, dim, percentile FROM (
  SELECT *, {v.rank_sql("entity_type, method, dim")} FROM es))
SELECT entity_id, method, dim, {v.tier_sql("percentile")} AS tier FROM p""")
def tier_from_percentile(spark, d):
    ranked = ranking.percentile_rank(_long(spark, d))
    return shaped(ranked.select("entity_id", "method", "dim", numbers.tier_from_percentile("percentile").alias("tier")))


_BP = """bp AS (SELECT dim, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50,
  quantile_cont(score, 0.75) AS p75 FROM es WHERE method = 'mean' {where} GROUP BY ALL)"""


@query("tier_from_breakpoints", f"""WITH {v.ES}, {_BP.format(where="AND entity_type = 'advisor'")}
SELECT entity_id, dim, CASE WHEN score >= p75 THEN 'Very Strong' WHEN score >= p50 THEN 'Strong'
  WHEN score >= p25 THEN 'Moderate' ELSE 'Foundational' END AS tier
FROM es JOIN bp USING (dim) WHERE method = 'mean' AND entity_type = 'advisor'""")
def tier_from_breakpoints(spark, d):
    return shaped(benchmark.tiers_from_breakpoints(v.entity_scores(spark, d), "mean", "advisor").select(
        "entity_id", "dim", "tier"))


@query("enrich_scores", f"WITH {v.ENRICHED} SELECT {_EN} FROM en")
def enrich_scores(spark, d):
    return shaped(ranking.enrich_scores(v.entity_scores(spark, d)))


@query("entity_profile", f"WITH {v.ENRICHED} SELECT {_EN} FROM en WHERE entity_id = {A} AND method = 'mean'")
def entity_profile(spark, d):
    return shaped(ranking.entity_profile(v.entity_scores(spark, d), A, "mean"))


@query("premier_percentiles", f"""WITH {v.ES}, m AS (SELECT * FROM es WHERE method = 'mean'),
pr AS (SELECT t.entity_id, t.entity_name, t.entity_type, t.dim, any_value(t.review_count) AS review_count,
  count(*) AS peer_count, count(*) FILTER (p.score < t.score) AS below, count(*) FILTER (p.score = t.score) AS ties
  FROM m t JOIN m p ON p.entity_type = t.entity_type AND p.dim = t.dim
    AND (p.review_count >= {v.PREMIER_VECTOR} OR p.entity_id = t.entity_id) GROUP BY ALL)
SELECT entity_id, entity_name, entity_type, 'mean' AS method, dim,
  round_even((below + (ties + 1) / 2.0::DOUBLE) / peer_count * 100, 1) AS percentile, peer_count, review_count,
  review_count >= {v.PREMIER_VECTOR} AS premier FROM pr""")
def premier_percentiles(spark, d):
    return shaped(ranking.premier_percentiles(v.entity_scores(spark, d), "mean", v.PREMIER_VECTOR, v.PREMIER_VECTOR))


def _board(where="", top=10, keep=""):
    return f"""WITH {v.ES}, pool AS (SELECT * FROM es7 WHERE method = 'mean' {where}),
ranked AS (SELECT *, {v.rank_sql("dim")}, row_number() OVER (PARTITION BY dim ORDER BY score DESC, entity_id) AS rank
  FROM pool)
SELECT dim, rank, entity_id, entity_name, entity_type, round_even(score, 6) AS score, percentile, normalized,
  {v.tier_sql("percentile")} AS tier, review_count FROM ranked WHERE rank <= {top} {keep}"""


@query("leaderboard", _board())
def leaderboard(spark, d):
    return shaped(ranking.leaderboard(v.entity_scores(spark, d)))


@query("leaderboard_premier", _board(f"AND entity_type = 'advisor' AND review_count >= {v.PREMIER_VECTOR}", 5,
                                     "AND dim = 'composite'"))
def leaderboard_premier(spark, d):
    return shaped(ranking.leaderboard(v.entity_scores(spark, d), "mean", "advisor", v.PREMIER_VECTOR, 5, "composite"))


@query("leaderboard_extremes", f"""WITH board AS ({_board()})
SELECT dim, arg_max(entity_id, -rank) AS best_id, max(percentile) AS best, arg_max(entity_id, rank) AS worst_id,
  min(percentile) AS worst FROM board GROUP BY dim""")
def leaderboard_extremes(spark, d):
    return shaped(ranking.leaderboard_extremes(ranking.leaderboard(v.entity_scores(spark, d))))


@query("evidence_topk", f"""WITH {v.RS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, dim ORDER BY score DESC, review_id) AS rank FROM rs)
SELECT review_id, entity_id, reviewer_name AS reviewer, strftime(review_date, '%Y-%m-%d') AS review_day,
  review_text_raw AS snippet, dim, round(score, 6) + 0.0 AS score,
  CASE WHEN score >= 0.4376 THEN 'Very Strong' WHEN score >= 0.3613 THEN 'Strong' WHEN score >= 0.2827 THEN 'Moderate'
    ELSE 'Foundational' END AS tier, rank FROM r WHERE rank <= 3""")
def evidence_topk(spark, d):
    return shaped(ranking.evidence_topk(v.scored_reviews(spark, d), v.DIMS))


@query("evidence_list", f"""WITH {v.RS} SELECT review_id, entity_id, reviewer_name AS reviewer,
  strftime(review_date, '%Y-%m-%d') AS review_day, review_text_raw AS snippet, dim, round(score, 6) + 0.0 AS score,
  CASE WHEN score >= 0.4376 THEN 'Very Strong' WHEN score >= 0.3613 THEN 'Strong' WHEN score >= 0.2827 THEN 'Moderate'
    ELSE 'Foundational' END AS tier FROM rs WHERE dim = 'trust'""")
def evidence_list(spark, d):
    return shaped(ranking.evidence_list(v.scored_reviews(spark, d), "trust"))


@query("snippet", f"""WITH {v.F1} SELECT review_id,
  trim(replace(left(review_text_raw, 200), chr(10), ' ')) || CASE WHEN length(review_text_raw) > 200 THEN '...' ELSE '' END
    AS snippet, coalesce(nullif(reviewer_name, 'src0'), 'Anonymous') AS reviewer,
  strftime(review_date, '%Y-%m-%d') AS review_day FROM f1""")
def snippet(spark, d):
    reviewer = F.coalesce(F.nullif(F.col("reviewer_name"), F.lit("src0")), F.lit("Anonymous"))
    flat = F.translate("review_text_raw", "\n", " ")
    return shaped(v.text_reviews(spark, d).select(
        "review_id", text.snippet(flat).alias("snippet"), reviewer.alias("reviewer"),
        F.date_format("review_date", "yyyy-MM-dd").alias("review_day")))


@query("confidence_tier", f"""WITH {v.F1} SELECT entity_id, count(*) AS review_count, CASE WHEN count(*) < 10
  THEN 'directional' WHEN count(*) >= 20 THEN 'premier' ELSE 'none' END AS confidence_tier FROM f1 GROUP BY ALL""")
def confidence_tier(spark, d):
    counts = v.text_reviews(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("review_count"))
    return shaped(benchmark.with_confidence(counts))


@query("method_overlap", f"""WITH {v.ES}, t AS (
  SELECT dim, method, entity_id, row_number() OVER (PARTITION BY dim, method ORDER BY score DESC, entity_id) AS n FROM es),
m AS (SELECT dim, entity_id, string_agg(method, '+' ORDER BY method) AS methods FROM t WHERE n <= 10 GROUP BY ALL)
SELECT dim, methods, count(*) AS n, array_to_string(list_sort(list(CAST(entity_id AS VARCHAR))), ',') AS entity_ids
FROM m GROUP BY ALL""")
def method_overlap(spark, d):
    return shaped(ranking.method_overlap(v.entity_scores(spark, d), v.DIMS))


_TOP = """SELECT entity_id FROM es WHERE dim = 'trust' AND method = '{m}' ORDER BY score DESC, entity_id LIMIT 10"""


@query("intersect_except_topn", f"""WITH {v.ES}, a AS ({_TOP.format(m="mean")}), b AS ({_TOP.format(m="penalized")}),
c AS ({_TOP.format(m="weighted")})
SELECT 'all' AS part, entity_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b INTERSECT SELECT * FROM c)
UNION ALL SELECT 'mean_only', entity_id FROM (SELECT * FROM a EXCEPT (SELECT * FROM b UNION SELECT * FROM c))""")
def intersect_except_topn(spark, d):
    es = v.entity_scores(spark, d)
    a, b, c = (ranking.top_ids(es, m, "trust") for m in ("mean", "penalized", "weighted"))
    part = lambda name, df: df.select(F.lit(name).alias("part"), "entity_id")
    return shaped(part("all", a.intersect(b).intersect(c)).unionByName(part("mean_only", a.subtract(b.union(c)))))


@query("premier_pool", f"""WITH {v.ES} SELECT DISTINCT entity_id, review_count FROM es
WHERE review_count >= {v.PREMIER_VECTOR}""")
def premier_pool(spark, d):
    return shaped(filters.premier_pool(v.entity_scores(spark, d), v.PREMIER_VECTOR).select("entity_id", "review_count"))


@query("premier_pool_keep_self", f"""WITH {v.ES} SELECT DISTINCT entity_id, review_count FROM es
WHERE entity_type = 'advisor' AND (review_count >= {v.PREMIER_VECTOR} OR entity_id = {A})""")
def premier_pool_keep_self(spark, d):
    return shaped(filters.premier_pool_keep_self(v.entity_scores(spark, d), A, v.PREMIER_VECTOR).select(
        "entity_id", "review_count"))


@query("population_medians", f"""WITH {v.ES} SELECT dim, round(median(score), 6) + 0.0 AS median FROM es
WHERE method = 'mean' AND entity_type = 'firm' GROUP BY dim""")
def population_medians(spark, d):
    return shaped(benchmark.population_medians(v.entity_scores(spark, d)))


@query("method_breakpoints", f"""WITH {v.ES}, {_BP.format(where="")}
SELECT dim, round(p25, 6) + 0.0 AS p25, round(p50, 6) + 0.0 AS p50, round(p75, 6) + 0.0 AS p75 FROM bp""")
def method_breakpoints(spark, d):
    return shaped(benchmark.method_breakpoints(v.entity_scores(spark, d), "mean", "all"))


@query("pool_stats", f"""WITH {v.ES}, e AS (SELECT DISTINCT entity_id, entity_type, review_count FROM es),
pools AS (SELECT 'all' AS pool, * FROM e UNION ALL SELECT 'premier', * FROM e WHERE review_count >= {v.PREMIER_VECTOR})
SELECT pool, count(*) AS total, count(*) FILTER (entity_type = 'firm') AS firms,
  count(*) FILTER (entity_type = 'advisor') AS advisors, round(avg(review_count), 6) AS reviews_mean,
  median(review_count) AS reviews_median, min(review_count) AS reviews_min, max(review_count) AS reviews_max
FROM pools GROUP BY pool""")
def pool_stats(spark, d):
    return shaped(benchmark.pool_totals(v.entity_scores(spark, d), v.PREMIER_VECTOR))


@query("pool_dim_stats", f"""WITH {v.ES}, m AS (SELECT * FROM es WHERE method = 'mean'),
pools AS (SELECT 'all' AS pool, * FROM m UNION ALL SELECT 'premier', * FROM m WHERE review_count >= {v.PREMIER_VECTOR})
SELECT pool, dim, round(avg(score), 6) + 0.0 AS mean, round(stddev_samp(score), 6) AS std,
  round(min(score), 6) + 0.0 AS min, round(max(score), 6) + 0.0 AS max, round(median(score), 6) + 0.0 AS median,
  round(quantile_cont(score, 0.25), 6) + 0.0 AS p25, round(quantile_cont(score, 0.75), 6) + 0.0 AS p75
FROM pools GROUP BY pool, dim""")
def pool_dim_stats(spark, d):
    return shaped(benchmark.pool_dim_stats(v.entity_scores(spark, d), v.PREMIER_VECTOR))


@query("score_distributions", f"""WITH {v.ES} SELECT dim, entity_id, round(score, 6) + 0.0 AS score FROM es
WHERE method = 'mean' AND entity_type = 'advisor' AND review_count >= {v.PREMIER_VECTOR}""")
def score_distributions(spark, d):
    return shaped(benchmark.score_distributions(v.entity_scores(spark, d), "mean", "advisor", v.PREMIER_VECTOR))


@query("score_histogram", f"""WITH {v.ES}, m AS (SELECT * FROM es WHERE method = 'mean'),
e AS (SELECT dim, min(score) AS lo, max(score) AS hi FROM m GROUP BY dim),
b AS (SELECT dim, entity_id, lo, hi, CAST(least(floor((score - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin
  FROM m JOIN e USING (dim))
SELECT dim, bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20, 6) + 0.0 AS bin_start,
  count(*) AS n, bool_or(entity_id = {A}) AS is_here FROM b GROUP BY dim, bin""")
def score_histogram(spark, d):
    return shaped(benchmark.score_histogram(v.entity_scores(spark, d), entity_id=A))


@query("entity_list", f"""WITH {v.ES} SELECT DISTINCT entity_type, entity_id, entity_name, review_count FROM es""")
def entity_list(spark, d):
    return shaped(benchmark.entity_list(v.entity_scores(spark, d)))


@query("entity_directory", f"""WITH {v.ES} SELECT DISTINCT entity_type, entity_id, entity_name, review_count FROM es
WHERE entity_type = 'advisor' AND review_count >= {v.PREMIER_VECTOR}""")
def entity_directory(spark, d):
    return shaped(benchmark.entity_directory(v.entity_scores(spark, d), "advisor", v.PREMIER_VECTOR))


@query("partner_group_list", f"""WITH {v.GROUPS} SELECT partner_group_code, partner_group_name,
  count(*) AS member_count FROM pg GROUP BY ALL""")
def partner_group_list(spark, d):
    return shaped(compare.partner_group_list(v.partner_groups(spark, d)))


@query("group_profiles", f"""WITH {v.ENRICHED}, {v.GROUPS} SELECT {_EN}, partner_group_code, partner_group_name
FROM en JOIN pg USING (entity_id) WHERE partner_group_code = 3 AND method = 'weighted'""")
def group_profiles(spark, d):
    return shaped(compare.group_profiles(v.partner_groups(spark, d), v.entity_scores(spark, d), 3, "weighted"))


@query("entity_comparison", f"""WITH {v.ENRICHED}, asked(entity_id, position) AS (VALUES ({B}, 0), (-1, 1), ({A}, 2))
SELECT {_EN}, CAST(position AS BIGINT) AS position FROM en JOIN asked USING (entity_id) WHERE method = 'mean'""")
def entity_comparison(spark, d):
    return shaped(compare.entity_comparison(v.entity_scores(spark, d), [B, -1, A]))


@query("head_to_head", f"""WITH {v.ENRICHED}, m AS (SELECT * FROM en WHERE method = 'mean')
SELECT a.dim, a.raw AS raw_a, a.percentile AS percentile_a, a.normalized AS normalized_a, a.tier AS tier_a,
  b.raw AS raw_b, b.percentile AS percentile_b, b.normalized AS normalized_b, b.tier AS tier_b,
  round_even(b.raw - a.raw, 4) + 0.0 AS diff_raw, round_even(b.percentile - a.percentile, 4) + 0.0 AS diff_percentile,
  round_even(b.normalized - a.normalized, 4) + 0.0 AS diff_normalized
FROM m a JOIN m b USING (dim) WHERE a.entity_id = {A} AND b.entity_id = {B}""")
def head_to_head(spark, d):
    return shaped(compare.head_to_head(v.entity_scores(spark, d), A, B))


@query("peer_table", f"""WITH {v.ES}, {_BP.format(where="")}, p AS (SELECT dim, percentile, score, entity_id FROM (
  SELECT *, {v.rank_sql("dim")} FROM es WHERE method = 'mean' AND entity_type = 'advisor'
    AND (review_count >= {v.PREMIER_VECTOR} OR entity_id = {A})))
SELECT dim, round(score, 6) + 0.0 AS score, percentile, round(p25, 6) + 0.0 AS p25, round(p50, 6) + 0.0 AS p50,
  round(p75, 6) + 0.0 AS p75 FROM p JOIN bp USING (dim) WHERE entity_id = {A}""")
def peer_table(spark, d):
    return shaped(benchmark.peer_table(v.entity_scores(spark, d), A, min_reviews=v.PREMIER_VECTOR))


@query("entity_reviews", f"""WITH {v.RS} SELECT review_id, entity_id, entity_name, entity_type, review_text_raw,
  reviewer_name, strftime(review_date, '%Y-%m-%d %H:%M:%S') AS review_date, {", ".join(
    f"round(max(score) FILTER (dim = '{n}'), 6) + 0.0 AS sim_{n}" for n in v.DIMS)}
FROM rs WHERE entity_id = {A} GROUP BY ALL""")
def entity_reviews(spark, d):
    return shaped(filters.entity_reviews(v.scored_reviews(spark, d), A, v.DIMS))


@query("scored_review_lookup", f"""WITH {v.RS} SELECT review_id, entity_id, entity_name, entity_type, review_text_raw,
  reviewer_name, strftime(review_date, '%Y-%m-%d %H:%M:%S') AS review_date, {", ".join(
    f"round(max(score) FILTER (dim = '{n}'), 6) + 0.0 AS sim_{n}" for n in v.DIMS)}
FROM rs WHERE review_id = 123 GROUP BY ALL""")
def scored_review_lookup(spark, d):
    return shaped(filters.scored_review_lookup(v.scored_reviews(spark, d), 123, v.DIMS))

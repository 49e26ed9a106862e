"""Firms, partner groups and samples."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, shaped, table
from revgauge.operators import firms, groups, sampling, scoring

FIRM, ENTITY = "2-HIGH", 11


@query("firm_list", f"WITH {v.FIRMS} SELECT DISTINCT firm_id FROM fs")
def firm_list(spark, d):
    return shaped(firms.firm_list(v.firm_scores(spark, d)))


@query("firm_summary", f"""WITH {v.FIRMS} SELECT firm_id, count(DISTINCT entity_id) AS entity_count,
  count(DISTINCT dimension) AS dimension_count, round_even(avg(score), 2) AS avg_score,
  round_even(avg(confidence), 2) AS avg_confidence FROM fs GROUP BY firm_id""")
def firm_summary(spark, d):
    return shaped(firms.firm_summaries(v.firm_scores(spark, d)))


_MEANS = "round(avg(score), 6) AS score, round(avg(confidence), 6) AS confidence, avg(review_count) AS review_count"


@query("firm_dimensions", f"WITH {v.FIRMS} SELECT dimension, {_MEANS} FROM fs WHERE firm_id = '{FIRM}' GROUP BY dimension")
def firm_dimensions(spark, d):
    return shaped(firms.firm_dimensions(v.firm_scores(spark, d), FIRM))


@query("firm_advisors", f"WITH {v.FIRMS} SELECT entity_id, {_MEANS} FROM fs WHERE firm_id = '{FIRM}' GROUP BY entity_id")
def firm_advisors(spark, d):
    return shaped(firms.firm_entities(v.firm_scores(spark, d), FIRM))


@query("firm_entity_detail", f"""WITH {v.FIRMS} SELECT firm_id, entity_id, dimension, round(score, 6) AS score,
  round(confidence, 6) AS confidence, CAST(review_count AS BIGINT) AS review_count FROM fs
WHERE firm_id = '{FIRM}' AND entity_id = {ENTITY}""")
def firm_entity_detail(spark, d):
    return shaped(firms.firm_entity_scores(v.firm_scores(spark, d), FIRM, ENTITY))


@query("firm_entity_themes", f"""SELECT user_id AS entity_id, event_type AS theme, event_id FROM events
WHERE user_id = {ENTITY} AND user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '{FIRM}')""")
def firm_entity_themes(spark, d):
    themes = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("theme"),
                                              "event_id")
    return shaped(firms.firm_entity_themes(v.firm_scores(spark, d), themes, FIRM, ENTITY))


@query("firm_personas", f"""WITH {v.FIRMS}, m AS (SELECT entity_id, avg(score) AS score FROM fs WHERE firm_id = '{FIRM}'
  GROUP BY entity_id)
SELECT entity_id, round(score, 6) AS score, CASE WHEN score >= 80 THEN 'Headliner' WHEN score >= 65 THEN 'Opener'
  ELSE 'Indie' END AS persona FROM m""")
def firm_personas(spark, d):
    return shaped(firms.firm_personas(v.firm_scores(spark, d), FIRM))


@query("real_groups", """SELECT user_id AS entity_id, arg_min(event_type, event_id) AS partner_group_code,
  arg_min(event_type, event_id) AS partner_group_name FROM events GROUP BY user_id""")
def real_groups(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("review_id"),
                                            F.col("event_type").alias("partner_group"))
    return shaped(groups.real_groups(rows))


@query("hash_group_assignment", f"""WITH {v.F2}, e AS (SELECT entity_id, row_number() OVER (
    ORDER BY sha256(CAST(entity_id AS VARCHAR))) AS n FROM f2 WHERE entity_type = 'advisor' GROUP BY entity_id
  HAVING count(*) >= 3),
g AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name,
  3 + CAST(('0x' || substr(sha256(CAST(n_nationkey AS VARCHAR)), 1, 4)) AS INT) % 3 AS size, n_nationkey FROM nation),
s AS (SELECT *, sum(size) OVER (ORDER BY n_nationkey) AS last FROM g)
SELECT entity_id, code AS partner_group_code, name AS partner_group_name FROM e JOIN s ON n BETWEEN last - size + 1 AND last
""")
def hash_group_assignment(spark, d):
    nations = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    return shaped(groups.hash_group_assignment(v.entity_scores(spark, d), nations))


@query("group_revalidation", f"""WITH {v.GROUPS} SELECT count(*) AS n_members,
  count(*) FILTER (entity_id NOT IN (SELECT user_id FROM events)) AS n_stale,
  count(*) FILTER (entity_id NOT IN (SELECT user_id FROM events)) = 0 AS keep FROM pg""")
def group_revalidation(spark, d):
    return shaped(groups.group_revalidation(v.partner_groups(spark, d), v.entity_scores(spark, d)))


_WIDE = ", ".join(f"round(max(score) FILTER (dim = '{n}'), 6) + 0.0 AS sim_{n}" for n in v.DIMS)


@query("sample_reviews", f"""WITH {v.RS}, wide AS (SELECT review_id, entity_id, entity_name, entity_type, {_WIDE} FROM rs
  GROUP BY ALL)
SELECT * FROM wide ORDER BY sha256('42|' || review_id), review_id LIMIT 100""")
def sample_reviews(spark, d):
    # pick first: only the sample is scored
    picked = sampling.sample_rows(v.vector_reviews(spark, d), 100)
    return shaped(sampling.sample_reviews(scoring.review_scores(picked, v.queries_of(spark, d))))


@query("sample_scatter", f"""WITH {v.F1} SELECT review_id, rating, token_count FROM f1 WHERE rating IS NOT NULL
ORDER BY sha256('42|' || review_id), review_id LIMIT 2000""")
def sample_scatter(spark, d):
    return shaped(sampling.sample_scatter(v.text_reviews(spark, d)))

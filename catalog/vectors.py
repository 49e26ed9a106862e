"""Vectors, roll-ups and scores."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, shaped, table
from revgauge import fixed_values as fv
from revgauge.functions import numbers, vectors
from revgauge.operators import intake, rollup, scoring
from revgauge.session import via_table


def _cells(df, vector, ids):
    return df.select(*ids, F.posexplode(vector).alias("pos", "x"))


@query("parse_vector_text", """
SELECT vec_id, pos - 1 AS pos, round(x, 6) + 0.0 AS x FROM (
  SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)""")
def parse_vector_text(spark, d):
    emb = table(spark, d, "embeddings")
    # the text form breaks lines, as printed arrays do
    as_text = emb.select("vec_id", F.regexp_replace(vectors.format_vector(F.col("embedding").cast("array<double>")), "( [^ ]+ [^ ]+) ", "$1\n ")
                         .alias("t"))
    return shaped(_cells(as_text.select("vec_id", vectors.parse_vector_text("t").alias("e")), "e", ["vec_id"]))


@query("parquet_vectors", """
SELECT vec_id, pos - 1 AS pos, round(x, 6) + 0.0 AS x FROM (
  SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)""")
def parquet_vectors(spark, d):
    stored = via_table(table(spark, d, "embeddings").select("vec_id", "embedding"), "vectors")
    return shaped(_cells(stored, "embedding", ["vec_id"]))


@query("vector_dim_check", f"WITH {v.F2} SELECT len(embedding) AS dim, count(*) AS n FROM f2 GROUP BY ALL")
def vector_dim_check(spark, d):
    return shaped(intake.vector_dim_check(v.vector_reviews(spark, d)))


@query("vector_math", """
SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS dot,
  round(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS norm,
  round(CAST(a.embedding[1] AS DOUBLE) * 2.5, 6) + 0.0 AS scaled_first
FROM embeddings a JOIN embeddings b ON b.vec_id = a.label""")
def vector_math(spark, d):
    emb = table(spark, d, "embeddings")
    other = emb.select(F.col("vec_id").alias("label"), F.col("embedding").alias("e2"))
    return shaped(emb.join(other, "label").select(
        "vec_id", vectors.dot("embedding", "e2").alias("dot"), vectors.l2_norm("embedding").alias("norm"),
        F.get(vectors.scale("embedding", 2.5), F.lit(0)).alias("scaled_first")))


@query("scalar_math", """
SELECT o_orderkey, round(exp(-o_totalprice / 100000), 6) AS e, round(ln(o_totalprice), 6) AS l,
  round(pow(0.5::DOUBLE, o_totalprice / 100000), 6) AS p, round(sqrt(o_totalprice), 6) AS s,
  least(greatest(o_totalprice, 50000), 300000) AS clipped, round_even(o_totalprice / 1000, 1) AS half_even
FROM orders""")
def scalar_math(spark, d):
    x = F.col("o_totalprice")
    return shaped(table(spark, d, "orders").select(
        "o_orderkey", F.exp(-x / 100000).alias("e"), F.ln(x).alias("l"), F.pow(F.lit(0.5), x / 100000).alias("p"),
        F.sqrt(x).alias("s"), numbers.clip(x, 50000, 300000).alias("clipped"), F.bround(x / 1000, 1).alias("half_even")))


@query("cross_score", f"WITH {v.RS} SELECT review_id, dim, round(score, 6) + 0.0 AS score FROM rs")
def cross_score(spark, d):
    qs = v.queries_of(spark, d)
    dots = v.vector_reviews(spark, d).select("review_id", qs.scores("embedding").alias("s"))
    names = F.array(*[F.lit(n) for n in qs.names])
    return shaped(dots.select("review_id", F.inline(F.arrays_zip(names.alias("dim"), F.col("s").alias("score"))))
                  .toDF("review_id", "dim", "score"))


_WIDE = ", ".join(f"round(max(score) FILTER (dim = '{n}'), 6) + 0.0 AS sim_{n}" for n in v.DIMS)


@query("review_scores", f"WITH {v.RS} SELECT review_id, entity_id, entity_type, {_WIDE} FROM rs GROUP BY ALL")
def review_scores(spark, d):
    return shaped(v.scored_reviews(spark, d).select("review_id", "entity_id", "entity_type",
                                                    *[f"sim_{n}" for n in v.DIMS]))


_ES_WIDE = ", ".join(f"round(max(score) FILTER (dim = '{n}' AND method = '{m}'), 6) + 0.0 AS sim_{m}_{n}"
                     for m in fv.METHODS for n in v.DIMS)


@query("entity_scores", f"""WITH {v.ES} SELECT entity_id, entity_name, entity_type, review_count, {_ES_WIDE}
FROM es GROUP BY ALL""")
def entity_scores(spark, d):
    return shaped(v.build_entity_scores(spark, d))


@query("entity_mean_vector", f"WITH {v.VEC} SELECT entity_id, pos - 1 AS pos, round(v, 6) + 0.0 AS x FROM mean_vec")
def entity_mean_vector(spark, d):
    out = rollup.entity_mean_vectors(v.vector_reviews(spark, d), as_of=v.AS_OF, days_per_year=v.DAYS_PER_YEAR)
    return shaped(_cells(out, "vector_mean", ["entity_id"]))


@query("entity_penalized_vector", f"WITH {v.VEC} SELECT entity_id, pos - 1 AS pos, round(v, 6) + 0.0 AS x FROM pen_vec")
def entity_penalized_vector(spark, d):
    return shaped(_cells(v.mean_vectors(spark, d), "vector_penalized", ["entity_id"]))


@query("entity_weighted_vector", f"WITH {v.VEC} SELECT entity_id, pos - 1 AS pos, round(v, 6) + 0.0 AS x FROM w_vec")
def entity_weighted_vector(spark, d):
    return shaped(_cells(v.weighted_vectors(spark, d), "vector_weighted", ["entity_id"]))


@query("entity_weighted_stats", f"""WITH {v.VEC} SELECT w.entity_id, count(*) AS n_reviews_used,
  CAST(sum(token_count) AS BIGINT) AS total_tokens, round(median(greatest(age, 0)), 6) AS median_age_years,
  strftime(min(w.review_date), '%Y-%m-%d %H:%M:%S') AS min_review_date,
  strftime(max(w.review_date), '%Y-%m-%d %H:%M:%S') AS max_review_date,
  round(sum(w) * sum(w) / sum(w * w), 6) AS effective_n_time
FROM w JOIN f2 USING (review_id) GROUP BY w.entity_id""")
def entity_weighted_stats(spark, d):
    return shaped(v.weighted_vectors(spark, d, median_age=True).drop("entity_name", "vector_weighted"))


@query("entity_mean_stats", f"""WITH {v.VEC} SELECT entity_id, count(*) AS n_reviews,
  CAST(sum(token_count) AS BIGINT) AS n_tokens_raw,
  median(floor(date_diff('microsecond', review_date, TIMESTAMP '{v.AS_OF}') / 1e6 / 86400)) AS median_age_years,
  strftime(max(review_date), '%Y-%m-%d %H:%M:%S') AS most_recent_review_date FROM f2 GROUP BY ALL""")
def entity_mean_stats(spark, d):
    out = rollup.entity_mean_vectors(v.vector_reviews(spark, d), as_of=v.AS_OF, days_per_year=v.DAYS_PER_YEAR)
    return shaped(out.drop("entity_name", "vector_mean"))


@query("staleness_penalty", f"""WITH {v.VEC} SELECT entity_id, staleness AS staleness_years,
  round(factor, 6) AS penalty_factor FROM pen""")
def staleness_penalty(spark, d):
    reviews = v.vector_reviews(spark, d)
    last = reviews.groupBy("entity_id").agg(F.max("review_date").alias("most_recent_review_date"))
    out = rollup.with_staleness_penalty(last, v.AS_OF, v.DAYS_PER_YEAR)
    return shaped(out.select("entity_id", "staleness_years", "penalty_factor"))


@query("attach_recency", f"""WITH {v.VEC} SELECT entity_id, n_reviews,
  strftime(last_date, '%Y-%m-%d %H:%M:%S') AS most_recent_review_date, staleness AS staleness_years,
  round(factor, 6) AS penalty_factor FROM pen""")
def attach_recency(spark, d):
    return shaped(v.mean_vectors(spark, d).select("entity_id", "n_reviews", "most_recent_review_date",
                                                  "staleness_years", "penalty_factor"))


@query("half_life_weights", f"WITH {v.VEC} SELECT review_id, round(age, 6) AS age_years, round(w, 6) AS w_time FROM w")
def half_life_weights(spark, d):
    return shaped(v.weighted_reviews(spark, d).select("review_id", "age_years", "w_time"))


@query("informativeness_weights", f"""WITH {v.F1}, r AS (SELECT max(review_date) AS d FROM f1),
i AS (SELECT review_id, least(greatest(sqrt(token_count / 80.0::DOUBLE), 0.2), 2.0) AS w_info,
  pow(0.5::DOUBLE, date_diff('microsecond', review_date, (SELECT d FROM r)) / 1e6 / 86400 / {v.HALF_LIFE}) AS w_time
  FROM f1)
SELECT review_id, round(w_info, 6) AS w_info, round(w_time * w_info, 6) AS w_both FROM i""")
def informativeness_weights(spark, d):
    rows = rollup.with_half_life_weight(v.text_reviews(spark, d), v.HALF_LIFE, v.DAYS_PER_YEAR)
    info = numbers.informativeness_weight("token_count")
    return shaped(rows.select("review_id", info.alias("w_info"), (F.col("w_time") * info).alias("w_both")))


@query("effective_n", f"""WITH {v.VEC} SELECT entity_id, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_n
FROM w GROUP BY ALL""")
def effective_n(spark, d):
    return shaped(v.weighted_reviews(spark, d).groupBy("entity_id").agg(
        numbers.effective_n("w_time").alias("effective_n")))


@query("merge_methods", f"""WITH {v.VEC} SELECT entity_id, n_reviews, round(factor, 6) AS penalty_factor, n_reviews_used
FROM pen JOIN (SELECT entity_id, count(*) AS n_reviews_used FROM w GROUP BY ALL) USING (entity_id)""")
def merge_methods(spark, d):
    both = scoring.merge_methods(v.mean_vectors(spark, d), v.weighted_vectors(spark, d))
    return shaped(both.select("entity_id", "n_reviews", "penalty_factor", "n_reviews_used"))


@query("attach_review_count", """SELECT c_custkey AS entity_id, coalesce(n, 0) AS review_count FROM customer LEFT JOIN
(SELECT user_id, count(*) AS n FROM events GROUP BY ALL) ON user_id = c_custkey""")
def attach_review_count(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    return shaped(scoring.attach_review_count(customers, table(spark, d, "events").withColumnRenamed(
        "user_id", "entity_id")))


@query("macro_totals", f"""WITH {v.RS} SELECT {", ".join(
    f"round(sum(score) FILTER (dim = '{n}'), 4) AS total_{n}" for n in v.DIMS)},
  count(DISTINCT review_id) AS review_count FROM rs""")
def macro_totals(spark, d):
    return shaped(scoring.macro_totals(v.scored_reviews(spark, d), v.DIMS), 4)


@query("macro_totals_premier", f"""WITH {v.RS}, p AS (
  SELECT entity_id FROM f2 GROUP BY ALL HAVING count(*) >= {v.PREMIER_VECTOR})
SELECT {", ".join(f"round(sum(score) FILTER (dim = '{n}'), 4) AS total_{n}" for n in v.DIMS)},
  count(DISTINCT review_id) AS review_count FROM rs WHERE entity_id IN (SELECT entity_id FROM p)""")
def macro_totals_premier(spark, d):
    return shaped(scoring.macro_totals(v.scored_reviews(spark, d), v.DIMS, v.entity_scores(spark, d),
                                       v.PREMIER_VECTOR), 4)


@query("dimension_rank", f"""WITH {v.RS}, t AS (SELECT dim, sum(score) AS total FROM rs GROUP BY ALL)
SELECT dim, round(total, 4) AS total, row_number() OVER (ORDER BY total DESC, dim) AS rank FROM t""")
def dimension_rank(spark, d):
    return shaped(scoring.dimension_rank(scoring.macro_totals(v.scored_reviews(spark, d), v.DIMS), v.DIMS), 4)


@query("composite_score", f"""WITH {v.ES}, gap AS (SELECT entity_id, method, dim, CASE WHEN dim = 'clarity' AND entity_id % 4 = 0
  OR entity_id % 40 = 0 THEN NULL ELSE score END AS score FROM es)
SELECT entity_id, method, CASE WHEN count(score) = count(*) THEN round(avg(score), 6) + 0.0 END AS strict,
  round(avg(score), 6) + 0.0 AS present FROM gap GROUP BY ALL""")
def composite_score(spark, d):
    es = v.entity_scores(spark, d)
    # a quarter of the entities lack one dimension, some lack all
    lacks = lambda n: ((F.lit(n == "clarity") & (F.col("entity_id") % 4 == 0)) | (F.col("entity_id") % 40 == 0))
    es = es.withColumns({c: F.when(~lacks(n), F.col(c)) for m in fv.METHODS for n in v.DIMS for c in [f"sim_{m}_{n}"]})
    pick = lambda kind: scoring.long_scores(es, composite=kind).where(F.col("dim") == "composite").select(
        "entity_id", "method", F.col("score").alias(kind))
    return shaped(pick("strict").join(pick("present"), ["entity_id", "method"]))


@query("wide_to_long", f"""WITH {v.ES} SELECT entity_id, 'sim_' || method || '_' || dim AS method,
  round(score, 6) + 0.0 AS score FROM es""")
def wide_to_long(spark, d):
    columns = [f"sim_{m}_{n}" for m in fv.METHODS for n in v.DIMS]
    return shaped(intake.wide_to_long(v.entity_scores(spark, d), ["entity_id"], columns))

"""Reports from merged sketches, held against the exact answer."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, shaped
from revgauge.operators import sketches as s


def held(reviews, answers, by):
    """``answers`` with whether each approximate figure lies within its stated error of the reviews' exact one."""
    marks = ("token_q1", "token_median", "token_q3")
    exact = reviews.join(F.broadcast(answers.select(by, *marks)), by).groupBy(by).agg(
        F.count_distinct("entity_id").alias("e"), F.count_distinct("entity_name").alias("n"),
        *[F.avg((F.col("token_count") < F.col(m)).cast("int")).alias(f"{m}_below") for m in marks],
        *[F.avg((F.col("token_count") <= F.col(m)).cast("int")).alias(f"{m}_upto") for m in marks])
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.ceil(s.DISTINCT_ERROR * F.col(b))
    ranked = [((F.col(f"{m}_below") <= p + s.RANK_ERROR) & (F.col(f"{m}_upto") >= p - s.RANK_ERROR)).alias(f"{m}_held")
              for m, p in zip(marks, (0.25, 0.5, 0.75), strict=True)]
    return answers.join(exact, by).select(by, "reviews", "token_min", "token_max", "token_mean",
                                          near("entities", "e").alias("entities_held"), near("names", "n").alias("names_held"), *ranked)


def _sql(by, where):
    return f"""WITH {v.F1} SELECT {by}, count(*) AS reviews, min(token_count) AS token_min, max(token_count) AS token_max,
  round(avg(token_count), 6) AS token_mean, true AS entities_held, true AS names_held, true AS token_q1_held,
  true AS token_median_held, true AS token_q3_held FROM f1 WHERE {where} GROUP BY {by}"""


@query("sketch_report_by_type", _sql("entity_type", "true"))
def sketch_report_by_type(spark, d):
    reviews = v.text_reviews(spark, d)
    return shaped(held(reviews, s.report(s.review_sketches(reviews), by=["entity_type"]), "entity_type"))


@query("sketch_report_filtered", _sql("rating", "rating IS NOT NULL AND review_date >= TIMESTAMP '2024-01-02' AND entity_type = 'advisor'"))
def sketch_report_filtered(spark, d):
    """The same stored cells under a filter on day, type and rating."""
    reviews = v.text_reviews(spark, d)
    asked = F.col("rating").isNotNull() & (F.col("entity_type") == "advisor")
    cells = s.merged(s.review_sketches(reviews))
    answers = s.report(cells, asked & (F.col("day") >= F.lit("2024-01-02").cast("date")), ["rating"])
    return shaped(held(reviews.where(asked & (F.col("review_date") >= "2024-01-02")), answers, "rating"))

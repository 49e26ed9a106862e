"""Merged sketches against exact answers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from revgauge.operators import sketches

SCHEMA = "review_date timestamp, entity_type string, rating double, token_count long, entity_id long, entity_name string"


def reviews(spark, n):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(days=rnd.randrange(9)), rnd.choice(["firm", "advisor", None]), rnd.choice([1.0, 5.0, None]),
             int(rnd.lognormvariate(4, 1)), k % 3000, f"n{k % 700}") for k in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def holds(row, chosen):
    tokens = sorted(r[3] for r in chosen)
    assert (row.reviews, row.token_min, row.token_max) == (len(chosen), tokens[0], tokens[-1])
    assert abs(row.token_mean - sum(tokens) / len(tokens)) < 1e-9
    for got, want in ((row.entities, len({r[4] for r in chosen})), (row.names, len({r[5] for r in chosen}))):
        assert abs(got - want) <= 1 + sketches.DISTINCT_ERROR * want
    for got, p in ((row.token_q1, 0.25), (row.token_median, 0.5), (row.token_q3, 0.75)):
        assert sum(t < got for t in tokens) / len(tokens) <= p + sketches.RANK_ERROR
        assert sum(t <= got for t in tokens) / len(tokens) >= p - sketches.RANK_ERROR


def test_any_filter(spark):
    rows, df = reviews(spark, 20_000)
    cells = sketches.review_sketches(df)
    holds(sketches.report(cells).first(), rows)
    late = sketches.report(cells, (F.col("day") >= F.lit("2024-01-05").cast("date")) & (F.col("rating") > 3)).first()
    holds(late, [r for r in rows if r[0] >= dt.datetime(2024, 1, 5) and r[2] == 5.0])
    for row in sketches.report(cells, by=["entity_type"]).collect():
        holds(row, [r for r in rows if r[1] == row.entity_type])


def test_batches_merge(spark):
    rows, df = reviews(spark, 6_000)
    first = spark.createDataFrame(rows[:2500], SCHEMA)
    rest = spark.createDataFrame(rows[2500:], SCHEMA)
    both = sketches.review_sketches(first).unionByName(sketches.review_sketches(rest))
    whole = sketches.merged(both)
    assert whole.count() == sketches.review_sketches(df).count()
    holds(sketches.report(whole).first(), rows)


def test_nothing_to_count(spark):
    empty = sketches.review_sketches(spark.createDataFrame([], SCHEMA))
    row = sketches.report(empty).first()
    assert (row.reviews, row.entities, row.names, row.token_median) == (0, 0, 0, None)
    assert sketches.report(empty, by=["rating"]).collect() == []
    bare = spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA)
    row = sketches.report(sketches.review_sketches(bare)).first()
    assert (row.reviews, row.entities, row.token_q1, row.token_mean) == (1, 0, None, None)

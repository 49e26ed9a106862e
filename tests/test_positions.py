"""Exact ranks and quantiles against pandas, also with a hot group, ties, NULLs and many buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revgauge.operators import positions, ranking


@pytest.fixture(params=[1_000_000, 300, 1], ids=["one bucket", "some buckets", "most buckets"])
def buckets(request, monkeypatch):
    monkeypatch.setattr(positions, "ROWS_PER_BUCKET", request.param)


def sample():
    rng = np.random.default_rng(5)
    n = 4000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))
    x = np.where(rng.random(n) < 0.3, 1.5, np.round(rng.normal(size=n) ** 3, 2))
    x[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"i": range(n), "g": g, "score": x})


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def test_percentile_rank(spark, buckets):
    pdf = sample()
    got = ranking.percentile_rank(frame(spark, pdf), ["g"]).toPandas().set_index("i").percentile.sort_index()
    want = (pdf.groupby("g").score.rank(pct=True) * 100).map(lambda v: round(v, 1))
    pd.testing.assert_series_equal(got, want, check_names=False)
    assert got.dropna().between(0, 100, inclusive="right").all()


def test_minmax(spark):
    pdf = sample()
    got = ranking.minmax_normalize(frame(spark, pdf), ["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert part.normalized.min() == 0 and part.normalized.max() == 100
    same = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None)], "g string, score double")
    assert sorted(r.normalized or -1 for r in ranking.minmax_normalize(same, ["g"]).collect()) == [-1, 50, 50]


@pytest.mark.parametrize("groups", [["g"], []])
def test_quantiles(spark, buckets, groups):
    pdf = sample()
    probs = {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "hi": 1.0}
    got = positions.exact_quantiles(frame(spark, pdf), groups, "score", probs).toPandas()
    for name, q in probs.items():
        if groups:
            want = pdf.groupby("g").score.quantile(q)
            np.testing.assert_allclose(got.set_index("g")[name].sort_index(), want)
        else:
            np.testing.assert_allclose(got[name][0], pdf.score.quantile(q))


def test_members_only(spark, buckets):
    pdf = sample().dropna()
    df = frame(spark, pdf)
    spots = positions.value_positions(df, ["g"], "score", F.col("i") % 2 == 0).toPandas()
    for r in spots.sample(60, random_state=1).itertuples():
        pool = pdf[(pdf.g == r.g) & (pdf.i % 2 == 0)].score
        assert (r.n_before, r.n_at, r.n_total) == ((pool < r.score).sum(), (pool == r.score).sum(), len(pool))

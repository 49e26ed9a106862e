"""Roll-ups, scores, rankings and comparisons against NumPy and pandas."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revgauge.functions import numbers, vectors
from revgauge.operators import benchmark, compare, filters, groups, ranking, rollup, scoring, similarity, topics

DIMS = ["a", "b"]
SIZE = 5


@pytest.fixture(scope="module")
def reviews():
    rng = np.random.default_rng(3)
    n = 400
    ent = np.where(rng.random(n) < 0.35, "hot", rng.choice([f"e{i}" for i in range(12)], n))
    days = rng.integers(0, 2000, n)
    return pd.DataFrame({
        "review_id": range(n), "entity_id": ent, "entity_name": [f"Name {e}" for e in ent],
        "entity_type": ["firm" if e in ("hot", "e1", "e2", "e3") else "advisor" for e in ent],
        "review_date": pd.Timestamp("2018-01-01 08:00") + pd.to_timedelta(days, "D") + pd.to_timedelta(days % 7, "h"),
        "token_count": rng.integers(1, 300, n), "embedding": list(rng.normal(size=(n, SIZE)).astype("float32")),
        "reviewer_name": "r", "review_text_raw": "t",
    })


@pytest.fixture(scope="module")
def df(spark, reviews):
    rows = [(*t[:4], t.review_date.to_pydatetime(), t.token_count, [float(x) for x in t.embedding], *t[-2:])
            for t in reviews.itertuples(index=False)]
    schema = ("review_id long, entity_id string, entity_name string, entity_type string, review_date timestamp_ntz, "
              "token_count long, embedding array<float>, reviewer_name string, review_text_raw string")
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def queries():
    return scoring.QueryVectors(DIMS, np.random.default_rng(9).normal(size=(2, SIZE)))


@pytest.fixture(scope="module")
def twin(reviews, queries):
    """Entity table by the plain definition."""
    as_of = reviews.review_date.max()
    rows, means = [], {}
    for e, g in reviews.groupby("entity_id"):
        m = np.vstack(g.embedding).astype(float)
        mean = m.mean(axis=0)
        mean /= np.linalg.norm(mean)
        w = 0.5 ** (((as_of - g.review_date).dt.total_seconds() / (365.25 * 86400)).to_numpy() / 2.0)
        rows.append({"entity_id": e, "n": len(g), "stale": (as_of - g.review_date.max()).days / 365.25,
                     "median_days": np.median((as_of - g.review_date).dt.days / 365.25), "mean": mean,
                     "median_exact": ((as_of - g.review_date).dt.total_seconds() / (365.25 * 86400)).median(),
                     "weighted": (m * w[:, None]).sum(axis=0) / w.sum(), "eff": w.sum() ** 2 / (w ** 2).sum()})
    t = pd.DataFrame(rows).set_index("entity_id")
    lam = -math.log(0.7) / t.stale.quantile(0.75)
    t["factor"] = np.exp(-lam * t.stale)
    t["penalized"] = [v * f for v, f in zip(t["mean"], t.factor)]
    return t


@pytest.fixture(scope="module")
def entities(df, queries):
    types = df.select("entity_id", "entity_type").distinct()
    return scoring.entity_scores(rollup.entity_vectors(df), rollup.entity_weighted_vectors(
        rollup.with_half_life_weight(df)), queries, types).cache()


def test_vectors(df, twin):
    got = rollup.entity_vectors(df).toPandas().set_index("entity_id").sort_index()
    np.testing.assert_allclose(np.vstack(got.vector_mean), np.vstack(twin["mean"]), atol=1e-7)
    np.testing.assert_allclose(np.vstack(got.vector_penalized), np.vstack(twin.penalized), atol=1e-7)
    np.testing.assert_allclose(got.penalty_factor, twin.factor)
    np.testing.assert_allclose(got.median_age_years, twin.median_days)
    assert list(got.n_reviews) == list(twin.n)


def test_weighted(df, twin):
    got = rollup.entity_weighted_vectors(rollup.with_half_life_weight(df)).toPandas().set_index("entity_id").sort_index()
    np.testing.assert_allclose(np.vstack(got.vector_weighted), np.vstack(twin.weighted), atol=1e-7)
    np.testing.assert_allclose(got.effective_n_time, twin.eff)
    np.testing.assert_allclose(got.median_age_years, twin.median_exact, atol=1e-9)


def test_zero_weights_give_the_plain_mean(spark):
    rows = spark.createDataFrame([("e", [1.0, 2.0], 0.0), ("e", [3.0, 4.0], 0.0), ("f", [1.0, 0.0], 0.0),
                                  ("f", [5.0, 5.0], 2.0), ("f", [9.0, 9.0], None)],
                                 "entity_id string, v array<double>, w double")
    got = {r.entity_id: (r.v, r.n) for r in rows.groupBy("entity_id").agg(
        rollup.weighted_mean_vector(F.col("v"), F.col("w")).alias("v"), numbers.effective_n("w").alias("n")).collect()}
    assert got["e"] == ([2.0, 3.0], 0.0)
    np.testing.assert_allclose(got["f"][0], [5.0, 5.0])
    assert got["f"][1] == 1.0


def test_no_staleness_spread(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01'), ('b', timestamp_ntz'2024-01-01'), "
                     "('c', timestamp_ntz'2024-01-01'), ('d', timestamp_ntz'2024-01-01'), ('e', timestamp_ntz'2023-01-01') "
                     "AS t(entity_id, most_recent_review_date)")
    got = {r.entity_id: r.penalty_factor for r in rollup.with_staleness_penalty(rows, "2024-01-01").collect()}
    assert got == {"a": None, "b": None, "c": None, "d": None, "e": 0.0}


def test_missing_vectors_have_no_score(spark, queries):
    rows = spark.createDataFrame([(1, [1.0] * SIZE), (2, None)], "review_id long, embedding array<float>")
    got = {r.review_id: r.sim_a for r in scoring.review_scores(rows, queries).collect()}
    assert got[2] is None
    assert got[1] == pytest.approx(queries.matrix[0].sum())


def test_many_queries(spark):
    """Any number of query vectors; there was a cap of 256 once."""
    many = spark.range(300).select(F.format_string("q%03d", "id").alias("dim"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("query_vec"))
    found = scoring.QueryVectors.from_table(many)
    rows = spark.createDataFrame([(1, [2.0, 0.5])], "review_id long, embedding array<double>")
    got = scoring.review_scores(rows, found).first()
    assert [got[f"sim_q{i:03d}"] for i in range(300)] == pytest.approx([2.0 * i + 0.5 for i in range(300)])


def test_many_groups(spark):
    """More groups than a thousand, dealt in order, 3 to 5 members each, no member twice."""
    entities = spark.range(6000).select(F.col("id").alias("entity_id"), F.lit("advisor").alias("entity_type"), F.lit(9).alias("review_count"))
    codes = spark.range(1200).select(F.format_string("g%04d", "id").alias("code"), F.lit("n").alias("name"), F.col("id").alias("position"))
    got = groups.hash_group_assignment(entities, codes).toPandas()
    order = sorted(range(6000), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    want, at = {}, 0
    for g in range(1200):
        size = 3 + int(hashlib.sha256(f"g{g:04d}".encode()).hexdigest()[:4], 16) % 3
        want.update({e: f"g{g:04d}" for e in order[at:at + size]})
        at += size
    assert dict(zip(got.entity_id, got.partner_group_code, strict=True)) == want


def test_nearest_without_owner_or_vector(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, None, [0.9, 0.1]), (3, None, [0.8, 0.3]), (4, "a", [1.0, 0.1]), (5, "b", None)],
                                 "review_id long, entity_id string, embedding array<double>")
    got = similarity.similar_reviews_other_entity(rows, [1, 2], 5).collect()
    assert {(r.query_id, r.item_id) for r in got} == {(1, 2), (1, 3), (2, 1), (2, 3), (2, 4)}
    for unknown in (5, 99):
        with pytest.raises(ValueError, match=str(unknown)):
            similarity.nearest(rows, [1, unknown], 2)


def test_representatives_skip_what_has_no_vector(spark):
    rows = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [1.0, 1.0]), (3, 7, None), (4, None, [1.0, 0.0]), (5, 8, [0.0, 2.0])],
                                 "review_id long, cluster int, embedding array<double>")
    got = topics.cluster_representatives(rows, top_n=1)
    assert {(r.cluster, r.review_id) for r in got.collect()} <= {(7, 1), (7, 2), (8, 5)}
    assert topics.cluster_representatives(rows.where("review_id < 0")).collect() == []


def test_entity_scores(entities, twin, queries):
    got = entities.toPandas().set_index("entity_id").sort_index()
    for j, d in enumerate(DIMS):
        for m in ("mean", "penalized", "weighted"):
            np.testing.assert_allclose(got[f"sim_{m}_{d}"], np.vstack(twin[m]) @ queries.matrix[j], atol=1e-7)


def _long(entities):
    p = entities.toPandas()
    long = pd.concat([p.assign(dim=d, score=p[f"sim_mean_{d}"]) for d in DIMS])
    comp = p.assign(dim="composite", score=(p.sim_mean_a + p.sim_mean_b) / 2)
    return pd.concat([long, comp])


def test_profiles_and_head_to_head(entities):
    long = _long(entities)
    long["pct"] = (long.groupby(["entity_type", "dim"]).score.rank(pct=True) * 100).round(1)
    lo, hi = (long.groupby(["entity_type", "dim"]).score.transform(f) for f in ("min", "max"))
    long["norm"] = ((long.score - lo) / (hi - lo) * 100).round(1)
    want = long.set_index(["entity_id", "dim"])
    for e in ("hot", "e5"):
        for r in ranking.entity_profile(entities, e).collect():
            w = want.loc[(e, r.dim)]
            assert r.percentile == pytest.approx(w.pct) and r.normalized == pytest.approx(w.norm)
            assert r.raw == pytest.approx(w.score, abs=1e-6)
    both = {r.dim: r for r in compare.head_to_head(entities, "e5", "hot").collect()}
    assert set(both) == {*DIMS, "composite"}
    for d, r in both.items():
        assert r.diff_percentile == pytest.approx(want.loc[("hot", d)].pct - want.loc[("e5", d)].pct, abs=1e-4)
    assert compare.head_to_head(entities, "e5", "nobody").count() == 0
    order = [r.entity_id for r in compare.entity_comparison(entities, ["e9", "zz", "e1"]).where("dim = 'a'").collect()]
    assert order == ["e9", "e1"]
    assert compare.entity_comparison(entities, []).count() == 0


def test_leaderboard(entities):
    long = _long(entities)
    board = ranking.leaderboard(entities, top_n=3).toPandas()
    for d, part in board.groupby("dim"):
        want = long[long.dim == d].nlargest(3, "score")
        assert list(part.sort_values("rank").entity_id) == list(want.entity_id)
        assert part.percentile.max() == 100 and part.normalized.max() == 100
    ends = {r.dim: r for r in ranking.leaderboard_extremes(ranking.leaderboard(entities, top_n=3)).collect()}
    assert ends["a"].best_id == board[(board.dim == "a") & (board["rank"] == 1)].entity_id.item()
    assert ends["a"].worst_id == board[(board.dim == "a") & (board["rank"] == 3)].entity_id.item()


@pytest.mark.parametrize("least", [0, 25])
def test_premier_percentiles(entities, least):
    p = entities.toPandas()
    got = ranking.premier_percentiles(entities, "mean", least).toPandas().set_index(["entity_id", "dim"])
    for e in p.itertuples():
        peers = p[(p.entity_type == e.entity_type) & ((p.review_count >= least) | (p.entity_id == e.entity_id))]
        r = got.loc[(e.entity_id, "a")]
        assert r.percentile == round(peers.sim_mean_a.rank(pct=True)[e.Index] * 100, 1)
        assert r.peer_count == len(peers)
    kept = filters.premier_pool_keep_self(entities, "e5", 25).toPandas()
    assert "e5" in set(kept.entity_id) and set(kept.entity_type) == {"advisor"}


def test_pool_totals_with_empty_pool(entities):
    rows = {r.pool: r for r in benchmark.pool_totals(entities, 10_000).collect()}
    assert rows["premier"].total == 0 and rows["premier"].reviews_min == 0 and rows["premier"].reviews_mean is None
    assert rows["all"].total == 13


def test_nearest(df, reviews, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 2)
    m = np.vstack(reviews.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for other in (False, True):
        got = similarity.nearest(df, [5, 7, 300], 4, other_entity=other).toPandas()
        for q in (5, 7, 300):
            sims = pd.Series(m @ m[q]).drop(q)
            if other:
                sims = sims[reviews.entity_id[sims.index] != reviews.entity_id[q]]
            want = sims.sort_values(ascending=False).index[:4]
            assert list(got[got.query_id == q].sort_values("rank").item_id) == list(want)
    with pytest.raises(ValueError):
        similarity.nearest(df, [-1], 3)


def test_evidence_keeps_the_best(df, queries):
    scored = scoring.review_scores(df, queries)
    got = ranking.evidence_topk(scored, DIMS, 3).toPandas()
    p = scored.toPandas()
    for (e, d), part in got.groupby(["entity_id", "dim"]):
        want = p[p.entity_id == e].nlargest(3, f"sim_{d}").review_id
        assert list(part.sort_values("rank").review_id) == list(want)


def test_kmeans(df):
    out = topics.kmeans_topics(df, k=4)
    sizes = topics.cluster_sizes(out).toPandas()
    assert sizes.n.sum() == 400 and set(sizes.cluster) == {0, 1, 2, 3}
    assert topics.cluster_representatives(out).groupBy("cluster").count().where("count > 5").count() == 0


def test_vector_functions(spark):
    df = spark.createDataFrame([("[0.1 0.2\n 3e-1]", [3.0, 4.0]), ("[ 1 ]", [0.0, 0.0]), (None, None)],
                               "t string, v array<double>")
    rows = df.select(vectors.parse_vector_text("t").alias("p"), vectors.unit("v").alias("u"),
                     vectors.l2_norm("v").alias("n")).collect()
    assert rows[0].p == [0.1, 0.2, 0.3] and rows[1].p == [1.0] and rows[2].p is None
    np.testing.assert_allclose(rows[0].u, [0.6, 0.8])
    assert rows[1].u is None and rows[2].u is None and rows[0].n == 5

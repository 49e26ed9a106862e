"""The pruned nearest-vector join against all pairs."""

import numpy as np
import pytest

from revgauge.operators import neighbors, similarity


def rows_of(n, seed, spread=0.05):
    """Clusters of vectors, a third of all rows one vector, some zero, some without vector or owner."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, 8))
    out = []
    for i in range(n):
        v = (centres[r.integers(12)] + spread * r.standard_normal(8)).tolist()
        v = [1.0] * 8 if i % 3 == 0 else [0.0] * 8 if i % 50 == 1 else None if i % 50 == 2 else v
        out.append((i, None if i % 40 == 5 else f"e{i % 4}", v))
    return out


def plain(rows, ids, k, other):
    kept = [(i, e, np.array(v)) for i, e, v in rows if v is not None]
    units = neighbors.unit_rows(np.array([v for *_, v in kept]))
    similar = np.round(units @ units.T, 9)
    out = set()
    for q, (i, e, _) in enumerate(kept):
        if i in ids:
            found = sorted((-similar[q, j], x) for j, (x, o, _) in enumerate(kept) if x != i and not (other and e is not None and o == e))
            out |= {(i, x, round(-s, 6) + 0.0, n + 1) for n, (s, x) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("other", [False, True])
@pytest.mark.parametrize("tile, pivots", [(2048, None), (16, 7), (50, 1)])
def test_equals_all_pairs(spark, monkeypatch, other, tile, pivots):
    monkeypatch.setattr(neighbors, "TILE", tile)
    rows = rows_of(400, 1)
    df = spark.createDataFrame(rows, "review_id long, entity_id string, embedding array<double>")
    ids = df.where("review_id % 20 = 0 or review_id in (1, 51)").select("review_id")
    found, work = neighbors.nearest_join(df, ids, 5, other_entity=other, pivots=pivots)
    got = {(r.query_id, r.item_id, round(r.similarity, 6) + 0.0, r["rank"]) for r in found.collect()}
    assert got == plain(rows, {r.review_id for r in ids.collect()}, 5, other)
    w = work.first()
    assert w.n_items == sum(v is not None for *_, v in rows) and w.products <= w.n_queries * w.n_items


def test_clusters_are_pruned(spark):
    rows = [(i, e, v) for i, e, v in rows_of(3000, 2, 0.02) if v is not None and any(v)]
    df = spark.createDataFrame(rows, "review_id long, entity_id string, embedding array<double>")
    _, work = neighbors.nearest_join(df, df.where("review_id % 20 = 0").select("review_id"), 5)
    w = work.first()
    assert w.products < 0.35 * w.n_queries * w.n_items   # the third that is one vector is met by its own copies


def test_odd_tables(spark):
    schema = "review_id long, entity_id string, embedding array<double>"
    none = spark.createDataFrame([], schema)
    assert neighbors.nearest_join(none, none, 3)[0].collect() == []
    lone = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", None)], schema)
    assert neighbors.nearest_join(lone, lone, 3)[0].collect() == []
    zeros = spark.createDataFrame([(i, "a", [0.0, 0.0]) for i in range(4)], schema)
    got = {(r.query_id, r.item_id) for r in neighbors.nearest_join(zeros, zeros.where("review_id = 2"), 2)[0].collect()}
    assert got == {(2, 0), (2, 1)}
    # a list of many ids is joined too
    many = spark.createDataFrame([(i, "a", [float(i), 1.0]) for i in range(300)], schema)
    assert similarity.similar_reviews(many, list(range(290)), 2).count() == 580
    with pytest.raises(ValueError, match="999"):
        similarity.similar_reviews(many, [*range(290), 999], 2)


def test_a_query_that_meets_everything_is_one_row(spark, monkeypatch):
    """Vectors without clusters: nothing is pruned, and yet no query's vector is repeated for every unit."""
    r = np.random.default_rng(5)
    rows = [(i, f"e{i % 4}", r.standard_normal(24).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "review_id long, entity_id string, embedding array<double>")
    stored = {}

    def kept(table, label):
        stored[label] = table.cache()
        return stored[label]

    monkeypatch.setattr(neighbors, "via_table", kept)
    monkeypatch.setattr(neighbors, "STEP", 7)
    found, work = neighbors.nearest_join(df, df.where("review_id % 20 = 0").select("review_id"), 5)
    got = {(x.query_id, x.item_id, round(x.similarity, 6) + 0.0, x["rank"]) for x in found.collect()}
    assert got == plain(rows, set(range(0, 1500, 20)), 5, False)
    assert stored["visits"].count() == 75
    w = work.first()
    assert w.products > 0.5 * w.n_queries * w.n_items

"""Embedding whitening against numpy's eigenvectors, and on odd tables."""

import math

import numpy as np
import pytest

from revgauge.llm import whitening
from revgauge.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, x string, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "n", None) for i, v in rows], SCHEMA)


def plain(rows, k=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} and the covariance's falling eigenvalues."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, total = len(fit), [sum(int(v) for v in fit[:, j]) for j in range(fit.shape[1])]
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        for j in range(min(k, len(x))):
            z = (np.array(x) - fit.mean(axis=0)) @ vectors[:, j] / math.sqrt(values[j])
            out[i, j + 1] = (n, sum((n * v - s) ** 2 for v, s in zip(x, total)), abs(z), values[j] / np.trace(cov))
    return out, values


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, z, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(z, abs=1e-7) and r.explained == pytest.approx(share, rel=1e-10)
        assert r.identity_error < 1e-9


def test_query_equals_numpy(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op13_embedding_whitening"](spark, sf).collect(), plain(rows)[0])


def test_bad_rows_go_and_copies_count_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(40)]
    copies = [(100 + i, rows[0][1]) for i in range(30)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] * 6), (203, [math.inf] + [0.0] * 5),
           (204, []), (205, [1.0])]
    check(whitening.whiten(frame(spark, rows + copies + bad).repartition(7)).collect(), plain(rows + copies)[0])


def test_signs_and_coordinates_agree_over_rows_and_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    one, two = ({(r.vec_id, r.component): (r.whitened, r.deviation) for r in whitening.whiten(frame(spark, rows).repartition(k)).collect()}
                for k in (1, 5))
    assert one == two
    z = np.array([[one[i, j][0] for j in range(1, 5)] for i in range(60)])
    assert np.abs(z.T @ z / 60 - np.eye(4)).max() < 1e-9


@pytest.mark.parametrize("rows, zero", [
    ([(1, [1.0, 2.0, 3.0, 4.0, 5.0])], 4),                                   # one vector: no spread at all
    ([(1, [1.0] * 5), (2, [2.0] * 5), (2, [2.0] * 5), (None, [2.0] * 5)], 3),   # a line
    ([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], 0),                # two dimensions
])
def test_flat_directions_are_null(spark, rows, zero):
    got = whitening.whiten(frame(spark, rows)).collect()
    width = min(4, len(rows[0][1]))
    assert len(got) == width * len(rows)
    assert sum(r.whitened is None for r in got) == zero * len(rows)
    assert all((r.identity_error is None) == (zero == width) for r in got)
    assert all(r.identity_error is None or r.identity_error < 1e-9 for r in got)


def test_huge_entries_and_empty_tables(spark):
    got = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [1.0, -1e300])])).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id != 2)
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("values", [
    [5.0, 5.0, 5.0, 1.0] + [1.0] * 16, [1e6, 1 + 1e-9, 1.0, 1 - 1e-12] + [0.0] * 16, [0.0] * 20,
    [1.0, 0.999999, 0.99999, 0.9999] + [0.9] * 16, [3.0] + [-7.0] * 19])
def test_slices_find_close_and_repeated_eigenvalues(values):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((20, 20)))[0]
    a = (turn * np.array(values)) @ turn.T
    a = (a + a.T) / 2
    found, vectors = whitening.leading(a, 4)
    size = max(map(abs, values)) or 1.0
    assert np.abs(found - np.sort(values)[::-1][:4]).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * size


def test_inertia_counts_equal_numpy():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in rng.uniform(-8, 8, 10):
            assert whitening.above(a, shift) == int((values > shift).sum())
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1

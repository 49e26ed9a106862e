"""Most frequent n-grams by summaries and a recount against plain counting."""

from collections import Counter

import numpy as np
import pytest

from revgauge.operators import lexical


def texts(n, words, power, seed=3):
    r = np.random.default_rng(seed)
    share = 1.0 / np.arange(1, words + 1) ** power
    return [[f"w{w}" for w in r.choice(words, 200, p=share / share.sum())] for _ in range(n)]


def plain(rows, n, top):
    seen = Counter(" ".join(t[i:i + n]) for t in rows for i in range(len(t) - n + 1))
    return sorted(((-c, g) for g, c in seen.items()))[:top]


@pytest.mark.parametrize("n, power, tracked, named", [(1, 1.2, 2000, True), (2, 1.5, 4000, True), (2, 0.0, 100, False), (1, 1.2, 7, False)])
def test_top_is_exact(spark, n, power, tracked, named):
    rows = texts(300, 5000, power)
    df = spark.createDataFrame([(t,) for t in rows] + [([],), (None,)], "t array<string>").repartition(7)
    grams = lexical._ngram_rows(df, "t", n)
    found = lexical.heavy_candidates(grams, 10, tracked)
    want = plain(rows, n, 10)
    assert (found is not None) == named
    if named:
        assert {g for _, g in want} <= set(found) and len(found) < tracked / 4
    assert [(-r.n, r.ngram) for r in lexical._top(grams, 10, tracked).collect()] == want


def test_ties_and_few(spark):
    df = spark.createDataFrame([(["b", "a", "c", "a", "b"],)], "t array<string>")
    grams = lexical._ngram_rows(df, "t", 1)
    assert [tuple(r) for r in lexical._top(grams, 2).select("ngram", "n").collect()] == [("a", 2), ("b", 2)]
    assert len(lexical._top(grams, 9).collect()) == 3 and lexical._top(grams.where("false"), 3).collect() == []
    assert lexical.heavy_candidates(grams, 9) is None

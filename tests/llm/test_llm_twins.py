"""Verdicts of the outlier rules, the discriminant and the language profiles against plain numpy versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revgauge.llm import langid, outliers, quality
from revgauge.llm.base import crc_mod
from test_llm_text import plain_counts, plain_grams

SF = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_features(text):
    n, chars, symbols, dup, repeats, _ = plain_counts(text)
    lines = sum(1 for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
    return [np.log1p(n), np.log(max(chars, 1) / max(n, 1)), np.log1p(1000 * symbols / max(chars, 1)),
            18.5 * dup / max(lines, 1), 18.5 * repeats / max(n, 1)]


def plain_distances(x, floor, share=0.75, steps=4):
    """Squared distances to the estimate with the smaller determinant of two starts."""
    d = x.shape[1]
    factor = share / outliers.chi2_cdf(outliers.chi2_quantile(share, d), d + 2)
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    found = []
    for m, c in ((mid, np.diag((0.7413 * (high - low)) ** 2)), (x.mean(0), np.cov(x.T, bias=True))):
        v = c + np.diag(floor)
        for _ in range(steps):
            near = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)
            own = x[near <= np.quantile(near, share, method="inverted_cdf")]
            m, v = own.mean(0), factor * np.cov(own.T, bias=True) + np.diag(floor)
        found.append((np.linalg.slogdet(v)[1], np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)))
    return min(found, key=lambda f: f[0])[1]


@pytest.mark.parametrize("hot", [False, True])
def test_outliers(spark, monkeypatch, hot):
    """Large groups have their own estimate, small ones that of their whole language."""
    monkeypatch.setattr(outliers, "RANKS", 100_000)   # exact quantiles at this size
    docs = documents(spark)
    if hot:
        docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))
    rows = {r.doc_id: r for r in docs.collect()}
    passed = [d for d, r in rows.items() if not plain_counts(r.text)[5]]
    groups, langs = defaultdict(list), defaultdict(list)
    for d in passed:
        groups[rows[d].lang, rows[d].source].append(d)
        langs[rows[d].lang].append(d)
    x = {d: plain_features(rows[d].text) for d in passed}
    floor = np.array([0.25, 0.05, 0.5, 1.0, 1.0]) ** 2
    want = {}
    whole = {k: dict(zip(own, plain_distances(np.array([x[d] for d in own]), floor), strict=True))
             for k, own in langs.items() if len(own) >= 60}
    for (lang, _), own in groups.items():
        if len(own) >= 60:
            want.update(zip(own, plain_distances(np.array([x[d] for d in own]), floor), strict=True))
        else:
            want.update({d: whole.get(lang, {}).get(d) for d in own})
    got = {r.doc_id: r for r in outliers.quality_rules(docs).collect()}
    cut = outliers.chi2_quantile(0.99999, 5)
    assert len(got) == len(rows)
    for d, r in got.items():
        if d not in want or want[d] is None:
            assert r.d2 is None and r.kept == (d in want)
        else:
            assert abs(r.d2 - want[d]) <= 1e-6 * max(1, want[d]) and r.kept == (want[d] <= cut)


def test_one_extreme_share_is_rejected(spark):
    """Half the lines repeated, all else ordinary."""
    rng = np.random.default_rng(8)
    line = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10**6, 9))
    rows = [(i, "\n".join(line() for _ in range(12)), "en", "s") for i in range(200)]
    for i in (200, 201):
        own = [line() for _ in range(12)]
        short = [f"- {k}" for k in range(4)]
        rows.append((i, "\n".join(own + (short * 4 if i == 200 else [f"- {k}" for k in range(16)])), "en", "s"))
    got = {r.doc_id: r for r in outliers.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[200].base_failed and not got[200].kept and got[200].n_dup_lines == 12
    assert all(got[i].kept for i in range(200)) and got[201].kept


def test_discriminant(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    rows = {r.doc_id: np.array(quality.statistics((r.text or "").encode())) for r in documents(spark).collect()}
    learn = [d for d in labels if d in rows and zlib.crc32(str(d).encode()) % 4 != 2]
    x, y = np.array([rows[d] for d in learn]), np.array([labels[d] for d in learn])
    mean, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))

    def shrunk(x):
        n = np.expm1(x[:, :1])
        z = (x - mean) / scale * n / (n + 25)
        z[:, 0] = (np.maximum(x[:, 0], np.log1p(50)) - mean[0]) / scale[0]
        return z

    z = shrunk(x)
    inside = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    shared = sum((y == k).mean() * inside[k] for k in (0, 1))
    every = shrunk(np.array(list(rows.values())))
    density = []
    for k in (0, 1):
        v = 0.95 * inside[k] + 0.05 * shared
        v = 0.95 * v + 0.05 * np.trace(v) / len(v) * np.eye(len(v))
        gap = every - z[y == k].mean(0)
        density.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(v)[1]
                       - 0.5 * np.einsum("ij,ij->i", gap, np.linalg.solve(v, gap.T).T))
    want = dict(zip(rows, 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))), strict=True))
    labelled = spark.read.parquet(f"{SF}/labels.parquet")
    for r in quality.classify(documents(spark), labelled, crc_mod() == 2).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.7)


def plain_ranks(counts):
    code = lambda s: sum((0 if c == " " else ord(c)) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    every = Counter()
    for s, n in counts.items():
        every[code(s)] += n
    return {g: k for k, (g, _) in enumerate(sorted(every.items(), key=lambda e: (-e[1], e[0]))[:300], 1)}


def test_language_profiles(spark):
    rows = documents(spark).collect()
    learned = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            learned[r.lang].update(plain_grams(r.text))
    profiles = {lang: plain_ranks(c) for lang, c in sorted(learned.items())}
    docs = documents(spark)
    got = {r.doc_id: r for r in langid.predict(docs, langid.profiles(docs.where(crc_mod() != 2))).collect()}
    for r in rows:
        own, found = plain_ranks(plain_grams(r.text or "")), got[r.doc_id]
        if not own:
            assert (found.lang_pred, found.score) == ("und", 0.0)
            continue
        gaps = {lang: sum(abs(p[g] - k) if g in p else 300 for g, k in own.items()) for lang, p in profiles.items()}
        best, second = sorted(gaps.values())[:2]
        assert found.lang_pred == min(gaps, key=lambda lang: (gaps[lang], lang))
        assert abs(found.score - (second / (best + second) if best + second else 0.5)) < 1e-9

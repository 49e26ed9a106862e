"""What queries send, store and compute again."""

import contextlib
import io

from pyspark.sql import functions as F

from catalog import views as v
from revgauge import session
from revgauge.functions import text
from revgauge.operators import lexical, ranking
from revgauge.plans import stages


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_texts_are_cleaned_once(spark):
    body = "Things you value in your advisor: she\u2003listens,  explains\t and calls back &amp; keeps her word about \ufb06ocks"
    rows = spark.createDataFrame([(1, "a", "A", body, None), (2, "a", "A", body, None), (3, "a", "A", "too short", None)],
                                 "review_id long, entity_id string, entity_name string, review_text_raw string, reviewer_name string"
                                 ).withColumn("review_date", F.lit("2024-01-05").cast("timestamp_ntz"))
    out = stages.with_ngrams(stages.prepared_stage(stages.clean_stage(rows)))
    said = plan(out)
    assert said.count("_nfkc(") == said.count("_unescape(") == 1
    got = {r.review_id: r for r in out.collect()}
    assert set(got) == {1, 2}
    assert got[1].review_text_processed == "she listens, explains and calls back & keeps her word about stocks"
    assert got[1].total_tokens_raw == 12
    assert got[1].tokens_processed == ["listens,", "explains", "calls", "back", "keeps", "word", "stocks"]
    assert got[1].trigrams[0] == "listens, explains calls" and len(got[1].trigrams) == 5 and len(got[1].bigrams) == 6


def test_texts_come_in_pieces(spark, sf, monkeypatch):
    n = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum("n_chars")).first()[0]
    monkeypatch.setattr(session, "PIECE", n // 30)
    rows = v.text_reviews(spark, sf, pieces=True)
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.sum(F.length("review_text_raw")).alias("n")).collect()]
    assert len(sizes) > 16 and max(sizes) < n / 4
    count = lambda r: {tuple(x) for x in lexical.ngram_counts(r, text.tokenize_ws("review_text_clean"), 3).collect()}
    assert count(rows) == count(v.text_reviews(spark, sf))


def test_evidence_of_an_entity_comes_together_first(spark):
    rows = [(i, "hot" if i % 3 else f"e{i % 40}", "me" if i % 2 else "", f"text {i}", (i * 37 % 101) / 101, i / 300) for i in range(300)]
    df = spark.createDataFrame(rows, "review_id long, entity_id string, reviewer_name string, review_text_raw string, sim_a double, "
                               "sim_b double").withColumn("review_date", F.lit("2024-01-05").cast("timestamp_ntz"))
    out = ranking.evidence_topk(df, ["a", "b"])
    assert out.columns == ["review_id", "entity_id", "reviewer", "review_day", "snippet", "dim", "score", "tier", "rank"]
    assert "rebalance_partitions_by_col" in plan(out).lower()
    want = set()
    for k, dim in ((4, "a"), (5, "b")):
        for e in {r[1] for r in rows}:
            best = sorted((r for r in rows if r[1] == e), key=lambda r: (-r[k], r[0]))[:3]
            want |= {(r[0], e, r[2] or "Anonymous", r[3], dim, r[k], n + 1) for n, r in enumerate(best)}
    got = [(r.review_id, r.entity_id, r.reviewer, r.snippet, r.dim, r.score, r["rank"]) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)

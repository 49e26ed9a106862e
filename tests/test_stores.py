"""Sources, identity, incremental stores, streams, stages and the query surface."""

import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import dates
from revgauge.operators import corpus, dedup, encode, filters, groups, intake, sampling, validate
from revgauge.plans import stages
from revgauge.plans.surface import ReviewQueries
from revgauge.sources import artifacts
from revgauge.sources.reviews import raw_file_meta, read_reviews_csv
from revgauge.streaming import ingest

BODY = "they listen well and explain every plan in clear words number"


def export_rows():
    rows = []
    for i in range(40):
        firm = i % 4 == 0
        page = f"https://x.org/{'advisory-firms' if firm else 'people'}/p{i % 8}/"
        rows.append({"ID": i, " Title": "T, \"q\"", "Content": f"{BODY} {i}.\nSecond line, with \"quotes\".",
                     "Date": f"20{15 + i % 9}-03-0{1 + i % 9} 10:00:00", "notification_name": f"Jane P{i % 8}, CFP ",
                     "notification_page": page, "reviewer_name": f"R{i}", "acf_rating": str(1 + i % 5), "extra": "z",
                     "Post Modified Date": "2024-01-01"})
    rows[1].update({"Content": None})
    rows[2].update({"notification_page": None, "acf_rating": "five"})
    rows[3].update({"Date": "soon"})
    rows[4].update({"notification_page": "https://x.org/people/test/"})
    rows[5].update({"Date": "2010-01-01 00:00:00", "Post Modified Date": None})
    rows.append(dict(rows[6]))
    return rows


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "export.csv"
    pd.DataFrame(export_rows()).to_csv(path, index=False)
    return str(path)


def test_read_csv(spark, csv, tmp_path):
    got = read_reviews_csv(spark, csv).toPandas()
    want = pd.read_csv(csv, dtype=str)
    assert list(got.columns) == [c.strip() for c in want.columns]
    want.columns = got.columns
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None))
    meta = raw_file_meta(spark, csv).first()
    assert meta.sha256 == hashlib.sha256(open(csv, "rb").read()).hexdigest() and meta.bytes == os.path.getsize(csv)
    bad = tmp_path / "bad.csv"
    bad.write_text("Content,acf_rating\nx,1\n")
    with pytest.raises(ValueError, match="Missing expected columns"):
        read_reviews_csv(spark, str(bad))


def test_standard_and_clean(spark, csv):
    standard = stages.standard_stage(read_reviews_csv(spark, csv), ["https://x.org/people/test/"])
    p = standard.toPandas().set_index("review_id")
    assert len(p) == 40 and 4 not in p.index
    assert p.loc[2].entity_id == "Jane P2, CFP" and pd.isna(p.loc[2].rating)
    assert str(p.loc[3].review_date) == "2024-01-01 00:00:00" and p.loc[1].review_text_raw == ""
    clean = stages.clean_stage(standard)
    assert 1 not in clean.toPandas().review_id.tolist()
    q = corpus.quality_summary(standard).first()
    assert q.n_rows == 40 and q.text_empty_frac == pytest.approx(1 / 40)
    report = {r.column_name: r.missing_count for r in corpus.missing_report(standard).collect()}
    assert report["Content"] == 1 and report["notification_page"] == 1 and report["Date"] == 1


def test_strict_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("soon",)], "d string")
    assert [r.d is None for r in intake.coerce_dates(df, ["d"]).collect()] == [False, True]
    with pytest.raises(Exception, match="could not be parsed: soon"):
        intake.coerce_dates(df, ["d"], strict=True).collect()


def test_artifacts(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a &amp; b", None), (2, "x,\n\"y\"", 0.5)], "i int, t string, v double")
    artifacts.write_artifacts({"c": df, "p": df, "l": df, "s": df.limit(1)}, root, {"c": "csv", "l": "jsonl", "s": "json"})
    got = artifacts.load_artifacts(spark, root, {"c": df.schema})
    for name in ("c", "p", "l"):
        assert sorted((r.i, r.t, r.v) for r in got[name].collect()) == [(1, "a & b", None), (2, "x,\n\"y\"", 0.5)]
    assert got["s"].count() == 1
    with pytest.raises(ValueError):
        artifacts.write_artifacts({"c": df}, root, {"c": "xml"})
    assert artifacts.read_table(spark, root, "parquet", "absent", df.schema).count() == 0
    assert artifacts.read_table(spark, root, "xml", "c").count() == 0
    # a manifest and a document as another writer lays them out
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "metadata.json").write_text(json.dumps(
        {"run_id": "r", "artifact_manifest": [{"name": "doc", "type": "json", "path": "doc.json"},
                                              {"name": "gone", "type": "csv", "path": "gone.csv"}]}, indent=2))
    (tmp_path / "other" / "doc.json").write_text(json.dumps({"n_rows": 5, "name": "A &lt; B"}, indent=2))
    other = artifacts.load_artifacts(spark, str(tmp_path / "other"))
    assert other["doc"].first().asDict() == {"n_rows": 5, "name": "A < B"} and other["gone"].count() == 0
    assert artifacts.load_artifacts(spark, str(tmp_path / "nowhere")) == {}


def _reviews(spark, rows):
    return dedup.with_review_hash(spark.createDataFrame(
        rows, "review_id long, entity_id string, review_text_raw string, review_date string, reviewer_name string")
        .withColumn("review_date", dates.parse_date("review_date")))


BASE = (1, "e", "Great advisor!", "2024-01-01", "Al")


@pytest.mark.parametrize("second, kept", [
    ((2, "e", "Great advisor!", "2024-01-02", "Al"), 2),      # other day
    ((2, "e", "Great advisor!", "2024-01-01", "Bo"), 2),      # other client, same day
    ((2, "e", "Great advisor!", "2024-01-01", "Al"), 1),      # submitted twice
    ((2, "e", "Great advisor!", "2024-01-01 18:30:00", " Al "), 1),   # same day and client
    ((2, "e", "Great advisor", "2024-01-01", "Al"), 2),       # edited
    ((2, "f", "Great advisor!", "2024-01-01", "Al"), 2),      # other entity
])
def test_identity(spark, second, kept):
    got = dedup.keep_first(_reviews(spark, [BASE, second])).collect()
    assert len(got) == kept and min(r.review_id for r in got) == 1


def test_incremental(spark):
    first = _reviews(spark, [BASE, (2, "e", "b", "2024-01-01", "Al"), (3, "e", "b", "2024-01-01", "Al")])
    seen = []

    def process(fresh):
        seen.append(fresh.count())
        return fresh.withColumn("done", F.lit(True))

    store = dedup.incremental_append(first, None, process)
    assert seen == [2] and store.count() == 2
    again = dedup.incremental_append(first, store, process)
    assert seen == [2, 0] and again.count() == 2
    more = _reviews(spark, [BASE, (9, "e", "edited", "2024-01-01", "Al")])
    grown = dedup.incremental_append(more, store, process)
    assert seen[-1] == 1 and grown.count() == 3
    assert dedup.snapshot_prune(grown, more).count() == 2
    dedup.incremental_append(more, store, process, full=True)
    dedup.incremental_append(more, store.drop("review_hash"), process)
    assert seen[-2:] == [2, 2]


def test_group_of_copies(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("review_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("review_hash"))
    got = dedup.keep_first(rows)
    assert got.count() == 20_001 and got.where("review_hash = 'copy'").first().review_id == 0
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_stream_in_steps(spark, tmp_path):
    src, store, mark = (str(tmp_path / n) for n in ("src", "store", "mark"))
    batches = [[BASE, (2, "e", "b", "2024-01-01", "Al"), (3, "e", "b", "2024-01-01", "Al")],
               [(7, "e", "b", "2024-01-01", "Al"), (8, "e", "c", "2024-01-05", "Al")]]
    ids = []
    for b in batches:
        _reviews(spark, b).write.mode("append").parquet(src)
        stream = spark.readStream.schema(_reviews(spark, b).schema).parquet(src)
        ingest.append_new_reviews(stream, store, mark).awaitTermination()
        ids.append(sorted(r.review_id for r in ingest.review_store(spark, store).rows().collect()))
    assert ids == [[1, 2], [1, 2, 8]]
    volume, vmark = str(tmp_path / "volume"), str(tmp_path / "vmark")
    ingest.write_volume(ingest.review_volume(stream), volume, vmark).awaitTermination()
    got = {str(r.period_start)[:10]: r.n for r in ingest.read_volume(spark, volume).collect()}
    assert got == {"2024-01-01": 4, "2024-01-05": 1}
    within = ingest.dedup_within(stream).writeStream.format("memory").queryName("within").option(
        "checkpointLocation", str(tmp_path / "within")).trigger(availableNow=True).start()
    within.awaitTermination()
    assert spark.table("within").count() == 3


@pytest.fixture(scope="module")
def run(spark, csv, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    return stages.run_all(spark, csv, out, ["https://x.org/people/test/"], size=64, groups=[("PG-A", "A"), ("PG-B", "B")])


def test_all_stages(spark, run, csv, tmp_path):
    embedded = run["embedded"].toPandas()
    # test entity, empty text, early date, and a copy are gone
    assert len(embedded) == 37 and embedded.review_hash.is_unique
    assert not embedded.review_text_processed.str.contains("jane").any()
    assert embedded.embedding.map(len).unique().tolist() == [64]
    entities = run["entity_dimension_scores"].toPandas()
    assert set(entities.entity_type) == {"firm", "advisor"} and entities.review_count.sum() == 37
    assert [c for c in entities if c.startswith("sim_")] == [f"sim_{m}_{d}" for m in fv.METHODS for d in fv.DIMENSIONS]
    assert run["top_tokens"].count() <= 40
    groups_ = run["partner_groups"].toPandas()
    assert set(groups_.partner_group_code) <= {"PG-A", "PG-B"}
    # a second run over the same export encodes nothing
    store = run["embedded"]
    assert stages.embed_stage(run["reviews_clean"], store, size=64).count() == 0


def test_encoders(spark):
    df = spark.createDataFrame([(1, "good plan"), (2, ""), (3, None), (4, "good plan")], "i int, t string")
    rows = {r.i: r.embedding for r in encode.encode_text(df, "t", size=16).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1) and rows[1] == rows[4] and not any(rows[2])

    def make():
        import numpy as np
        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts])

    own = {r.i: r.embedding for r in encode.encode_text(df, "t", make, normalize=False).collect()}
    assert own[1] == [9.0, 1.0, 0.0] and own[3] == [0.0, 1.0, 0.0]


def test_surface(spark, run):
    firm = spark.createDataFrame([("f1", "https://x.org/people/p1/", "d1", 80.0, 0.8, 3), ("f1", "e2", "d2", 60.0, 0.5, 1)],
                                 "firm_id string, entity_id string, dimension string, score double, confidence double, review_count long")
    q = ReviewQueries(spark, {"reviews": run["reviews_clean"], "review_scores": run["review_dimension_scores"],
                              "entity_scores": run["entity_dimension_scores"], "partner_groups": run["partner_groups"],
                              "firm_scores": firm, "firm_benchmarks": firm})
    eid = "https://x.org/people/p1/"
    assert q.entity_profile(eid).count() == 7 and q.percentile_scores(eid).count() == 6
    assert q.leaderboard(top_n=2).count() == 14 and q.leaderboard(dimension="composite").count() <= 10
    assert q.firm_summary("f1").first().avg_score == 70 and q.firms().count() == 1
    assert q.firm_summary("nope").count() == 0 and q.firm_entity("f1", eid)["scores"].count() == 1
    assert q.firm_personas("f1").where("persona = 'Headliner'").count() == 1
    assert q.macro_sample(5).count() == 5 and q.macro_totals().first().review_count == 37
    assert q.entities().count() == q.distributions().where("dim = 'trust_integrity'").count()
    assert q.review(0).first().review_id == "0" and q.scored_review(0).count() == 1
    assert q.partner_groups().count() >= 1 and q.partner_group("PG-A").count() % 7 == 0
    assert q.comparison([eid]).count() == 7 and q.head_to_head(eid, eid).where("diff_raw <> 0").count() == 0
    assert q.pool_stats()["totals"].count() == 2 and q.population_medians().count() == 6
    assert q.method_breakpoints(entity_type="all").count() == 6 and q.stopwords().count() == len(set(fv.REPORT_STOPWORDS))
    charts = q.eda_charts(lexical_n=2, exclude_stopwords=True, token_categories=["low", "medium"])
    assert set(charts) == {"summary", "quality", "coverage", "rating_distribution", "reviews_over_time",
                           "reviews_per_entity", "token_counts", "rating_vs_tokens", "lexical", "meta"}
    for block in charts.values():
        block.collect()
    scoped = q.eda_charts(scope="firm", firm_id="f1", rating=2)
    assert scoped["summary"].first().reviews <= scoped["meta"].first().row_count
    for bad in ({"scope": "firm"}, {"rating": 6}, {"min_tokens": -1}, {"lexical_n": 6}, {"lexical_top_n": 0},
                {"time_freq": "day"}):
        with pytest.raises(ValueError):
            q.eda_charts(**bad)
    for call in (lambda: q.leaderboard(top_n=51), lambda: q.leaderboard(method="x"), lambda: q.pool_stats(0),
                 lambda: q.macro_totals(-1)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(LookupError):
        ReviewQueries(spark, {}).firms()


def test_validation(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, t string")
    b = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    got = validate.validate_artifacts(spark, {"same": a, "less": a, "types": a, "gone": None, "new": a},
                                      {"same": a, "less": b, "types": a.withColumn("i", F.col("i").cast("long"))})
    assert {r.artifact: (r.status, r.n_different) for r in got.collect()} == {
        "same": ("OK", 0), "less": ("DIFF", 1), "types": ("DIFF", None), "gone": ("MISSING", None), "new": ("NO BACKUP", None)}
    assert not validate.all_valid(got) and validate.all_valid(got.where("artifact IN ('same', 'new')"))


def test_time_buckets_add_up(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2020-11-03', timestamp_ntz'2021-03-09', interval 17 days)) AS review_date "
                   "UNION ALL SELECT timestamp_ntz'2022-08-08' UNION ALL SELECT NULL")
    for freq, first, last, periods in (("month", "2020-11", "2022-08", 22), ("quarter", "2020-Q4", "2022-Q3", 8),
                                       ("year", "2020", "2022", 3)):
        rows = corpus.reviews_over_time(df, freq).collect()
        assert (rows[0].period, rows[-1].period, len(rows)) == (first, last, periods)
        assert sum(r.n for r in rows) == 9
    assert corpus.reviews_over_time(df.where("review_date IS NULL")).count() == 0


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("review_id"))
    a, b = (sorted(r[0] for r in sampling.sample_rows(df.repartition(n), 20).collect()) for n in (1, 7))
    assert a == b and len(a) == 20 and sampling.sample_rows(df, 9999).count() == 500


def test_group_revalidation(spark):
    g = spark.createDataFrame([("a", "1", "n"), ("b", "1", "n")], "entity_id string, partner_group_code string, partner_group_name string")
    e = spark.createDataFrame([("a",)], "entity_id string")
    assert groups.group_revalidation(g, e).first().asDict() == {"n_members": 2, "n_stale": 1, "keep": False}
    assert groups.group_revalidation(g, g).first().keep


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "one two three four five"), (2, "b", "   "), (3, None, None), (4, "c", "short")],
                               "review_id long, entity_id string, review_text_clean string")
    assert [r.review_id for r in filters.embeddable_rows(df).collect()] == [1]
    assert sorted(r.review_id for r in filters.min_text_length(df).collect()) == [1]
    assert sorted(r.review_id for r in filters.exclude_entities(df, ["a"]).collect()) == [2, 3, 4]
    counts = corpus.reviews_per_entity(df)
    assert counts.count() == 3


def test_json_keeps_every_row(spark, tmp_path):
    rows = spark.range(5).select("id", F.lit("a & b").alias("t"))
    artifacts.write_artifacts({"many": rows, "one": rows.limit(1), "none": rows.limit(0)}, str(tmp_path), dict.fromkeys(("many", "one", "none"), "json"))
    got = artifacts.load_artifacts(spark, str(tmp_path), {"none": rows.schema})
    assert {k: t.count() for k, t in got.items()} == {"many": 5, "one": 1, "none": 0}


def test_unreadable_is_not_absent(spark, tmp_path):
    """Only a missing path means an empty table; a broken one must not."""
    (tmp_path / "broken.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        artifacts.read_table(spark, str(tmp_path), "parquet", "broken.parquet").collect()
    assert artifacts.read_table(spark, str(tmp_path), "parquet", "gone.parquet").collect() == []

"""Sources, sinks, standard columns, filters, identity and stores."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, shaped, table
from revgauge.functions import dates
from revgauge.operators import dedup, filters, intake, scoring, validate
from revgauge.session import scratch_dir
from revgauge.sources import artifacts
from revgauge.sources import reviews as source


def raw_export(spark, d):
    """The reviews in the raw export's columns, as text."""
    r = v.text_reviews(spark, d)
    page = F.when(F.col("entity_id") % 3 > 0, F.concat(
        F.when(F.col("entity_type") == "firm", "/advisory-firms/").otherwise("/people/"), F.col("entity_id")))
    return r.select(
        F.col("review_id").cast("string").alias("ID"), F.lit("A title, \"quoted\"").alias("Title"),
        F.col("review_text_raw").alias("Content"),
        F.when(F.col("review_id") % 4 > 0, F.date_format("review_date", "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("Date"),
        F.date_format("review_date", "yyyy-MM-dd").alias("Post Modified Date"), page.alias("notification_page"),
        F.concat(F.lit(" "), F.col("entity_name")).alias("notification_name"),
        F.col("reviewer_name"), F.coalesce(F.col("rating").cast("int").cast("string"), F.lit("n/a")).alias("acf_rating"))


RAW = f"""{v.F1}, raw AS (SELECT review_id, review_text_raw,
  CASE WHEN entity_id % 3 > 0 THEN CASE WHEN entity_type = 'firm' THEN '/advisory-firms/' ELSE '/people/' END || entity_id
    ELSE entity_name END AS entity_id, entity_name,
  CASE WHEN review_id % 4 > 0 THEN strftime(review_date, '%Y-%m-%d %H:%M:%S')
    ELSE strftime(review_date, '%Y-%m-%d 00:00:00') END AS review_date, reviewer_name, rating FROM f1)"""


@query("read_reviews_csv", f"""WITH {v.F1} SELECT CAST(review_id AS VARCHAR) AS "ID", 'A title, "quoted"' AS "Title",
  review_text_raw AS "Content", CASE WHEN review_id % 4 > 0 THEN strftime(review_date, '%Y-%m-%d %H:%M:%S') ELSE 'soon' END AS "Date",
  strftime(review_date, '%Y-%m-%d') AS "Post Modified Date", CASE WHEN entity_id % 3 > 0 THEN CASE WHEN entity_type = 'firm'
    THEN '/advisory-firms/' ELSE '/people/' END || entity_id END AS notification_page, ' ' || entity_name AS notification_name,
  reviewer_name, coalesce(CAST(CAST(rating AS INT) AS VARCHAR), 'n/a') AS acf_rating FROM f1""")
def read_reviews_csv(spark, d):
    path = scratch_dir(spark, "export")
    # pandas-style quoting on the way out; a blank in front of a column name must not matter
    raw_export(spark, d).withColumnRenamed("Title", " Title ").write.options(
        header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return shaped(source.read_reviews_csv(spark, path).select(*raw_export(spark, d).columns))


def _stored_artifacts(spark, d):
    root = scratch_dir(spark, "artifacts")
    reviews = v.text_reviews(spark, d)
    per_entity = reviews.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"),
                                                  F.min("entity_name").alias("entity_name"))
    marked = per_entity.withColumn("entity_name", F.concat("entity_name", F.lit(" &amp; Co")))
    artifacts.write_artifacts({"by_csv": marked, "by_parquet": marked, "by_jsonl": marked, "by_json": marked,
                               "summary": reviews.agg(F.count(F.lit(1)).alias("n_rows"))}, root,
                              {"by_csv": "csv", "by_jsonl": "jsonl", "by_json": "json", "summary": "json"})
    return artifacts.load_artifacts(spark, root)


@query("load_artifacts", f"""WITH {v.F1}, e AS (SELECT entity_id, count(*) AS n, min(entity_name) || ' & Co' AS entity_name
  FROM f1 GROUP BY entity_id)
SELECT k AS kind, entity_id, n, entity_name FROM e, (SELECT unnest(['by_csv', 'by_parquet', 'by_jsonl', 'by_json']) AS k)""")
def load_artifacts(spark, d):
    got = _stored_artifacts(spark, d)
    part = lambda k: got[k].select(F.lit(k).alias("kind"), F.col("entity_id").cast("bigint"),
                                   F.col("n").cast("bigint"), "entity_name")
    return shaped(part("by_csv").unionByName(part("by_parquet")).unionByName(part("by_jsonl")).unionByName(part("by_json")))


@query("write_artifacts", """SELECT k AS kind, CASE k WHEN 'summary' THEN (SELECT count(*) FROM documents) ELSE CAST(sum(n) AS BIGINT) END AS total,
  CASE k WHEN 'summary' THEN 1 ELSE count(*) END AS n_rows
FROM (SELECT user_id, count(*) AS n FROM documents JOIN events ON event_id = doc_id GROUP BY user_id),
  (SELECT unnest(['by_csv', 'by_parquet', 'by_jsonl', 'by_json', 'summary']) AS k) GROUP BY k""")
def write_artifacts(spark, d):
    got = _stored_artifacts(spark, d)
    parts = [got[k].select(F.lit(k).alias("kind"), F.col("n_rows" if k == "summary" else "n").cast("bigint").alias("n"))
             for k in ("by_csv", "by_parquet", "by_jsonl", "by_json", "summary")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return shaped(rows.groupBy("kind").agg(F.sum("n").alias("total"), F.count("*").alias("n_rows")))


@query("sanitize_nulls", """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE o_totalprice END AS x
FROM orders""")
def sanitize_nulls(spark, d):
    odd = F.when(F.col("o_orderstatus") == "F", float("nan")).when(F.col("o_orderstatus") == "P", float("-inf"))
    rows = table(spark, d, "orders").select("o_orderkey", odd.otherwise(F.col("o_totalprice")).alias("x"))
    return shaped(intake.sanitize_nulls(rows))


@query("validate_artifacts", """SELECT 'customers' AS artifact, 'OK' AS status, CAST(0 AS BIGINT) AS n_different
UNION ALL SELECT 'orders', 'DIFF', 2 * count(*) FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT 'gone', 'MISSING', -1 UNION ALL SELECT 'new', 'NO BACKUP', -1""")
def validate_artifacts(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_totalprice") > 400000, F.lit(-1.0)).otherwise(
        F.col("o_totalprice")))
    statuses = validate.validate_artifacts(
        spark, {"customers": customers, "orders": orders, "gone": None, "new": customers},
        {"customers": customers.repartition(3), "orders": changed, "gone": orders})
    return shaped(statuses.fillna(-1, ["n_different"]))


@query("standardize_reviews", f"""WITH {RAW} SELECT CAST(review_id AS VARCHAR) AS "ID", entity_id, entity_name,
  review_text_raw, review_date, rating FROM raw""")
def standardize_reviews(spark, d):
    return shaped(intake.standardize_reviews(raw_export(spark, d)).select(
        "ID", "entity_id", "entity_name", "review_text_raw", "review_date", "rating"))


@query("coerce_dates", f"""WITH {RAW} SELECT review_id, CASE WHEN review_id % 4 > 0 THEN review_date END AS d FROM raw""")
def coerce_dates(spark, d):
    rows = intake.coerce_dates(raw_export(spark, d), ["Date", "Absent"])
    return shaped(rows.select(F.col("ID").cast("bigint").alias("review_id"), F.col("Date").alias("d")))


@query("coerce_dates_written_out", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 6 THEN NULL WHEN 0 THEN
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS d FROM orders""")
def coerce_dates_written_out(spark, d):
    """Dates written in six ways, and one that is none."""
    ways = ["yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd"]
    text = F.lit("no date")
    for i, way in enumerate(ways):
        text = F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", way)).otherwise(text)
    return shaped(intake.coerce_dates(table(spark, d, "orders").select("o_orderkey", text.alias("d")), ["d"]))


@query("coerce_rating", f"WITH {v.F1} SELECT review_id, rating FROM f1")
def coerce_rating(spark, d):
    rows = intake.coerce_rating(raw_export(spark, d))
    return shaped(rows.select(F.col("ID").cast("bigint").alias("review_id"), "rating"))


@query("entity_type", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'firm' ELSE 'advisor' END AS entity_type FROM pages")
def entity_type(spark, d):
    return shaped(intake.with_entity_type(table(spark, d, "pages"), "url", "/en/").select("page_id", "entity_type"))


@query("rename_project", "SELECT doc_id AS review_id, lang, n_chars AS raw_len FROM documents")
def rename_project(spark, d):
    return shaped(intake.rename_project(table(spark, d, "documents"), {"doc_id": "review_id", "n_chars": "raw_len"},
                                        ["review_id", "absent", "lang", "raw_len"]))


@query("token_count_fallback", f"WITH {v.F1} SELECT review_id, token_count FROM f1")
def token_count_fallback(spark, d):
    rows = v.text_reviews(spark, d).withColumnRenamed("token_count", "clean_token_count")
    return shaped(intake.token_count_fallback(rows).select("review_id", "token_count"))


@query("review_year", "SELECT o_orderkey, year(o_orderdate) AS review_year FROM orders")
def review_year(spark, d):
    return shaped(intake.with_review_year(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "review_year"))


@query("exclude_test_entities", """SELECT event_id FROM events WHERE user_id NOT IN (
  SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def exclude_test_entities(spark, d):
    listed = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return shaped(filters.exclude_entities(table(spark, d, "events"), listed, "user_id").select("event_id"))


@query("exclusion_report", f"""WITH {v.F1} SELECT count(*) AS n_before,
  count(*) FILTER (entity_name NOT IN ('Der Und', 'In The')) AS n_kept,
  count(*) FILTER (entity_name IN ('Der Und', 'In The')) AS n_dropped FROM f1""")
def exclusion_report(spark, d):
    return shaped(filters.exclusion_report(v.text_reviews(spark, d), ["Der Und", "In The"], "entity_name"))


@query("min_text_length", f"WITH {v.F1} SELECT review_id FROM f1 WHERE length(review_text_clean) > 5")
def min_text_length(spark, d):
    return shaped(filters.min_text_length(v.text_reviews(spark, d)).select("review_id"))


@query("date_floor", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) > 1996")
def date_floor(spark, d):
    return shaped(filters.date_floor(table(spark, d, "orders"), "o_orderdate", 1996).select("o_orderkey"))


@query("embeddable_rows", f"WITH {v.F1} SELECT review_id FROM f1 WHERE token_count >= 5")
def embeddable_rows(spark, d):
    return shaped(filters.embeddable_rows(v.text_reviews(spark, d)).select("review_id"))


@query("review_lookup", f"""WITH {v.F1} SELECT CAST(review_id AS VARCHAR) AS review_id,
  strftime(review_date, '%Y-%m-%d %H:%M:%S') AS review_date, rating, token_count, entity_name, reviewer_name
FROM f1 WHERE review_id = 42""")
def review_lookup(spark, d):
    return shaped(filters.review_lookup(v.text_reviews(spark, d), "42"))


@query("attach_firm", f"""WITH {v.F1}, {v.FIRMS}, m AS (SELECT DISTINCT entity_id, firm_id FROM fs)
SELECT review_id, entity_id, firm_id FROM f1 LEFT JOIN m USING (entity_id)""")
def attach_firm(spark, d):
    return shaped(intake.with_firm(v.text_reviews(spark, d), v.firm_scores(spark, d)).select(
        "review_id", "entity_id", "firm_id"))


@query("semi_join_entities", f"""WITH {v.F1} SELECT review_id FROM f1 WHERE entity_id IN (
  SELECT entity_id FROM f1 GROUP BY entity_id HAVING count(*) >= {v.PREMIER_TEXT})""")
def semi_join_entities(spark, d):
    reviews = v.text_reviews(spark, d)
    many = reviews.groupBy("entity_id").count().where(F.col("count") >= v.PREMIER_TEXT)
    return shaped(filters.reviews_of(reviews, many).select("review_id"))


@query("attach_review_meta", f"""WITH {v.RS} SELECT review_id, {", ".join(
    f"round(max(score) FILTER (dim = '{n}'), 6) + 0.0 AS sim_{n}" for n in v.DIMS)}, reviewer_name,
  strftime(review_date, '%Y-%m-%d %H:%M:%S') AS review_date FROM rs GROUP BY review_id, reviewer_name, review_date""")
def attach_review_meta(spark, d):
    hashed = v.vector_reviews(spark, d).withColumn("review_hash", F.sha2(F.col("review_id").cast("string"), 256))
    scored = scoring.review_scores(hashed, v.queries_of(spark, d), keep=("review_hash", "review_id"))
    # every review stored twice: meta must not multiply rows
    twice = hashed.unionByName(hashed)
    return shaped(scoring.attach_review_meta(scored, twice).select(
        "review_id", *[f"sim_{n}" for n in v.DIMS], "reviewer_name", "review_date"))


# identity and stores

def content_rows(spark, d):
    """Documents identified by source and text alone, so that copies share a hash."""
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("entity_id"), F.col("text").alias("review_text_raw"),
        F.lit(None).cast("timestamp_ntz").alias("review_date"), F.lit(None).cast("string").alias("reviewer_name"))
    return dedup.with_review_hash(rows)


CONTENT = """ct AS (SELECT doc_id AS review_id, source, substr(sha256(source || '||' || text || '||no_date||anonymous'), 1, 16)
  AS review_hash FROM documents)"""
STORED_SQL = "source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8')"
STORED = STORED_SQL.replace("source", "entity_id")


@query("keep_first_dedup", f"WITH {CONTENT} SELECT min(review_id) AS review_id, review_hash FROM ct GROUP BY review_hash")
def keep_first_dedup(spark, d):
    return shaped(dedup.keep_first(content_rows(spark, d)).select("review_id", "review_hash"))


@query("delta_anti_join", f"""WITH {CONTENT} SELECT review_id, review_hash FROM ct WHERE review_hash NOT IN (
  SELECT review_hash FROM ct WHERE {STORED_SQL})""")
def delta_anti_join(spark, d):
    rows = content_rows(spark, d)
    return shaped(dedup.new_rows(rows, rows.where(STORED)).select("review_id", "review_hash"))


@query("incremental_append", f"""WITH {CONTENT}, st AS (SELECT min(review_id) AS review_id, review_hash FROM ct
  WHERE {STORED_SQL} GROUP BY review_hash)
SELECT review_id, review_hash, 'stored' AS origin FROM st
UNION ALL SELECT min(review_id), review_hash, 'new' FROM ct WHERE review_hash NOT IN (SELECT review_hash FROM st)
GROUP BY review_hash""")
def incremental_append(spark, d):
    rows = content_rows(spark, d).select("review_id", "entity_id", "review_hash")
    store = dedup.keep_first(rows.where(STORED)).withColumn("origin", F.lit("stored"))
    out = dedup.incremental_append(rows, store, lambda fresh: fresh.withColumn("origin", F.lit("new")))
    return shaped(out.select("review_id", "review_hash", "origin"))


@query("snapshot_prune", f"""WITH {CONTENT}, first AS (SELECT min(review_id) AS review_id, review_hash FROM ct
  GROUP BY review_hash)
SELECT review_id, review_hash FROM first WHERE review_hash IN (SELECT review_hash FROM ct WHERE {STORED_SQL})""")
def snapshot_prune(spark, d):
    rows = content_rows(spark, d)
    return shaped(dedup.snapshot_prune(dedup.keep_first(rows), rows.where(STORED)).select("review_id", "review_hash"))


@query("union_embeddings", """SELECT vec_id, CAST(label AS BIGINT) AS label, -1 AS doc_id, -1 AS quality
FROM embeddings UNION ALL SELECT -1, -1, doc_id, quality FROM labels""")
def union_embeddings(spark, d):
    emb, labels = table(spark, d, "embeddings"), table(spark, d, "labels")
    both = dedup.union_by_name(emb.select("vec_id", "label"), labels.select("doc_id", "quality"))
    return shaped(both.fillna(-1))


@query("drop_exact_duplicates", "SELECT DISTINCT lang, source, text FROM documents")
def drop_exact_duplicates(spark, d):
    return shaped(dedup.drop_exact_duplicates(table(spark, d, "documents").select("lang", "source", "text")))


# dates

@query("age_years_days", """SELECT o_orderkey, round(floor(date_diff('microsecond', o_orderdate,
  TIMESTAMP '2001-05-05 13:30:00') / 1e6 / 86400) / 365.25::DOUBLE, 6) AS age FROM orders""")
def age_years_days(spark, d):
    as_of = F.lit("2001-05-05 13:30:00").cast("timestamp_ntz")
    return shaped(table(spark, d, "orders").select("o_orderkey", dates.age_years_days("o_orderdate", as_of).alias("age")))


@query("age_years_exact", """SELECT event_id, round(greatest(0, date_diff('microsecond', ts,
  TIMESTAMP '2024-01-15 00:00:00') / 1e6 / (365.25::DOUBLE * 86400)), 6) AS age FROM events""")
def age_years_exact(spark, d):
    as_of = F.lit("2024-01-15").cast("timestamp_ntz")
    return shaped(table(spark, d, "events").select("event_id", dates.age_years_exact("ts", as_of).alias("age")))


@query("period_label", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
  year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y') AS year FROM orders""")
def period_label(spark, d):
    return shaped(table(spark, d, "orders").select("o_orderkey", *[
        dates.period_label("o_orderdate", f).alias(f) for f in ("month", "quarter", "year")]))

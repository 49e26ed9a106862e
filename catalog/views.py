"""The driver's tables seen as reviews, vectors, groups and firm scores, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import table
from revgauge import fixed_values as fv
from revgauge.functions import text
from revgauge.operators import rollup, scoring
from revgauge.session import in_pieces, spread, via_table

DIMS = ("trust", "listening", "clarity", "responsiveness", "life_events", "expertise")
NAMES = ("The Eron, CFP®", "Ander Onth", "La Réaux", "Der Und", "Que Ción", "In The", "MS Jdan")
PREMIER_TEXT = 10
PREMIER_VECTOR = 70
DAYS_PER_YEAR = 1.0   # the events span one month: ages are counted in days
HALF_LIFE = 10.0
AS_OF = "2024-02-15 12:00:00"   # day on which staleness is read


def _type(user) -> object:
    return F.when(user % 5 == 0, "firm").otherwise("advisor")


def text_reviews(spark: SparkSession, d: str, pieces: bool = False) -> DataFrame:
    """One review per document; ``pieces``: for counts whose memory grows with the text of a task."""
    docs, events, labels = (table(spark, d, t) for t in ("documents", "events", "labels"))
    docs = in_pieces(docs, "doc_id", "n_chars") if pieces else spread(docs.select("doc_id", "text", "source"), "doc_id")
    user = F.col("user_id")
    joined = docs.join(events.select("event_id", "ts", "user_id"), docs.doc_id == F.col("event_id")).join(
        labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("review_id"), user.alias("entity_id"),
        F.get(F.array(*[F.lit(n) for n in NAMES]), (user % len(NAMES)).cast("int")).alias("entity_name"),
        _type(user).alias("entity_type"), F.col("ts").alias("review_date"), F.col("source").alias("reviewer_name"),
        F.col("quality").cast("double").alias("rating"), F.col("text").alias("review_text_raw"),
        F.lower("text").alias("review_text_clean"), text.word_count("text").cast("bigint").alias("token_count"))


F1 = f"""f1 AS (
  SELECT d.doc_id AS review_id, e.user_id AS entity_id,
    ([{", ".join("'" + n + "'" for n in NAMES)}])[CAST(e.user_id % {len(NAMES)} AS INT) + 1] AS entity_name,
    CASE WHEN e.user_id % 5 = 0 THEN 'firm' ELSE 'advisor' END AS entity_type,
    e.ts AS review_date, d.source AS reviewer_name, CAST(l.quality AS DOUBLE) AS rating,
    d.text AS review_text_raw, lower(d.text) AS review_text_clean,
    CAST(len(regexp_extract_all(d.text, '\\S+')) AS BIGINT) AS token_count
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def vector_reviews(spark: SparkSession, d: str) -> DataFrame:
    """One vector review per event; vectors repeat when there are fewer of them."""
    events, emb = spread(table(spark, d, "events"), "event_id"), table(spark, d, "embeddings")
    user = F.col("user_id")
    return (events.withColumn("vec_id", F.col("event_id") % emb.count()).join(emb.select("vec_id", "embedding", "label"), "vec_id")
            .select(F.col("event_id").alias("review_id"), user.alias("entity_id"),
                    F.concat(F.lit("Entity "), user.cast("string")).alias("entity_name"), _type(user).alias("entity_type"),
                    F.col("ts").alias("review_date"), F.col("event_type").alias("reviewer_name"),
                    F.col("props").alias("review_text_raw"), F.length("props").cast("bigint").alias("token_count"),
                    "value", "embedding", "label"))


F2 = """f2 AS (
  SELECT e.event_id AS review_id, e.user_id AS entity_id, 'Entity ' || e.user_id AS entity_name,
    CASE WHEN e.user_id % 5 = 0 THEN 'firm' ELSE 'advisor' END AS entity_type,
    e.ts AS review_date, e.event_type AS reviewer_name, e.props AS review_text_raw,
    CAST(length(e.props) AS BIGINT) AS token_count, e.value, CAST(v.embedding AS DOUBLE[]) AS embedding, v.label
  FROM events e JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) FROM embeddings))"""


def query_table(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in DIMS])
    return table(spark, d, "embeddings").where(F.col("vec_id") < len(DIMS)).select(
        F.get(names, F.col("vec_id").cast("int")).alias("dim"), F.col("embedding").alias("query_vec"))


Q = f"""q AS (
  SELECT ([{", ".join("'" + n + "'" for n in DIMS)}])[CAST(vec_id AS INT) + 1] AS dim,
    CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id < {len(DIMS)})"""


def queries_of(spark: SparkSession, d: str) -> scoring.QueryVectors:
    return scoring.QueryVectors.from_table(query_table(spark, d), order=DIMS)


def scored_reviews(spark: SparkSession, d: str) -> DataFrame:
    return scoring.review_scores(vector_reviews(spark, d), queries_of(spark, d))


RS = f"""{F2}, {Q}, rs AS (
  SELECT review_id, entity_id, entity_name, entity_type, review_date, reviewer_name, review_text_raw, dim,
    list_dot_product(embedding, qv) AS score FROM f2, q)"""


def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    return rollup.entity_vectors(vector_reviews(spark, d), as_of=AS_OF, days_per_year=DAYS_PER_YEAR)


def weighted_reviews(spark: SparkSession, d: str) -> DataFrame:
    return rollup.with_half_life_weight(vector_reviews(spark, d), HALF_LIFE, DAYS_PER_YEAR)


def weighted_vectors(spark: SparkSession, d: str, median_age: bool = False) -> DataFrame:
    return rollup.entity_weighted_vectors(weighted_reviews(spark, d), median_age=median_age)


def build_entity_scores(spark: SparkSession, d: str) -> DataFrame:
    reviews = vector_reviews(spark, d)
    means = rollup.entity_vectors(reviews, as_of=AS_OF, days_per_year=DAYS_PER_YEAR)
    weighted = rollup.entity_weighted_vectors(rollup.with_half_life_weight(reviews, HALF_LIFE, DAYS_PER_YEAR),
                                              median_age=False)
    both = scoring.merge_methods(means, weighted).withColumn("entity_type", _type(F.col("entity_id")))
    scored = scoring.with_dots(both, queries_of(spark, d), {f"vector_{m}": f"sim_{m}" for m in fv.METHODS})
    sims = [f"sim_{m}_{n}" for m in fv.METHODS for n in DIMS]
    return scored.select("entity_id", "entity_name", "entity_type", F.col("n_reviews").alias("review_count"), *sims)


_stored: dict[tuple[str, str], DataFrame] = {}


def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    """The entity score table, computed once per application and stored, as the stages do."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        _stored[key] = via_table(build_entity_scores(spark, d), "entity-scores")
    return _stored[key]


# roll-ups in SQL: component rows, then one vector per entity and method, then scores
VEC = f"""{F2}, x AS (
  SELECT entity_id, review_date, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM f2),
ref AS (SELECT max(review_date) AS d FROM f2),
mean0 AS (SELECT entity_id, pos, avg(x) AS m FROM x GROUP BY ALL),
norm AS (SELECT entity_id, sqrt(sum(m * m)) AS nrm FROM mean0 GROUP BY ALL),
mean_vec AS (SELECT entity_id, pos, m / nrm AS v FROM mean0 JOIN norm USING (entity_id)),
rec AS (SELECT entity_id, max(review_date) AS last_date, count(*) AS n_reviews FROM f2 GROUP BY ALL),
stale AS (SELECT entity_id, last_date, n_reviews,
  floor(date_diff('microsecond', last_date, TIMESTAMP '{AS_OF}') / 1e6 / 86400) / {DAYS_PER_YEAR}::DOUBLE AS staleness
  FROM rec),
pen AS (SELECT *, exp(ln(0.7::DOUBLE) / (SELECT quantile_cont(staleness, 0.75) FROM stale) * staleness) AS factor
  FROM stale),
pen_vec AS (SELECT entity_id, pos, v * factor AS v FROM mean_vec JOIN pen USING (entity_id)),
w AS (SELECT review_id, entity_id, review_date, date_diff('microsecond', review_date, (SELECT d FROM ref)) / 1e6
    / (86400 * {DAYS_PER_YEAR}::DOUBLE) AS age,
  pow(0.5::DOUBLE, greatest(0, date_diff('microsecond', review_date, (SELECT d FROM ref)) / 1e6
    / (86400 * {DAYS_PER_YEAR}::DOUBLE)) / {HALF_LIFE}::DOUBLE) AS w FROM f2),
xw AS (SELECT f2.entity_id, w.w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
  FROM f2 JOIN w USING (review_id)),
w_vec AS (SELECT entity_id, pos, sum(w * x) / sum(w) AS v FROM xw GROUP BY ALL)"""

QX = f"""{Q}, qx AS (
  SELECT dim, unnest(qv) AS qv, generate_subscripts(qv, 1) AS pos FROM q)"""

# es: (entity_id, entity_name, entity_type, review_count, method, dim, score)
ES = f"""{VEC}, {QX}, allv AS (
  SELECT 'mean' AS method, * FROM mean_vec UNION ALL SELECT 'penalized', * FROM pen_vec
  UNION ALL SELECT 'weighted', * FROM w_vec),
es AS (SELECT a.entity_id, 'Entity ' || a.entity_id AS entity_name,
    CASE WHEN a.entity_id % 5 = 0 THEN 'firm' ELSE 'advisor' END AS entity_type, any_value(r.n_reviews) AS review_count,
    method, dim, sum(v * qv) AS score
  FROM allv a JOIN qx USING (pos) JOIN rec r ON r.entity_id = a.entity_id GROUP BY a.entity_id, method, dim),
es7 AS (SELECT * FROM es UNION ALL
  SELECT entity_id, any_value(entity_name), any_value(entity_type), any_value(review_count), method, 'composite',
    avg(score) FROM es GROUP BY entity_id, method)"""


def tier_sql(p: str) -> str:
    return (f"CASE WHEN {p} >= 75 THEN 'Very Strong' WHEN {p} >= 50 THEN 'Strong' WHEN {p} >= 25 THEN 'Moderate' "
            f"ELSE 'Foundational' END")


def rank_sql(part: str) -> str:
    """Average tie rank in percent and min-max in percent over ``part``."""
    return (f"round_even((rank() OVER (PARTITION BY {part} ORDER BY score) + (count(*) OVER (PARTITION BY {part}, score)"
            f" - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {part}) * 100, 1) AS percentile, "
            f"CASE WHEN max(score) OVER (PARTITION BY {part}) > min(score) OVER (PARTITION BY {part}) THEN "
            f"round_even((score - min(score) OVER (PARTITION BY {part})) / (max(score) OVER (PARTITION BY {part}) - "
            f"min(score) OVER (PARTITION BY {part})) * 100, 1) ELSE 50.0::DOUBLE END AS normalized")


def enriched_sql(source: str, part: str, columns: str) -> str:
    """Enriched rows of a (.., score) relation, ranked within ``part``."""
    return (f"SELECT {columns}, round_even(score, 6) AS raw, percentile, normalized, {tier_sql('percentile')} AS tier "
            f"FROM (SELECT *, {rank_sql(part)} FROM {source})")


ENRICHED = f"""{ES}, en AS ({enriched_sql("es7", "entity_type, method, dim",
                                          "entity_id, entity_name, entity_type, review_count, method, dim")})"""


def partner_groups(spark: SparkSession, d: str) -> DataFrame:
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("entity_id"), F.col("n_nationkey").cast("bigint").alias("partner_group_code"),
        F.col("n_name").alias("partner_group_name"))


GROUPS = """pg AS (SELECT c_custkey AS entity_id, CAST(n_nationkey AS BIGINT) AS partner_group_code,
  n_name AS partner_group_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def firm_scores(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    ends = orders.agg(F.struct(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).alias("e")).scalar()
    scaled = orders.withColumn("_e", ends).withColumn(
        "score", (F.col("o_totalprice") - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo")) * 100)
    return scaled.select(F.col("o_orderpriority").alias("firm_id"), F.col("o_custkey").alias("entity_id"),
                         F.col("o_orderstatus").alias("dimension"), "score", (F.col("score") / 100).alias("confidence"),
                         F.lit(1).cast("bigint").alias("review_count"))


FIRMS = """fs AS (SELECT o_orderpriority AS firm_id, o_custkey AS entity_id, o_orderstatus AS dimension,
  (o_totalprice - lo) / (hi - lo) * 100 AS score, (o_totalprice - lo) / (hi - lo) * 100 / 100 AS confidence,
  1 AS review_count
  FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders))"""

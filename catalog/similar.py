"""Similarity and topics."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import query, shaped
from revgauge.operators import similarity, topics


def _near_sql(extra=""):
    return f"""WITH {v.F2}, p AS (SELECT a.review_id AS query_id, b.review_id AS item_id,
  list_cosine_similarity(a.embedding, b.embedding) AS similarity FROM f2 a JOIN f2 b ON a.review_id <> b.review_id {extra}
  WHERE a.review_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, item_id) AS rank FROM p)
SELECT query_id, item_id, round(similarity, 6) + 0.0 AS similarity, rank FROM r WHERE rank <= 5"""


def _near(search, rows, id_column):
    """Every id divisible by 20 against all rows."""
    return search(rows, rows.where(F.col(id_column) % 20 == 0).select(id_column))


@query("similar_reviews", _near_sql())
def similar_reviews(spark, d):
    return shaped(_near(similarity.similar_reviews, v.vector_reviews(spark, d), "review_id"))


@query("similar_reviews_other_entity", _near_sql("AND a.entity_id <> b.entity_id"))
def similar_reviews_other_entity(spark, d):
    return shaped(_near(similarity.similar_reviews_other_entity, v.vector_reviews(spark, d), "review_id"))


@query("similar_entities", f"""WITH {v.VEC}, p AS (SELECT a.entity_id AS query_id, b.entity_id AS item_id,
  sum(a.v * b.v) AS similarity FROM mean_vec a JOIN mean_vec b ON a.pos = b.pos AND a.entity_id <> b.entity_id
  WHERE a.entity_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM p)
SELECT query_id, item_id, round(similarity, 6) + 0.0 AS similarity, rank FROM r WHERE rank <= 5""")
def similar_entities(spark, d):
    return shaped(_near(similarity.similar_entities, v.mean_vectors(spark, d), "entity_id"))


K, SEED, ROUNDS, STEPS = 20, 42, 5, 20


def _kmeans_sql():
    """The same seeds and steps, one CTE each; sums are of doubles here."""
    u = "(('0x' || substr(md5('{seed}:{r}:' || id), 1, 8))::BIGINT + 0.5) / 4294967296.0"
    draw = lambda r: u.format(seed=SEED, r=r)
    d2 = "list_distance(p.v, c.v) * list_distance(p.v, c.v)"
    ctes = ["p AS MATERIALIZED (SELECT review_id AS id, embedding AS v, list_dot_product(embedding, embedding) AS len2 FROM f2)",
            f"s0 AS MATERIALIZED (SELECT 0 AS r, 0.0::DOUBLE AS key, id, v FROM p ORDER BY {draw(0)}, id LIMIT 1)"]
    for r in range(1, ROUNDS + 1):
        ctes.append(f"s{r} AS MATERIALIZED (SELECT * FROM s{r - 1} UNION ALL SELECT * FROM (SELECT {r}, -ln({draw(r)}) / far, id, v "
                    f"FROM (SELECT p.id, p.v, p.len2, min({d2}) AS far FROM p, s{r - 1} c GROUP BY ALL) "
                    f"WHERE far > 1e-9 * len2 ORDER BY 2, id LIMIT {2 * K}))")
    ctes.append(f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r, key, id) AS c, v FROM s{ROUNDS} "
                "QUALIFY row_number() OVER (PARTITION BY v ORDER BY r, key, id) = 1)")
    ctes.append(f"w AS MATERIALIZED (SELECT c, count(*) AS n FROM (SELECT p.id, arg_min(c.c, ({d2}, c.c)) AS c FROM p, s c "
                "GROUP BY p.id) GROUP BY c)")
    ctes.append("g1 AS MATERIALIZED (SELECT 1 AS turn, c, v FROM s JOIN w USING (c) ORDER BY n DESC, c LIMIT 1)")
    for t in range(2, K + 1):
        ctes.append(f"g{t} AS MATERIALIZED (SELECT * FROM g{t - 1} UNION ALL SELECT * FROM (SELECT {t}, p.c, p.v FROM s p "
                    f"JOIN w ON w.c = p.c, g{t - 1} c GROUP BY p.c, p.v, n HAVING n * min({d2}) > 0 "
                    f"ORDER BY n * min({d2}) DESC, p.c LIMIT 1))")
    ctes.append(f"c0 AS MATERIALIZED (SELECT turn AS c, v FROM g{K})")
    for t in range(1, STEPS + 1):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT p.id, p.v, arg_min(c.c, ({d2}, c.c)) AS c FROM p, c{t - 1} c GROUP BY p.id, p.v)")
        ctes.append(f"c{t} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v, n FROM (SELECT c, list(x ORDER BY pos) AS v, max(n) AS n "
                    f"FROM (SELECT c, pos, avg(x) AS x, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos "
                    f"FROM a{t}) GROUP BY ALL) GROUP BY c) m RIGHT JOIN (SELECT c, v FROM c{t - 1}) o USING (c))")
    ctes.append(f"o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY coalesce(n, 0) DESC, v) - 1 AS cluster, v FROM c{STEPS})")
    ctes.append(f"z AS MATERIALIZED (SELECT p.id, arg_min(c.cluster, ({d2}, c.cluster)) AS cluster FROM p, o c GROUP BY p.id)")
    return f"WITH {v.F2}, " + ", ".join(ctes) + (
        " SELECT id AS review_id, cluster, count(*) OVER (PARTITION BY cluster) AS n FROM z")


@query("kmeans_topics", _kmeans_sql())
def kmeans_topics(spark, d):
    """Every review with its cluster and the cluster's size."""
    placed = topics.kmeans_topics(v.vector_reviews(spark, d), K, seed=SEED, max_iter=STEPS).select("review_id", "cluster")
    return shaped(placed.join(topics.cluster_sizes(placed), "cluster"))


@query("cluster_sizes", f"WITH {v.F2} SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM f2 GROUP BY label")
def cluster_sizes(spark, d):
    return shaped(topics.cluster_sizes(v.vector_reviews(spark, d), "label"))


@query("cluster_representatives", f"""WITH {v.F2}, x AS (SELECT label, unnest(embedding) AS x,
  generate_subscripts(embedding, 1) AS pos FROM f2), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY pos) AS cv FROM m GROUP BY label),
s AS (SELECT label, review_id, list_cosine_similarity(embedding, cv) AS similarity FROM f2 JOIN c USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 9) DESC, review_id) AS rank FROM s)
SELECT CAST(label AS BIGINT) AS label, review_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def cluster_representatives(spark, d):
    return shaped(topics.cluster_representatives(v.vector_reviews(spark, d), "label"))

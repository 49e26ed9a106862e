"""Text scalars and lexical reports."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.base import ORACLE, query, shaped, table
from revgauge import fixed_values as fv
from revgauge.functions import text
from revgauge.plans import stages
from revgauge.session import spread
from revgauge.operators import dedup, encode, filters, lexical, topics

_LEX_ANY = r"regexp_extract_all(lower({c}), '[a-z0-9'']{{2,}}')"
TOK = _LEX_ANY.format(c="review_text_clean")
SQL_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(fv.ENGLISH_STOPWORDS + fv.DOMAIN_STOPWORDS)))
SQL_REPORT_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(fv.REPORT_STOPWORDS)))
SQL_ENGLISH = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(fv.ENGLISH_STOPWORDS)))


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _scalar(name, function, sql, source="documents", key="doc_id", column="text"):
    @query(name, sql and f"SELECT {key}, {sql} AS out FROM {source}")
    def run(spark, d):
        return shaped(spread(table(spark, d, source).select(key, column), key).select(key, function(column).alias("out")))


_scalar("flatten_breaks", text.flatten_breaks, r"regexp_replace(text, '[\r\n\t]+', ' ', 'g')")
_scalar("strip_urls", text.strip_urls, r"regexp_replace(html, 'http\S+|www\.\S+|www\S+', ' ', 'g')", "pages", "page_id",
        "html")
_scalar("strip_emails", text.strip_emails, r"regexp_replace(text, '\S+@\S+', ' ', 'g')")
_scalar("strip_bullets", text.strip_bullets, "regexp_replace(text, '[•▪►◆■│]+', ' ', 'g')")
_scalar("strip_boilerplate", text.strip_boilerplate,
        "regexp_replace(regexp_replace(text, '(?i)this reviewer received no compensation.*', ' ', 'g'), "
        "'(?i)there are no material conflicts of interest.*', ' ', 'g')")
_scalar("collapse_whitespace", text.collapse_whitespace, r"trim(regexp_replace(text, '\s+', ' ', 'g'))")
_scalar("collapse_punct", text.collapse_punct,
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!{3,}', '!', 'g'), '\?{3,}', '?', 'g'), "
        r"'\.{3,}', '.', 'g'), ',{3,}', ',', 'g')")
_scalar("lowercase", F.lower, "lower(text)")
# the references that the pages hold; a page may be cut off inside one
_scalar("html_unescape", text.html_unescape,
        "regexp_replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), "
        "'&amp$', '&')", "pages", "page_id", "html")
# ligatures put into the texts must come out as the letters that they stand for
_scalar("unicode_nfkc", lambda c: text.unicode_nfkc(F.replace(F.col(c), F.lit("st"), F.lit("ﬆ"))), "nfc_normalize(text)")
_scalar("strip_prompts", text.strip_prompts,
        "trim(regexp_replace(regexp_replace(text, '(?i)" + "|".join(fv.PROMPT_PATTERNS).replace("'", "''")
        + r"', ' ', 'g'), '\s+', ' ', 'g'))")
_scalar("tokenize_simple", lambda c: F.array_join(text.tokenize_simple(c), " "),
        f"array_to_string({_LEX_ANY.format(c='text')}, ' ')")
_scalar("tokenize_ws", lambda c: F.array_join(text.tokenize_ws(c), "|"),
        r"array_to_string(regexp_extract_all(text, '\S+'), '|')")
_scalar("remove_stopwords", lambda c: F.array_join(text.remove_stopwords(text.tokenize_ws(F.lower(c))), "|"),
        r"array_to_string(list_filter(regexp_extract_all(lower(text), '\S+'), lambda t: t NOT IN ("
        + SQL_STOP + ") AND length(t) > 2), '|')")


# runs of the same character, by gaps and islands over single characters
_STRETCH = r"""
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i
  FROM src),
r AS (SELECT doc_id, i, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c),
g AS (SELECT doc_id, ch, min(i) AS i, count(*) AS n FROM r GROUP BY doc_id, ch, run),
st AS (SELECT doc_id, string_agg(CASE WHEN n >= 4 AND ch <> chr(10) THEN ch || ch ELSE repeat(ch, CAST(n AS INT)) END, ''
  ORDER BY i) AS out FROM g GROUP BY doc_id)"""


def _chain(column, *steps):
    for pattern, by in steps:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return column


CLEAN = f"""src AS (SELECT doc_id, {_chain("trim(" + _chain(
    "nfc_normalize(coalesce(text, ''))", (r"[\r\n\t]+", " "), (r"http\S+|www\.\S+|www\S+", " "), (r"\S+@\S+", " "), ("[•▪►◆■│]+", " "),
    ("(?i)this reviewer received no compensation.*", " "), ("(?i)there are no material conflicts of interest.*", " "),
    (r"\s+", " ")) + ")", ("!{3,}", "!"), (r"\?{3,}", "?"), (r"\.{3,}", "."), (",{3,}", ","))} AS text FROM documents),
{_STRETCH}, cleaned AS (SELECT doc_id, lower(coalesce(out, '')) AS out FROM src LEFT JOIN st USING (doc_id))"""
_scalar("clean_text", text.clean_text, None)
ORACLE["clean_text"] = f"WITH {CLEAN} SELECT * FROM cleaned"


@query("collapse_stretch", f"WITH src AS (SELECT doc_id, text FROM documents), {_STRETCH} SELECT * FROM st")
def collapse_stretch(spark, d):
    return shaped(_docs(spark, d).select("doc_id", text.collapse_stretch("text").alias("out")))


@query("normalize_name", f"""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(
  lower(c_name || ' Adams, {{}} CFP ' || c_mktsegment), '{"|".join(fv.CREDENTIALS)}', ' ', 'g'), '[^a-z\\s]', ' ', 'g'),
  '\\s+', ' ', 'g')) AS out FROM customer""".replace("{}", "MBA"))
def normalize_name(spark, d):
    name = F.concat("c_name", F.lit(" Adams, MBA CFP "), "c_mktsegment")
    return shaped(table(spark, d, "customer").select("c_custkey", text.normalize_name(name).alias("out")))


# word edges are marked, so that whole words are plain substrings
@query("remove_entity_name", f"""WITH {v.F1}, n AS MATERIALIZED (SELECT review_id, string_split(trim(regexp_replace(
    regexp_replace(regexp_replace(lower(entity_name), '{"|".join(fv.CREDENTIALS)}', ' ', 'g'), '[^a-z\\s]', ' ', 'g'),
    '\\s+', ' ', 'g')), ' ') AS w,
  regexp_replace(review_text_clean, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(1), 'g') AS t FROM f1),
a AS (SELECT review_id, w[1] AS first, w[-1] AS last, replace(t, chr(1) || array_to_string(w, chr(1) || ' ' || chr(1))
  || chr(1), ' ') AS t FROM n),
b AS (SELECT review_id, last, CASE WHEN length(first) >= 3 THEN replace(t, chr(1) || first || chr(1), ' ') ELSE t END AS t
  FROM a),
c AS (SELECT review_id, CASE WHEN length(last) >= 3 THEN replace(t, chr(1) || last || chr(1), ' ') ELSE t END AS t FROM b)
SELECT review_id, trim(regexp_replace(replace(t, chr(1), ''), '\\s+', ' ', 'g')) AS out FROM c""")
def remove_entity_name(spark, d):
    return shaped(v.text_reviews(spark, d).select(
        "review_id", text.remove_entity_name("review_text_clean", "entity_name").alias("out")))


@query("strip_name_literal", f"""WITH {v.F1} SELECT review_id, trim(regexp_replace(regexp_replace(review_text_clean,
  '(?i)' || regexp_escape(string_split(entity_name, ',')[1]), ' ', 'g'), '\\s+', ' ', 'g')) AS out FROM f1""")
def strip_name_literal(spark, d):
    return shaped(v.text_reviews(spark, d).select(
        "review_id", text.strip_name_literal("review_text_clean", F.substring_index("entity_name", ",", 1)).alias("out")))


@query("name_mention_flag", f"""WITH {v.F1}, n AS (SELECT *, lower(entity_name) AS nm,
  string_split(lower(entity_name), ' ')[1] AS first, '(^|[^\\p{{L}}\\p{{N}}_])' AS lft, '($|[^\\p{{L}}\\p{{N}}_])' AS rgt
  FROM f1)
SELECT review_id, CASE WHEN regexp_matches(review_text_clean, lft || first || rgt) THEN 1 ELSE 0 END AS flag FROM n""")
def name_mention_flag(spark, d):
    return shaped(v.text_reviews(spark, d).select(
        "review_id", text.name_mention_flag("review_text_clean", "entity_name").alias("flag")))


@query("name_mention_rate", f"""WITH {v.F1} SELECT count(*) AS n_total, count(*) FILTER (hit) AS n_mentions,
  round(avg(CAST(hit AS INT)), 6) AS share
FROM (SELECT contains(review_text_clean, lower(string_split(entity_name, ',')[1])) AS hit FROM f1)""")
def name_mention_rate(spark, d):
    return shaped(filters.name_mention_rate(v.text_reviews(spark, d)))


_HASH = """substr(sha256(CAST(entity_id AS VARCHAR) || '||' || review_text_raw || '||' ||
  coalesce(strftime(review_date, '%Y-%m-%d'), 'no_date') || '||' || coalesce(trim(reviewer_name), 'anonymous')), 1, 16)"""


@query("review_hash", f"WITH {v.F1} SELECT review_id, {_HASH} AS review_hash FROM f1")
def review_hash(spark, d):
    return shaped(dedup.with_review_hash(v.text_reviews(spark, d)).select("review_id", "review_hash"))


@query("suspect_phrase_rate", f"""WITH {v.F1} SELECT count(*) AS n_total, count(*) FILTER (hit) AS n_suspect,
  round(avg(CAST(hit AS INT)), 6) AS share
FROM (SELECT regexp_matches(review_text_clean, '(?i)of the|re on|here') AS hit FROM f1)""")
def suspect_phrase_rate(spark, d):
    return shaped(filters.suspect_phrase_rate(v.text_reviews(spark, d), phrases=["of the", "re on", "here"]))


@query("length_features", f"""WITH {v.F1} SELECT review_id, length(review_text_raw) AS raw_len,
  length(review_text_clean) AS clean_len, len(regexp_extract_all(review_text_clean, '\\S+')) AS word_len,
  token_count, len(regexp_extract_all(review_text_clean, '\\S+')) AS clean_token_count FROM f1""")
def length_features(spark, d):
    from revgauge.operators import intake

    rows = intake.length_features(v.text_reviews(spark, d).drop("token_count"))
    return shaped(rows.select("review_id", "raw_len", "clean_len", "word_len", "token_count", "clean_token_count"))


def _ngram_sql(n):
    return (f"SELECT unnest(list_transform(range(1, greatest(len(t) - {n - 2}, 1)), "
            f"lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS ngram FROM toks")


@query("top_tokens", f"""WITH {v.F1}, w AS (SELECT unnest({TOK}) AS token FROM f1)
SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 40""")
def top_tokens(spark, d):
    return shaped(lexical.top_tokens(v.text_reviews(spark, d)))


@query("top_bigrams", f"""WITH {v.F1}, toks AS MATERIALIZED (SELECT {TOK} AS t FROM f1), g AS ({_ngram_sql(2)})
SELECT ngram AS bigram, count(*) AS n FROM g GROUP BY ngram ORDER BY n DESC, ngram LIMIT 40""")
def top_bigrams(spark, d):
    return shaped(lexical.top_bigrams(v.text_reviews(spark, d)))


@query("ngrams", f"""WITH {v.F1}, toks AS MATERIALIZED (SELECT list_filter(regexp_extract_all(review_text_clean, '\\S+'),
  lambda x: x NOT IN ({SQL_STOP}) AND length(x) > 2) AS t FROM f1), g AS ({_ngram_sql(3)})
SELECT ngram, count(*) AS n FROM g GROUP BY ngram""")
def ngrams(spark, d):
    tokens = text.remove_stopwords(text.tokenize_ws("review_text_clean"))
    return shaped(lexical.ngram_counts(v.text_reviews(spark, d, pieces=True), tokens, 3))


def _joined_ngrams(n):
    parts = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"array_to_string(list_transform(range(1, len(t) - {n} + 2), lambda i: {parts}), '|')"


@query("prepared_ngrams", f"""WITH {CLEAN}, kept AS (SELECT doc_id, source, text AS raw, trim(regexp_replace(regexp_replace(out,
    '(?i){"|".join(fv.PROMPT_PATTERNS).replace("'", "''")}', ' ', 'g'), '\\s+', ' ', 'g')) AS body
  FROM cleaned JOIN documents USING (doc_id) WHERE length(out) > {fv.MIN_TEXT_LENGTH}),
long AS (SELECT *, regexp_extract_all(body, '\\S+') AS w, substr(sha256(source || '||' || raw || '||2024-01-05||anonymous'), 1, 16)
  AS review_hash FROM kept WHERE len(regexp_extract_all(body, '\\S+')) >= {fv.MIN_TOKENS_TO_ENCODE}),
firsts AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY review_hash ORDER BY doc_id) = 1),
toks AS (SELECT *, list_filter(w, lambda x: x NOT IN ({SQL_STOP}) AND length(x) > 2) AS t FROM firsts)
SELECT doc_id AS review_id, review_hash, len(w) AS total_tokens_raw, len(t) AS n_tokens_processed,
  {_joined_ngrams(2)} AS bigrams, {_joined_ngrams(3)} AS trigrams FROM toks""")
def prepared_ngrams(spark, d):
    """Clean, prepare, hash, deduplicate, then n-grams: documents as reviews of their source on one day."""
    rows = _docs(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("entity_id"), F.col("source").alias("entity_name"),
        F.col("text").alias("review_text_raw"), F.lit("2024-01-05").cast("timestamp_ntz").alias("review_date"),
        F.lit(None).cast("string").alias("reviewer_name"))
    fresh = dedup.incremental_delta(stages.prepared_stage(stages.clean_stage(rows)), None)
    out = stages.with_ngrams(fresh)
    return shaped(out.select("review_id", "review_hash", "total_tokens_raw", "n_tokens_processed",
                             F.array_join("bigrams", "|").alias("bigrams"), F.array_join("trigrams", "|").alias("trigrams")))


@query("lexical_top_ngrams", f"""WITH {v.F1}, toks AS MATERIALIZED (SELECT list_filter({TOK},
  lambda x: x NOT IN ({SQL_REPORT_STOP})) AS t FROM f1), g AS ({_ngram_sql(2)})
SELECT ngram, count(*) AS n FROM g GROUP BY ngram ORDER BY n DESC, ngram LIMIT 100""")
def lexical_top_ngrams(spark, d):
    return shaped(lexical.lexical_top_ngrams(v.text_reviews(spark, d), n=2, top_n=100, exclude_stopwords=True))


@query("lexical_custom_stopwords", f"""WITH {v.F1}, w AS (SELECT unnest({TOK}) AS ngram FROM f1)
SELECT ngram, count(*) AS n FROM w WHERE ngram NOT IN ('the', 'and', 'de') GROUP BY ngram ORDER BY n DESC, ngram LIMIT 20
""")
def lexical_custom_stopwords(spark, d):
    return shaped(lexical.lexical_top_ngrams(v.text_reviews(spark, d), exclude_stopwords=True,
                                             custom_stopwords=["The ", "and", "DE"]))


@query("stopword_union", f"""WITH w AS (SELECT unnest([{SQL_ENGLISH}]) AS word, 'english' AS origin
  UNION SELECT unnest([{", ".join("'" + w + "'" for w in fv.DOMAIN_STOPWORDS)}]), 'domain'),
s AS (SELECT word, string_agg(origin, '+' ORDER BY origin) AS origin FROM w GROUP BY word)
SELECT s.word, s.origin, count(d.token) AS n FROM s LEFT JOIN (
  SELECT unnest({_LEX_ANY.format(c="text")}) AS token FROM documents) d ON d.token = s.word GROUP BY ALL""")
def stopword_union(spark, d):
    """The stopword table with how often each word occurs in the corpus."""
    used = lexical.ngram_counts(_docs(spark, d), text.tokenize_simple("text"))
    return shaped(lexical.stopword_union(spark).join(used.withColumnRenamed("ngram", "word"), "word", "left")
                  .withColumn("n", F.coalesce("n", F.lit(0))))


@query("cluster_keywords", f"""WITH {v.F1}, w AS (SELECT entity_type AS cluster, unnest({TOK}) AS term FROM f1),
c AS (SELECT cluster, term, count(*) AS n FROM w WHERE term NOT IN ({SQL_ENGLISH}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS rank FROM c)
SELECT cluster, term, n, rank FROM r WHERE rank <= 15""")
def cluster_keywords(spark, d):
    rows = v.text_reviews(spark, d).withColumnRenamed("entity_type", "cluster")
    return shaped(lexical.cluster_keywords(rows))


_SENT = f"""WITH {v.F1}, s AS (SELECT review_id, string_split(regexp_replace(review_text_clean, '([.!?])\\s+',
  '\\1' || chr(1), 'g'), chr(1)) AS s FROM f1),
e AS (SELECT review_id, generate_subscripts(s, 1) - 1 AS sentence_no, unnest(s) AS sentence FROM s),
t AS (SELECT review_id, sentence_no, regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') AS sentence FROM e)
SELECT * FROM t WHERE length(sentence) >= 40"""


@query("explode_sentences", _SENT)
def explode_sentences(spark, d):
    return shaped(topics.explode_sentences(v.text_reviews(spark, d)))


@query("keyword_sentence_filter", f"""SELECT * FROM ({_SENT})
WHERE regexp_matches(sentence, '{"|".join(fv.RELATIONSHIP_KEYWORDS)}') AND len(regexp_extract_all(sentence, '\\S+')) >= 8""")
def keyword_sentence_filter(spark, d):
    return shaped(topics.relationship_sentences(topics.explode_sentences(v.text_reviews(spark, d))))


@query("encode_text", f"""WITH {v.F1} SELECT review_id, CAST({fv.VECTOR_SIZE} AS BIGINT) AS dim,
  CASE WHEN len({TOK}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm2, len({TOK})::DOUBLE AS n_tokens FROM f1""")
def encode_text(spark, d):
    """Vectors of length 1 whose entries, before scaling, count every token of the text once."""
    rows = encode.encode_text(v.text_reviews(spark, d), "review_text_clean")
    rows = encode.encode_text(rows, "review_text_clean", out="plain", normalize=False)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x))
    return shaped(rows.select("review_id", F.size("embedding").alias("dim"),
                              F.round(total("embedding", lambda x: x.cast("double") * x), 5).alias("norm2"),
                              total("plain", lambda x: x).alias("n_tokens")))

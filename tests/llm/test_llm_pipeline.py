"""The corpus pipeline, stage by stage, against plain versions of its stages."""

import re
import zlib

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from revgauge.llm import base, simhash
from revgauge.llm.queries import tokenizer_path
from test_llm_dedup import plain_classes, plain_repeats
from test_llm_text import plain_passages


def plain_run(docs, items):
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    keep = {d for d, _, c in plain_classes(docs) if d == c}
    docs = sorted((d, t) for d, t in docs if d in keep)
    docs = [(d, kept.decode(errors="ignore")) for d, _, _, kept in plain_repeats(docs, 100)]
    docs = [(d, t) for d, t in docs if t.strip(" ") or t == ""]
    return [(d, t) for d, t in docs if plain_passages(t, items)[1] == 0]


def test_pipeline(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain_run(docs, items)
    rows = corpus_pipeline.run(spark, sf).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in want}
    assert {r.doc_id for r in rows} == set(ids)
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123", "en", "s", 3),
                                 (None, "words without an id " * 9, "en", "s", 1)], docs.schema)
    for docs in (docs.limit(40).unionByName(odd), docs.limit(0)):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns, name
        left = {r.doc_id for r in now.collect()}
        assert not left & {10**6, 10**6 + 1, 10**6 + 2}
        assert (None in left) == bool(docs.count())
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0]) and len(corpus_pipeline.STAGES) == 5


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


WORDS = [f"w{i}q" for i in range(400)]


def odd(spark, rows):
    """Documents with columns named like those of the operators."""
    names = "kept string, spans long, id long, row long, first string, fp long, n long, lang_pred string, items string"
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", 1, 2, 3, "f", 4, 5, "l", "i") for d, t in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def left(name, docs, sf):
    now = stage(name)(docs.sparkSession, docs, sf)
    assert now.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in now.collect()), key=lambda r: (r[0] is None, r))


def test_rows_are_judged_by_their_own_text(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    a, b = " ".join(WORDS[:100]), " ".join(WORDS[100:200])
    docs = odd(spark, [(1, a), (1, "999"), (None, "123"), (None, b), (2, None), (3, a), (3, a)])
    assert left("language_id", docs, sf) == [(1, a), (3, a), (3, a), (None, b)]
    docs = odd(spark, [(1, a), (1, item), (None, item), (None, b), (2, None), (3, "")])
    assert left("decontamination", docs, sf) == [(1, a), (2, None), (3, ""), (None, b)]


def test_one_row_of_each_class_stays(spark, sf):
    a, b, c = (" ".join(WORDS[k:k + 100]) for k in (0, 100, 200))
    docs = odd(spark, [(7, a), (7, a), (None, a), (5, b), (5, c), (None, c), (None, c + " end"), (9, ""), (8, None)])
    assert left("near_dedup", docs, sf) == [(5, b), (5, c), (7, a), (8, None)]
    docs = odd(spark, [(None, a), (None, a), (None, b)])
    assert left("near_dedup", docs, sf) == [(None, a), (None, b)]


def test_passages_of_rows_that_share_an_id(spark, sf):
    a, b, c, shared = (" ".join(WORDS[k:k + 100]) for k in (0, 100, 200, 300))
    docs = odd(spark, [(1, a + shared), (1, b), (2, shared + c), (3, "ok"), (None, shared)])
    assert left("suffix_array_dedup", docs, sf) == [(1, a), (1, b), (2, shared + c), (3, "ok"), (None, shared)]
    docs = odd(spark, [(1, a + shared), (2, shared + c), (3, shared)])
    assert left("suffix_array_dedup", docs, sf) == [(1, a + shared), (2, c)]
    assert left("suffix_array_dedup", docs.limit(0), sf) == []


def test_near_dedup_stores_no_texts(spark, monkeypatch):
    a, b, c = (" ".join(WORDS[k:k + 100]) for k in (0, 100, 200))
    docs = odd(spark, [(7, a), (7, a), (None, a), (5, b), (None, c), (None, c), (9, None)])
    docs = docs.withColumn("source", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string"))).cache()
    kinds = []

    def stored(df, label):
        kinds.append(df.schema.simpleString())
        return keep(df, label)

    keep = simhash.stored
    monkeypatch.setattr(simhash, "stored", stored)
    got = sorted(((r.doc_id, r.text, r.source) for r in simhash.first_of_each(docs).collect()), key=str)
    first = {(r.doc_id, r.text): r.source for r in reversed(docs.collect())}
    assert got == sorted(((d, t, first[d, t]) for d, t in [(7, a), (5, b), (None, c), (9, None)]), key=str)
    assert kinds and not any("string" in k for k in kinds)


def test_shuffle_files_go_with_the_write(spark):
    spark.conf.set(base.CLEAN_UP, "false")
    seen = []

    class Watched:
        def __init__(self, df):
            self.sparkSession, self.schema, self.write = df.sparkSession, df.schema, self
            self.df = df

        def parquet(self, path):
            seen.append(spark.conf.get(base.CLEAN_UP))
            self.df.write.parquet(path)

    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert base.stored(Watched(rows), "rows").count() == rows.count() == 7
    assert seen == ["true"] and spark.conf.get(base.CLEAN_UP) == "false"

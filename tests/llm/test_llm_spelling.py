"""Spelling variants against a plain comparison of all pairs, and on odd tables."""

import random
import re
import zlib
from collections import Counter

import pytest

from revgauge.llm import spelling
from revgauge.llm.queries import QUERIES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, plant):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if plant and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    near = {w: [] for w in words}
    # candidates share a string with one letter deleted, or are one
    holes = {}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            holes.setdefault(key, []).append(w)
    for group in holes.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    form = {}
    for w, found in near.items():
        near[w] = found = sorted(set(found), key=lambda b: (-words[b], b))
        form[w] = found[0] if found and words[found[0]] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def rows_of(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len({r[0] for r in got})
    return set(got)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query_equals_all_pairs(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_words(rows, True))
    assert rows_of(QUERIES["op12_spelling_variants"](spark, sf)) == want
    assert any(form for _, form, *_ in want)


def test_tiles_of_a_common_ending(spark):
    """Words that mostly share their last letters, in tiles of 16; chains of forms, ties and a word of 3,000 letters."""
    r = random.Random(4)
    words = {"".join(r.choice("abé") for _ in range(r.randint(3, 6))) + "ing": r.choice([5, 30, 200]) for _ in range(500)}
    words |= {"chains": 5, "chainsx": 25, "chainxsx": 125, "cyainxsx": 625, "z" * 3000: 9, "z" * 2999: 45, "z" * 3001: 45,
              "sevens": 10, "eleven": 5, "überall": 50, "uberall": 10}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_variants(words)
    for tile in (16, 2048):
        assert rows_of(spelling.variants(df, tile=tile)) == want


def test_runs_ids_and_odd_rows(spark):
    rows = [(1, "Caféteria CAFÉTERIA caféteria"), (1, "Caféteria CAFÉTERIA caféteria"), (None, "caféteria " * 3), (2, None), (3, ""),
            (4, "don't-stop stopping_stopping stopping stopping 5stopping"), (5, "x" * 100_000), (6, "aaaaaa " * 7), (7, "  \n"),
            (8, "aaaaaa×bbbbbb " * 6)]
    df = spark.createDataFrame([(d, t, "w", i, "f") for i, (d, t) in enumerate(rows)], "doc_id long, text string, word string, n int, form string")
    got = rows_of(spelling.group_variants(df))
    assert got == plain_variants(plain_words([(d, t) for d, t in rows], False))
    assert {("caféteria", 7), ("stopping", 5), ("aaaaaa", 7), ("aaaaaa×bbbbbb", 6)} <= {(w, n) for w, _, _, n, _, _ in got}
    assert spelling.group_variants(df.where("false")).collect() == []
    assert spelling.group_variants(df.where("text is null")).collect() == []


def test_index_equals_pairs():
    r = random.Random(9)
    words = list({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(300)})
    queries = words[:150] + ["abc", "c" * 12, "a"]
    q, w = spelling.PositionIndex(words).near(queries)
    assert set(zip(q.tolist(), w.tolist())) == {(i, j) for i, a in enumerate(queries) for j, b in enumerate(words) if one_edit(a, b)}
    queries = [q for q in queries if len(q) >= 3]
    q, w = spelling.PositionIndex(words).near(queries, but_first=3)
    assert set(zip(q.tolist(), w.tolist())) == {
        (i, j) for i, a in enumerate(queries) for j, b in enumerate(words) if one_edit(a, b) and a[:3] != b[:3]}

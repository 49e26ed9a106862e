"""Text functions against plain Python."""

import hashlib
import html
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revgauge import fixed_values as fv
from revgauge.functions import text

ODD = [
    "", " ", "Plain text.", "a b c d", "x\x1cy\x1fz", "see http://a.b/c?d=e and www.x.org or wwwfoo end",
    "mail me@x.org now@ @nobody a@@b", "••▪ item ◆■│ end►", "Good!!!! really??? yes... no,,,, ok!!", "soooooo goooood aaaa",
    "line\nline\r\n\ttab", "This reviewer received no COMPENSATION for it.\nKept. There are no material conflicts of interest here",
    "a There are no material conflicts of interest x this reviewer received no compensation y\nz",
    "ﬁne ① ㎏ Ｆｕｌｌ ｗｉｄｔｈ … “quotes” é é", "İstanbul ΣΟΦΟΣ straße", "Tom &amp; Jerry &lt;3 &nbsp;x &copy; &amp;amp; &notit; &#39;",
    "Things you value in your advisor: honesty. How likely are you to go? On a scale of 1 - 10: 9 &amp12 x",
    "we'd love to hear from you!! please rate: 5", "how well do you feel\nabout it? how would you describe it? fine",
    "THINGS VALUE ADVISOR client first capital", "If you have any other feedback for us: none", "scale from 1–10", "ſcale from 1-10",
    "don't stop it's a b cc d'e f1 22", "日本語 テキスト です", "😀😀😀😀 emoji 😀",
]
WS = re.compile(r"\s+")


def column(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def py_collapse(s):
    return WS.sub(" ", s).strip()


def py_boiler(s):
    for p in fv.BOILERPLATE_PATTERNS:
        s = re.sub(p, " ", s, flags=re.I)
    return s


def py_prompts(s):
    return py_collapse(re.sub("|".join(fv.PROMPT_PATTERNS), " ", s, flags=re.I))


def py_clean(s):
    s = unicodedata.normalize("NFKC", s)
    s = re.sub(r"[\r\n\t]+", " ", s)
    s = re.sub(r"http\S+|www\.\S+|www\S+", " ", s)
    s = re.sub(r"\S+@\S+", " ", s)
    s = re.sub(r"[•▪►◆■│]+", " ", s)
    s = py_collapse(py_boiler(s))
    s = re.sub(r"([!?.,])\1{2,}", r"\1", s)
    return re.sub(r"(.)\1{3,}", r"\1\1", s).lower()


def py_simple(s):
    s = re.sub(r"[^a-z0-9\s']", " ", s.lower())
    return [w for w in s.split() if len(w) > 1]


def py_ngrams(tokens, n):
    return [" ".join(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]


SCALARS = {
    "flatten_breaks": (text.flatten_breaks, lambda s: re.sub(r"[\r\n\t]+", " ", s)),
    "strip_urls": (text.strip_urls, lambda s: re.sub(r"http\S+|www\.\S+|www\S+", " ", s)),
    "strip_emails": (text.strip_emails, lambda s: re.sub(r"\S+@\S+", " ", s)),
    "strip_bullets": (text.strip_bullets, lambda s: re.sub(r"[•▪►◆■│]+", " ", s)),
    "strip_boilerplate": (lambda c: text.collapse_whitespace(text.strip_boilerplate(c)), lambda s: py_collapse(py_boiler(s))),
    "collapse_whitespace": (text.collapse_whitespace, py_collapse),
    "collapse_punct": (text.collapse_punct, lambda s: re.sub(r"([!?.,])\1{2,}", r"\1", s)),
    "collapse_stretch": (text.collapse_stretch, lambda s: re.sub(r"(.)\1{3,}", r"\1\1", s)),
    "unicode_nfkc": (text.unicode_nfkc, lambda s: unicodedata.normalize("NFKC", s)),
    "html_unescape": (text.html_unescape, html.unescape),
    "strip_prompts": (text.strip_prompts, py_prompts),
    "clean_text": (text.clean_text, py_clean),
    "tokenize_ws": (text.tokenize_ws, str.split),
    "word_count": (text.word_count, lambda s: len(s.split())),
    "tokenize_simple": (text.tokenize_simple, py_simple),
    "bigrams": (lambda c: text.ngrams(text.tokenize_simple(c), 2), lambda s: py_ngrams(py_simple(s), 2)),
    "fivegrams": (lambda c: text.ngrams(text.tokenize_ws(c), 5), lambda s: py_ngrams(s.split(), 5)),
}


@pytest.mark.parametrize("name", SCALARS)
def test_scalar(spark, name):
    fn, twin = SCALARS[name]
    assert column(spark, fn, ODD) == [twin(s) for s in ODD]


@pytest.mark.parametrize("name", ["clean_text", "unicode_nfkc", "strip_prompts", "tokenize_ws"])
def test_scalar_on_documents(spark, sf, name):
    fn, twin = SCALARS[name]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in docs.select("text", fn(F.col("text")).alias("o")).collect():
        assert r.o == twin(r.text)


def test_html_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in pages.select("html", text.html_unescape("html").alias("o")).collect():
        assert r.o == html.unescape(r.html)


def test_nfkc_every_character(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF
             and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    lines = ["|".join(chars[i:i + 500]) for i in range(0, len(chars), 500)]
    assert column(spark, text.unicode_nfkc, lines) == [unicodedata.normalize("NFKC", s) for s in lines]


def test_nulls_pass(spark):
    for name in ("flatten_breaks", "html_unescape", "unicode_nfkc", "strip_prompts", "tokenize_ws"):
        assert column(spark, SCALARS[name][0], [None]) == [None]
    assert column(spark, text.clean_text, [None]) == [""]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n aAbB!?.,@whİſ•tp:/4", max_size=40), min_size=1, max_size=30))
def test_clean_text_random(spark, values):
    assert column(spark, text.clean_text, values) == [py_clean(v) for v in values]
    assert column(spark, text.strip_emails, values) == [re.sub(r"\S+@\S+", " ", v) for v in values]


def test_stopwords(spark):
    assert len(fv.ENGLISH_STOPWORDS) == len(set(fv.ENGLISH_STOPWORDS)) == 179
    words = set(fv.ENGLISH_STOPWORDS) | set(fv.DOMAIN_STOPWORDS)
    s = "the advisor was very kind and on time with. any ok yes"
    got = column(spark, lambda c: text.remove_stopwords(text.tokenize_ws(c)), [s])[0]
    assert got == [t for t in s.split() if t not in words and len(t) > 2]


def py_normalize(name):
    name = re.sub("|".join(fv.CREDENTIALS), " ", name.lower())
    return py_collapse(re.sub(r"[^a-z\s]", " ", name))


def py_remove(body, name):
    adv, out = py_normalize(name), body.lower()
    parts = adv.split()
    if adv:
        out = re.sub(rf"\b{adv}\b", " ", out)
    for t in ({parts[0], parts[-1]} if parts else ()):
        if len(t) >= 3:
            out = re.sub(rf"\b{t}\b", " ", out)
    return py_collapse(out)


NAMES = [("Jane met jane doe; Doe's plan. Janeé jane_x", "Jane Doe, CFP®"), ("adams helped Ada Adams", "Bob Adams"),
         ("nothing here", ""), ("the the the", "The"), ("a+b (c) A+B (C)!", "a+b (c)"), ("x Mary-Ann y", "Mary-Ann O'Neil"),
         ("Li met li", "Li Po"), ("über jane  DOE  end", "Jane Doe"), ("keep  two  blanks", " ")]


def test_names(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(NAMES)], "i int, t string, n string")
    rows = df.select("i", text.remove_entity_name("t", "n").alias("removed"), text.strip_name_literal("t", "n").alias("lit"),
                     text.normalize_name("n").alias("norm"), text.name_mention_flag("t", "n").alias("flag"),
                     text.normalize_name("n", word_bounded=True).alias("bounded")).orderBy("i").collect()

    def literal(t, n):
        return t if not n.strip() else py_collapse(re.sub(re.escape(n.strip()), " ", t, flags=re.I))

    def flag(t, n):
        full = " ".join(n.lower().split())
        if not full:
            return 0
        first = full.split()[0]
        hit = re.search(rf"\b{re.escape(full)}\b", t.lower()) or (
            len(first) >= 2 and re.search(rf"\b{re.escape(first)}\b", t.lower()))
        return int(bool(hit))

    for r, (t, n) in zip(rows, NAMES):
        assert r.removed == py_remove(t, n), (t, n)
        assert r.lit == literal(t, n)
        assert r.norm == py_normalize(n)
        assert r.flag == flag(t, n), (t, n)
    assert rows[1].norm == "bob ada" and rows[1].bounded == "bob adams"


def test_literal_name_with_pattern_characters(spark):
    df = spark.createDataFrame([(r"say a\Eb.* now A\EB.*", r"a\Eb.*")], "t string, n string")
    assert df.select(text.strip_name_literal("t", "n")).first()[0] == "say now"


def test_review_hash(spark):
    df = spark.createDataFrame([("e", "Great!", "2024-03-05 10:00:00", " Al "), ("e", "Great!", None, None)],
                               "e string, t string, d string, r string")
    got = [x[0] for x in df.select(text.review_hash("e", "t", F.col("d").cast("timestamp_ntz"), "r")).collect()]
    keys = ["e||Great!||2024-03-05||Al", "e||Great!||no_date||anonymous"]
    assert got == [hashlib.sha256(k.encode()).hexdigest()[:16] for k in keys]


def test_snippet(spark):
    long = "  " + "x" * 250
    assert column(spark, text.snippet, ["short", long, None, " pad "]) == [
        "short", "x" * 198 + "...", "", "pad"]


def test_sentences_and_keywords(spark):
    s = "One here. Two there!  Three? no.split e.g. this"
    assert column(spark, text.sentences, [s])[0] == re.split(r"(?<=[.!?])\s+", s)
    kept = column(spark, text.keyword_sentence, ["we trust them with all of our long plans", "we trust them",
                                                 "one two three four five six seven eight nine"])
    assert kept == [True, False, False]


def test_random_ngram_counts(spark):
    from collections import Counter

    from revgauge.operators import lexical

    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["aa", "bb", "cc", "the"]) for _ in range(rng.randrange(0, 9))),) for _ in range(200)]
    df = spark.createDataFrame(rows, "review_text_clean string")
    want = Counter()
    for (t,) in rows:
        want.update(py_ngrams([w for w in t.split() if w != "the"], 3))
    got = lexical.lexical_top_ngrams(df, n=3, top_n=500, exclude_stopwords=True).collect()
    assert {r.ngram: r.n for r in got} == dict(want)
    assert [(-r.n, r.ngram) for r in got] == sorted((-r.n, r.ngram) for r in got)

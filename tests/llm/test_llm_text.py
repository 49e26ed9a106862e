"""Decontamination, packing, quality rules, classifier, language ID, LM scoring and HTML against plain versions."""

import hashlib
import html as entities
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import catalog.compare as compare
from revgauge.llm import decontaminate, html, langid, lm, outliers, packing, quality
from revgauge.llm.base import crc_mod
from revgauge.llm.queries import ORACLE, QUERIES, tokenizer_path

ODD = [(1, "", "en"), (2, None, "en"), (3, "a", None), (None, "no id " * 40, "en"), (4, "a", "fr"), (6, "tie " * 200, "en"),
       (6, "tie " * 200, "en"), (7, "été à la " * 40 + "fin", "fr"), (8, "xy z\n" * 60_000, None), (9, " \n\t ", "en"), (10, "123 %&$ 456", "en")]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(d, t, lang, "s", 1, 2.0, "x") for d, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_words long, score double, items string")


def rows_of(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def order(row):
    return tuple((x is None, str(x)) for x in row)


def test_oracles(spark, sf):
    con = compare.connect(sf)
    for name, sql in ORACLE.items():
        assert compare.same(QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()) is None


def plain_passages(text, items, size=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            part = w[k:k + size]
            for i in range(len(own) - len(part) + 1):
                if own[i:i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found |= {str(item)} - {"None"}
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block", [8 << 20, 30])
def test_passages(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Short one."), (3, None), (4, "... !"), (2, "Short one."), (None, "nameless words here"), (12, "w3 W4-w5")]
    docs = [(1, f"Été. {long.upper()}, and so", "e"), (2, "a short, ONE b shortone", "e"), (3, None, "e"), (4, "", "e"), (5, "x nameless WORDS here", "e"),
            (5, "x nameless WORDS here", "e"), (None, "w3\nw4\nw5 short one", "e"), (6, "ß w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 ü w5 w6", "e")]
    test_set = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id long")
    got = decontaminate.passages(frame(spark, docs), test_set).collect()
    assert sorted([(r.doc_id, r.n_words, sum(s.n_words for s in r.spans), list(r["items"])) for r in got], key=order) == sorted(
        [(d, *plain_passages(t, items)) for d, t, _ in docs], key=order)
    text = {d: t for d, t, _ in docs}
    spans = {r.doc_id: [text[r.doc_id].encode()[s.start:s.end].decode() for s in r.spans] for r in got}
    assert spans[1] == [long.upper()] and spans[2] == ["short, ONE"]
    empty = frame(spark, [])
    assert decontaminate.passages(empty, test_set).collect() == []
    assert {len(r.spans) for r in decontaminate.passages(frame(spark, docs), test_set.limit(0)).collect()} == {0}


def check_pieces(rows, documents, window=2048):
    """Every id of every document lies in one piece, sequences have no gaps, and only powers of two are not full."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, t in documents:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got, sequences, held = Counter(), {}, {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        held.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    for (d, n), parts in held.items():
        copies = sum(len(i) for _, i in parts) // n
        if copies == 1:
            whole = np.concatenate([i for _, i in sorted(parts, key=lambda p: p[0])])
            got[d, n, zlib.crc32(whole.tobytes())] += 1
        else:   # rows that repeat an id and a text
            first = next(k for k in want if k[:2] == (d, n))
            got[first] += copies
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_pieces(packing.pack(docs, tokenizer_path(), with_ids=True).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_pieces(packing.pack(frame(spark), tokenizer_path(), with_ids=True).collect(), [(d, t) for d, t, _ in ODD])
    assert packing.pack(frame(spark, []), tokenizer_path()).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder(monkeypatch, name):
    """Ids of the tokenizer itself, also of one that keeps case and blanks, and after words were forgotten."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", "I'll don't 's 't", "a\x1cb\x85c\xa0d", "İ Ǆ ß ﬁ é É Ω ΟΔΟΣ", "<|endoftext|> <|x", "½ ²3 x₂ __a_b-c", "…“q” ‘r’—s", "\n\n", "ab " * 9,
             " Two  Words,\tÀé... élan!?", "a1b2 c~d x's", "ÀÉ ſ ß ÿ Þ"]
    path = public_tokenizers.path(name)
    encoder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    assert encoder.by_word == (name == "word_bpe_49k.json")
    for kept in (1000, 4, 4, 1000):
        monkeypatch.setattr(packing, "REMEMBERED", kept)
        assert [list(i) for i in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert list(encoder.encode(["only new1 words"])[0]) == whole.encode("only new1 words", add_special_tokens=False).ids


def test_nnls():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [1, 1, 0]])
    want = np.array([3.0, 0.0, 5.0])
    assert np.abs(packing.nnls(a, a @ want, 5000) - want).max() < 1e-3


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def counted(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_quality_rules(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op6_robust_outliers"](spark, sf).collect()}
    for r in rows_of(spark, sf):
        assert counted(got[r.doc_id]) == plain_counts(r.text)
    odd = outliers.quality_rules(frame(spark)).collect()
    assert sorted([(r.doc_id, *counted(r)) for r in odd], key=order) == sorted([(d, *plain_counts(t)) for d, t, _ in ODD], key=order)
    assert outliers.quality_rules(frame(spark, [])).collect() == []
    assert not any("Python" in str(x) for x in [outliers.counts(frame(spark))._jdf.queryExecution().executedPlan()])


def test_robust_distances(spark):
    """A tenth of far rows must not shift the estimate, and they must lie outside of it."""
    rng = np.random.default_rng(4)
    x = rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 1]], 2000)
    x[:200] += [30, -20]
    rows = [("en", None, float(a), float(b), i) for i, (a, b) in enumerate(x)] + [("fr", "few", 0.0, 0.0, -1)]
    df = spark.createDataFrame(rows, "lang string, source string, a double, b double, i long")
    got = {r.i: r.d2 for r in outliers.robust_distances(df, ("a", "b"), ["lang", "source"], (0.01, 0.01)).collect()}
    cut = outliers.chi2_quantile(0.999, 2)
    assert abs(cut - 13.8155) < 1e-3 and got[-1] is None
    assert all(got[i] > cut for i in range(200)) and sum(got[i] > cut for i in range(200, 2000)) < 20


def test_quality_classifier(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op7_quality_discriminant"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in rows_of(spark, "/root/testdata/sf0.01", "labels")}
    held = [d for d in labels if got[d].held_out]
    assert np.mean([got[d].predicted == labels[d] for d in held]) > 0.95
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(6, 1), (6, 1), (7, None), (None, 0)], "doc_id long, quality int")
    for labels, want in ((none, {0.5}), (one, {1.0})):
        found = quality.classify(docs, labels, crc_mod() == 2).collect()
        assert len(found) == len(ODD) and {r.score for r in found} == want
    assert quality.classify(frame(spark, []), none, crc_mod() == 2).collect() == []


def test_language_id(spark, sf):
    docs = {r.doc_id: r for r in rows_of(spark, "/root/testdata/sf0.01")}
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]) > 0.98
    learned = langid.profiles(frame(spark))
    found = {r.doc_id: r for r in langid.predict(frame(spark), learned).collect()}
    assert {d for d, r in found.items() if r.lang_pred == "und"} == {1, 2, 9, 10} and found[7].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in found.values())
    empty = langid.profiles(frame(spark, []))
    assert empty.collect() == [] and {r.lang_pred for r in langid.predict(frame(spark), empty).collect()} == {"und"}
    assert langid.predict(frame(spark, []), learned).collect() == []


def plain_grams(text):
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    counts = Counter()
    for word in text.split():
        counts.update(word)
        padded = f" {word} "
        counts.update(padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return counts


def test_grams(monkeypatch):
    is_letter = langid.letters()
    for text in ("", "a", "The cat, the hat. Été l'île 12x3", "ß" * 7):
        g, n = langid.grams(text, is_letter)
        code = lambda s: sum((0 if c == " " else ord(c)) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
        want = Counter()
        for s, k in plain_grams(text).items():
            want[code(s)] += k
        assert dict(zip(g.tolist(), n.tolist(), strict=True)) == dict(want)


def test_lm(spark, sf):
    docs = rows_of(spark, sf)
    got = {r.doc_id: r for r in QUERIES["op1_lm_scoring"](spark, sf).collect()}
    assert {d: r.n_words for d, r in got.items()} == {r.doc_id: len((r.text or "").encode().split()) for r in docs}
    assert all(r.log_prob < 0 for r in got.values() if r.n_words) and all((r.mean_log_prob is None) == (r.n_words == 0) for r in got.values())
    odd = lm.score(frame(spark), passes=1).collect()
    assert sorted([(r.doc_id, r.n_words) for r in odd], key=order) == sorted(
        [(d, len((t or "").encode().split())) for d, t, _ in ODD], key=order)
    assert lm.score(frame(spark, [])).collect() == [] and lm.score(frame(spark, ODD[:2])).count() == 2


def test_lm_rare_words(spark, monkeypatch):
    """Words without a place of their own are scored by their own counts."""
    monkeypatch.setattr(lm, "WORDS", 4)
    texts = ["the of and to " * 60 + "walking " * 40, "talking " * 4, "sing", "talking", "talking", "walking"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r.doc_id: r.log_prob for r in lm.score(frame(spark, rows), passes=0).collect()}
    assert got[5] - got[3] == pytest.approx(np.log(41 / 6)) and got[3] == pytest.approx(got[4])
    assert got[3] - got[2] == pytest.approx(np.log(6 / 1))   # all three end in "ing"


def test_lm_learns():
    """A word that its neighbours settle becomes likelier than its share."""
    words = lm.Vocabulary({}, np.arange(lm.CLASSES), np.zeros(lm.CLASSES), np.zeros(lm.CLASSES))
    rng = np.random.default_rng(1)
    around = rng.integers(0, 8, (4000, 2 * lm.SIDE)).astype(np.int32)
    target = around[:, 1].astype(np.int64)
    net = lm.Network(words.edge + 1)
    for k in range(600):
        net.step(around[k * 100 % 4000:k * 100 % 4000 + 100], target[k * 100 % 4000:k * 100 % 4000 + 100])
    assert -net.forward(around)[2][np.arange(4000), target].mean() < 0.5 < np.log(8)


def simple_article(page):
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:h1|p|br|li|ul|div)[^>]*>", m[1])
    lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(x for x in lines if x)


def test_html_query(spark, sf):
    want = {r.page_id: simple_article(r.html) for r in rows_of(spark, sf, "pages")}
    got = QUERIES["op9_html_main_text"](spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_template(spark):
    """No declared article: the template finds the slot with most text, and texts that all pages share go."""
    def page(i):
        body = "".join(f"<p>Paragraph {k} of story {i} with words of its own, {i * k}.</p>" for k in range(3))
        return (f"<html><body><div class=top><ul><li>Home<li>News</ul></div><div id=c1><div class=story><p>Read this first!</p>{body}</div></div>"
                f"<div class='comments'><p>I disagree, wrote reader {i}.</div><div class=low>Call us</div></body></html>")

    rows = [(i, "http://a.example/x", page(i)) for i in range(8)] + [(3, "http://a.example/x", page(3))]
    rows += [(20, "http://b.example/", "<p>Only &lt;page&gt;&nbsp;here<br>two"), (21, None, None), (22, "x", ""), (23, "http://b.example/", "<scr")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html.main_text(df).collect()]
    for i in range(8):
        text = "\n".join(f"Paragraph {k} of story {i} with words of its own, {i * k}." for k in range(3))
        assert got.count((i, text)) == (2 if i == 3 else 1)
    assert {(20, "Only <page> here\ntwo"), (21, ""), (22, ""), (23, "")} <= set(got)
    assert html.main_text(df.limit(0)).collect() == []


def test_html_template_inside_article(spark):
    """Texts that the pages of a host share go from declared articles too; where there is no template they stay."""
    def page(i):
        return (f"<html><body><h1>Site</h1><article><p>Read this story in our app.</p><p>Story {i} has words of its own.</p>"
                f"<p>Its end, number {i}.</p></article></body></html>")

    rows = [(i, f"http://many.org/{i}", page(i)) for i in range(6)] + [(9, "http://one.org/", page(9))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} has words of its own.\nIts end, number {i}." for i in range(6))
    assert got[9] == "Read this story in our app.\nStory 9 has words of its own.\nIts end, number 9."


def test_html_blocks():
    page = ("<body><nav>menu</nav><main><header><h1>Title</h1></header><p>a <b>b</b>\n c &amp; d<div class=comments>no</div>"
            "<script>var x='</p>'</script><ul><li>e<li>f</ul><form>g</form>tail</main><footer>z")
    assert [t for _, t, aside, _ in html.blocks(page)[0] if not aside] == ["Title", "a b c & d", "e", "f", "tail"]


def test_items_hash(spark, sf):
    got = QUERIES["op2_benchmark_decontamination"](spark, sf).where("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()

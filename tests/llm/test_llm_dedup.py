"""Near-duplicates, suffix-array dedup and sentence spans against plain versions and on odd tables."""

import hashlib
import random
import re

import pytest
from xxhash import xxh64_intdigest

from revgauge.llm import graph, sentences, simhash, suffix
from revgauge.llm.queries import QUERIES

ODD = [(1, ""), (2, None), (3, "a"), (None, "no id " * 40), (4, "a"), (5, "tie " * 200), (6, "tie " * 200), (6, "tie " * 200),
       (7, "été à la " * 40 + "fin"), (8, "x" * 200_000), (9, " \n\t ")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "l", i, "f", 0) for i, (d, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, component_id long, fingerprint string, n_bytes long")


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, within=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= within:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def plain_classes(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    least = {}
    for (d, _), f in zip(rows, fps, strict=True):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return [(d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(rows, fps, strict=True)]


def key(row):
    return tuple((x is None, x) for x in row)


def test_simhash_query(spark, sf):
    got = [tuple(r) for r in QUERIES["op8_simhash_near_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(plain_classes(texts(spark, sf)))


def test_simhash_odd_rows(spark):
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark, ODD)).collect()]
    assert sorted(got, key=key) == sorted(plain_classes(ODD), key=key)
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("bucket", [1024, 2])
def test_links_keep_components(spark, bucket):
    """Fingerprints around a few centres, in buckets compared in place and in buckets too large for it."""
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.append(x)
    to_signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(to_signed(x),) for x in fps], "fp long")
    found = graph.components(simhash.links(df, 4, bucket))
    got = {r.node & (1 << 64) - 1: r.root for r in found.collect()}
    want = plain_components(fps)
    groups = {}
    for f in want:
        groups.setdefault(want[f], set()).add(got.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203), (100, 101)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 205: 200, 203: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_repeats(rows, length):
    """(doc_id, n_bytes, spans, kept) with a set of all strings seen; rows must come in the order of ids."""
    seen, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        if d is not None:
            for s in range(len(b) - length + 1):
                if seen.setdefault(b[s:s + length], (d, s)) != (d, s):
                    covered[s:s + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(covered))]
        out.append((d, len(b), [tuple(s) for s in spans], bytes(c for c, x in zip(b, covered, strict=True) if not x)))
    return out


def repeats(df, **kw):
    return [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix.repeated_spans(df, **kw).collect()]


def test_suffix_query(spark, sf):
    got = {r.doc_id: tuple(r) for r in QUERIES["op5_suffix_array_dedup"](spark, sf).collect()}
    want = plain_repeats(sorted(texts(spark, sf)), 100)
    for d, n, spans, kept in want:
        assert got[d] == (d, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    assert len(got) == len(want)


@pytest.mark.parametrize("length", [4, 9, 40, 100])
def test_suffix_odd_rows(spark, length):
    want = sorted(plain_repeats(ODD, length), key=lambda r: (r[0] is None, r[0] or 0))
    got = sorted(repeats(frame(spark, ODD), length=length), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == want
    assert repeats(frame(spark, []), length=length) == []


def test_suffix_repeated_first_copy(spark):
    """Rows that repeat an id whose passage other documents share: the first copy is whole in both."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    part = letters(95)
    first = letters(300) + part + letters(300)
    rows = [(1, first), (1, first), (2, letters(200) + part + letters(200)), (3, letters(200) + part + letters(200))]
    got = repeats(frame(spark, rows))
    assert sorted(got) == sorted((d, len(t), [], t.encode()) for d, t in rows)


def test_suffix_few_letters(spark):
    """Periodic texts, ties between equal halves and matches at every kind of border."""
    rng = random.Random(3)
    rows = []
    for d in range(60):
        text = "".join(rng.choice("ab") * rng.randint(1, 9) for _ in range(rng.randint(0, 30)))
        rows.append((d, text + rng.choice(["", "ab" * 40, rows[d // 2][1] if d else ""])))
    for length in (10, 25):
        assert sorted(repeats(frame(spark, rows), length=length)) == plain_repeats(rows, length)


def test_suffix_pieces(spark, monkeypatch):
    """Texts longer than a piece give the same answer."""
    monkeypatch.setattr(suffix, "PIECE", 512)
    rng = random.Random(9)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(d, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 900))) + part + part[:d * 20]) for d in range(12)]
    assert sorted(repeats(frame(spark, rows))) == plain_repeats(rows, 100)


def test_suffix_as_text(spark):
    rows = [(1, "é" * 60), (2, "x" + "é" * 60 + "ü")]
    got = {r.doc_id: r.kept for r in suffix.repeated_spans(frame(spark, rows), length=21, as_text=True).collect()}
    assert all("�" not in t for t in got.values()) and got[2] == "x"   # the first byte of the last letter repeats


def test_sentence_spans(spark):
    passage = "One two three four five. Six seven eight nine ten! And so on it went until the end."
    rows = [(1, f"First words stand here alone. {passage} Then more of it."), (2, f"Other start of things. {passage}\nLast line."),
            (3, None), (4, ""), (5, passage), (5, passage), (6, "Same. Same. Same. Same."), (None, passage)]
    got = {(r.doc_id, r.kept) for r in sentences.drop_repeated_spans(frame(spark, rows)).collect()}
    assert (1, rows[0][1]) in got and (2, "Other start of things. Last line.") in got and (5, "") in got
    assert {(3, ""), (4, ""), (6, rows[6][1]), (None, passage)} <= got
    assert sentences.drop_repeated_spans(frame(spark, [])).collect() == []


def test_sentences_repeated_row(spark):
    """Rows that repeat an id whose text stands nowhere else stay whole, in one batch or in two."""
    text = "One two three four five. Six seven eight nine ten! And so on it went until the end."
    rows = [(5, text), (5, text), (7, "Other words stand here all alone. They have no copy in any row.")]
    for parts in (1, 3):
        got = sentences.drop_repeated_spans(frame(spark, rows).coalesce(1).repartition(parts)).collect()
        assert sorted((r.doc_id, r.kept) for r in got) == sorted(rows)


def plain_runs(parts):
    """Shortest runs of two sentences and ten words or more from each sentence on, and back from each."""
    heavy = [max(len(p.split()), len(b"".join(p.split())) // 10) for p in parts]
    fits = {(i, j) for i in range(len(parts)) for j in range(i + 2, min(i + 40, len(parts)) + 1) if sum(heavy[i:j]) >= 10}
    ahead = {min(r for r in fits if r[0] == i) for i in {r[0] for r in fits}}
    back = {max(r for r in fits if r[1] == j) for j in {r[1] for r in fits}}
    return sorted(ahead | back)


def test_short_sentences(spark):
    """Passages of short sentences, and of text without blanks, go whole, their last sentences too."""
    short = "Go on. See it. Take two. Now stop. Wait a bit. Then run. So be it. Done now. Yes."
    blank = "これは長い文章の一つです。二つ目の文もここにあります。三つ目の文で終わりにします。"
    rows = [(1, f"This one opens the first text here. {short} Own end of one."), (2, f"Another opening stands in this one. {short} Two ends."),
            (3, "Go on. See it. Nothing else is shared by this text at all."), (4, blank), (5, "前の文。" + blank + "後の文。")]
    got = {r.doc_id: r.kept for r in sentences.drop_repeated_spans(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Another opening stands in this one. Two ends.", 3: rows[2][1], 4: blank, 5: "前の文。後の文。"}


def test_sentence_query(spark, sf):
    rows = sorted(texts(spark, sf))
    seen, want = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        ends = sentences.split(b)
        parts = [b[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        drop = set()
        for i, j in plain_runs(parts):
            run = [b" ".join(p.lower().split()) for p in parts[i:j]]
            if seen.setdefault(tuple(run), (d, i)) != (d, i):
                drop |= {*range(i, j)}
        want[d] = (len(parts), len(drop), b"".join(p for i, p in enumerate(parts) if i not in drop).decode())
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.kept) for r in QUERIES["op4_sentence_spans"](spark, sf).collect()}
    assert got == want

"""Order MinHash against a plain version, and on odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from revgauge.llm import orderhash
from revgauge.llm.orderhash import OrderMinHash, code_points, likeness
from revgauge.llm.queries import QUERIES

MASK = 2**64 - 1


def mix(x):
    x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & MASK
    x = ((x ^ x >> 29) * 0xA0761D6478BD642F) & MASK
    return x ^ x >> 32


def plain(text, m):
    """Fingerprint from dictionaries and sorted lists; only the hash of one k-mer is the operator's."""
    k = min(m.k, len(text))
    grams = [text[i:i + k] for i in range(len(text) - k + 1)] if text else []
    hashed = {g: int(m.grams(code_points(g))[0]) for g in set(grams)}
    seen, base = Counter(), []
    for g in grams:
        base.append(mix((hashed[g] + seen[hashed[g] >> 24] * m.repeat) & MASK) >> 32)
        seen[hashed[g] >> 24] += 1
    out = []
    for odd in m.odd[:, 0].tolist():
        least = sorted((b * odd % 2**32, i) for i, b in enumerate(base))[:m.size]
        h = 0
        for _, i in sorted(least, key=lambda x: x[1]):
            h = mix(((h ^ hashed[grams[i]]) * m.link) & MASK)
        out.append(h >> 48)
    return out


def plain_rows(rows, m):
    ordered = sorted((d, t or "") for d, t in rows)
    out = []
    for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        a, b, c = (plain(x, m) for x in (t, edited, after))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:04x}" for x in a),
                    "".join(f"{x:04x}" for x in b), likeness(np.array(a), np.array(b)), likeness(np.array(a), np.array(c))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "h", "f") for d, t in rows], "doc_id long, text string, code int, h string, fingerprint string")


def test_small_tables_equal_the_plain_version(spark):
    r = random.Random(2)
    rows = [(i * 7 % 101, "".join(r.choice("abcé 漢") for _ in range(r.choice([0, 1, 3, 7, 8, 9, 11, 30, 400])))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "été " * 300), (503, "été " * 300), (504, "x" * 5000), (505, "😀" * 9)]
    m = OrderMinHash()
    for cut in (1, 6):
        got = orderhash.fingerprints(frame(spark, rows).repartition(cut)).collect()
        assert sorted(map(tuple, got)) == plain_rows(rows, m)
    m = OrderMinHash(3, 4, 8)
    got = orderhash.fingerprints(frame(spark, rows), 3, 4, 8).collect()
    assert sorted(map(tuple, got)) == plain_rows(rows, m)


def test_query(spark, sf):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_order_minhash"](spark, sf).collect()}
    ids = sorted(rows)
    assert sorted(got) == ids
    prints = {}
    for d, after in zip(ids, ids[1:] + ids[:1]):
        r, t, m = got[d], rows[d], OrderMinHash()
        cut = len(t) // 4
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - cut] + rows[after][:cut]).encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.fingerprint == orderhash._hex(m.of(code_points(t)))
        assert r.edited_fingerprint == orderhash._hex(m.of(code_points(t[:len(t) - cut] + rows[after][:cut])))
    long = [r for r in got.values() if r.n_chars >= 200]
    # three quarters of the k-mers of each stay, 0.6 of both: pairs agree in about 0.36
    assert 0.3 < np.mean([r.near_edited for r in long]) < 0.42 and np.median([r.near_next for r in long]) < 0.1


def test_odd_tables(spark):
    assert orderhash.fingerprints(frame(spark, [])).collect() == []
    one, = orderhash.fingerprints(frame(spark, [(3, "abcd" * 10)])).collect()
    assert one.near_next == 1.0 and one.n_chars == 40
    # nulls first, repeated rows side by side, every row once
    rows = [(None, "b" * 40), (None, "a" * 40), (1, "q" * 40), (1, "q" * 40), (1, "r" * 40), (2, None), (9, "z" * 40)]
    got = orderhash.fingerprints(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 1) == 1
    last, = (r for r in got if r.doc_id == 9)
    assert last.edited_sha256 in {hashlib.sha256(("z" * 30 + c * 10).encode()).hexdigest() for c in "ab"}
    named = spark.createDataFrame([("b", "x" * 50), ("a", "y" * 50), ("a10", "x" * 50)], "doc_id string, text string")
    got = {r.doc_id: r for r in orderhash.fingerprints(named).collect()}
    assert got["a"].near_next == 0.0 and got["a10"].near_next == 1.0 and got["b"].near_next == 0.0


def test_order_counts():
    """Moved halves keep their k-mers but not their order; scattered edits cost in proportion."""
    r = random.Random(1)
    text = "".join(r.choice("abcdefghij") for _ in range(4000))
    m = OrderMinHash(8, 2, 512)
    own = m.of(code_points(text))
    moved = likeness(own, m.of(code_points(text[2000:] + text[:2000])))
    assert 0.35 < moved < 0.65   # pairs from both halves, half of all, change their order
    shares = []
    for edits in (4, 16, 64):
        x = list(text)
        for i in r.sample(range(4000), edits):
            x[i] = "X"
        shares.append(likeness(own, m.of(code_points("".join(x)))))
    assert 1 > shares[0] > shares[1] > shares[2] > 0


@pytest.mark.parametrize("keep", [0, 5, 7, 8, 9, 100, 390, 400])
def test_edited_equals_whole(keep):
    r = random.Random(keep)
    m = OrderMinHash(4, 3, 32)
    a, b = (code_points("".join(r.choice("ab") for _ in range(n))) for n in (400, r.choice([0, 1, 100])))
    own, edited = m.of_edited(a, keep, b)
    assert (own == m.of(a)).all() and (edited == m.of(np.concatenate((a[:keep], b)))).all()

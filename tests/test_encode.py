"""Every entry of the hashed encoder's vectors against a plain murmur3."""

import math
import re
from collections import Counter

from revgauge.operators import encode

MASK = 2**32 - 1


def murmur3(data, seed):
    """The published 32-bit hash."""
    h = seed

    def mixed(k):
        k = k * 0xCC9E2D51 & MASK
        return (k << 15 | k >> 17) * 0x1B873593 & MASK

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i:i + 4], "little"))
        h = ((h << 13 | h >> 19) & MASK) * 5 + 0xE6546B64 & MASK
    if len(data) > whole:
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & MASK
    return h


def bucket(word, size):
    h = murmur3(word.encode(), 42)
    return (h - 2**32 if h >= 2**31 else h) % size


def test_buckets_and_values(spark):
    texts = ["good plan good", "", None, "plan", "one two three four five six seven " * 9, "plan's x1 plan"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    size = 16
    plain = {r.i: r.embedding for r in encode.encode_text(df, "t", size=size, normalize=False).collect()}
    unit = {r.i: r.embedding for r in encode.encode_text(df, "t", size=size).collect()}
    words = {i: re.findall("[a-z0-9']{2,}", t or "") for i, t in enumerate(texts)}
    for i, found in words.items():
        want = [0.0] * size
        for w, n in Counter(found).items():
            want[bucket(w, size)] += n
        assert plain[i] == want
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(unit[i], want, strict=True))

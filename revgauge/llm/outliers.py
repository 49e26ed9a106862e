"""Quality rules: word and line counts of a text, and robust multivariate outliers per language and source.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revgauge.llm.base import stored

#: ``[^\\x20\\x09-\\x0D]+`` are words.
BLANKS = "[ \\t-\\r]+"
#: Bits of a window's sort key that hold its place; longer texts take 31.
PLACE_BITS = 24
FEATURES = ("f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats")
#: Quantiles of an estimate are off by one in so many ranks at most.
RANKS = 1000
#: Puts a share of 30 % repeated lines or words alone, in texts that mostly have none, at the cut of ``quality_rules``.
SHARE = 18.5
#: Smallest standard deviation of each feature in an estimate: many texts have no symbols or repeats at all.
FLOOR = (0.25, 0.05, 0.5, 1.0, 1.0)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of the whole text (null: empty).

    Repeated words are found by sorting the hashes of a text's three-word windows with their places, as one array of
    whole numbers per row; neighbours with equal hashes are compared word by word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    df = docs.withColumns({"_words": F.array_remove(F.split(t, BLANKS), ""), "_lines": lines,
                           "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long")})
    n = F.size("_words")
    df = df.withColumns({
        "n_words": n.cast("long"), "n_lines": F.size("_lines").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_bits": F.when(n < 1 << PLACE_BITS, PLACE_BITS).otherwise(31)})
    word = F.col("_words")
    keys = F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.call_function(
        "shiftleft", F.xxhash64(x, F.get(word, i + 1), F.get(word, i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")))
    df = df.withColumn("_keys", F.sort_array(F.when(n > 2, keys).otherwise(F.array().cast("array<long>"))))
    key, bits = F.col("_keys"), F.col("_bits")

    def prefix(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    def equal(x: Column, other: Column) -> Column:
        same = [F.get(word, place(x) + k) == F.get(word, place(other) + k) for k in range(3)]
        return (prefix(x) == prefix(other)) & same[0] & same[1] & same[2]

    def repeated(x: Column, i: Column) -> Column:
        near = [F.coalesce(equal(x, F.get(key, i + k)), F.lit(False)) for k in (-1, 1)]
        far = [F.coalesce(equal(x, F.get(key, i + k)), F.lit(False)) for k in (-2, 2)]
        touches = (prefix(x) == prefix(F.get(key, i - 1))) | (prefix(x) == prefix(F.get(key, i + 1)))
        return F.coalesce(touches, F.lit(False)) & (near[0] | near[1] | far[0] | far[1])

    df = df.withColumn("_found", F.filter("_keys", repeated))
    df = df.withColumn("_places", F.sort_array(F.transform("_found", place)))
    gaps = F.transform("_places", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b))
    return df.drop("_words", "_lines", "_keys", "_bits", "_found", "_places")


def features(df: DataFrame) -> DataFrame:
    """Counts on scales where ordinary texts lie about a centre; shares of repeats stay in proportion, so that a large
    one stands out by itself."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return df.withColumns({
        "f_words": F.log1p(F.col("n_words").cast("double")), "f_word_length": F.log(chars / words),
        "f_symbols": F.log1p(1000.0 * F.col("n_symbols") / chars),
        "f_dup_lines": SHARE * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "f_repeats": SHARE * F.col("n_repeat_words") / words})


def chi2_cdf(x: float, k: int) -> float:
    term = total = 1.0 / math.gamma(k / 2 + 1)
    for i in range(1, 500):
        term *= x / 2 / (k / 2 + i)
        total += term
    return total * math.exp(-x / 2) * (x / 2) ** (k / 2)


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def _moments(names: tuple[str, ...]) -> list[Column]:
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    return [F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i, j in pairs]]


def _factor(df: DataFrame, floor: tuple[float, ...], scale: float) -> DataFrame:
    """Cholesky factor l{i}{j} of the covariance c{i}{j} times ``scale``, its diagonal held above ``floor``; logdet."""
    for i, least in enumerate(floor):
        for j in range(i + 1):
            entry = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * scale + (least * least if i == j else 0.0)
            for k in range(j):
                entry = entry - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            entry = F.sqrt(F.greatest(entry, F.lit(least * least * 1e-3))) if i == j else entry / F.col(f"l{j}{j}")
            df = df.withColumn(f"l{i}{j}", entry)
    return df.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(len(floor))), F.lit(0.0)))


def _distance(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    for i, x in enumerate(names):
        rest = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(names))), F.lit(0.0)))


def robust_distances(df: DataFrame, names: tuple[str, ...], by: list[str], floor: tuple[float, ...], share: float = 0.75,
                     steps: int = 4, least: int = 60) -> DataFrame:
    """``df`` with d2, the squared Mahalanobis distance to the minimum-covariance-determinant estimate of its group.

    Two deterministic starts per group (medians with quartile scales; all its rows) are improved by concentration
    steps: the ``share`` of rows nearest to the estimate gives the next one. The start with the smaller determinant
    wins. A group below ``least`` rows takes the estimate of all rows of its first key (the language), and if those are
    too few, d2 is null. Null keys are a group. Only sums and quantile sketches are shuffled, so a group of any size is
    combined in the tasks that read it; rows meet estimates by a join on the group, which Spark splits where skewed.
    """
    d = len(names)
    df = df.withColumns({"_wide": F.to_json(F.struct(F.col(by[0]).alias("k"))), "_key": F.to_json(F.struct(*by))})
    sizes = df.groupBy("_key", "_wide").agg(F.count("*").alias("_n"))
    wide = sizes.groupBy("_wide").agg(F.sum("_n").alias("_w"), F.min("_n").alias("_fewest"))
    large = F.col("_n") >= least
    pools = sizes.join(wide, "_wide").select(
        "_key", F.when(large, F.col("_key")).when(F.col("_w") >= least, F.col("_wide")).alias("_pool"),
        F.when(large & (F.col("_fewest") < least), F.col("_wide")).alias("_also"))
    df = stored(df.join(stored(pools.repartition(4), "pools"), "_key").drop("_key", "_wide"), "pooled")
    # a row of a large group also stands for its language where that has small groups
    base = df.select(F.explode(F.array_compact(F.array("_pool", "_also"))).alias("_pool"), *names)
    scale = 0.7413
    rough = base.groupBy("_pool").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], RANKS).alias(f"q{i}") for i, x in enumerate(names)])
    rough = rough.select("_pool", F.lit(0).alias("start"), *[F.get(f"q{i}", F.lit(1)).cast("double").alias(f"m{i}") for i in range(d)], *[
        (F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) * scale, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
        for i in range(d) for j in range(i + 1)])
    plain = base.groupBy("_pool").agg(*_moments(names)).drop("n").withColumn("start", F.lit(1))
    # the trimmed rows of a normal sample vary less: the usual factor makes up for it
    factor = share / chi2_cdf(chi2_quantile(share, d), d + 2)

    def few(table: DataFrame) -> DataFrame:
        """One row per group and start, in few files: their size tells Spark whether all tasks can have the table."""
        return stored(table.repartition(4), "estimate")

    now = few(_factor(rough.unionByName(plain), floor, 1.0))
    keep = ["_pool", "start", *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i in range(d) for j in range(i + 1)], "logdet"]
    for _ in range(steps):
        placed = _distance(base.join(now.select(keep), "_pool"), names)
        # a stored table of known size: rows need not be dealt out by their group to meet it
        cut = few(placed.groupBy("_pool", "start").agg(F.percentile_approx("d2", share, RANKS).alias("cut")))
        inner = placed.join(cut, ["_pool", "start"]).where("d2 <= cut")
        now = few(_factor(inner.groupBy("_pool", "start").agg(*_moments(names)), floor, factor))
    best = now.groupBy("_pool").agg(F.min(F.struct("logdet", "start")).alias("b")).select(
        "_pool", F.col("b.start").alias("start"))
    final = few(now.join(best, ["_pool", "start"]).select(keep))
    placed = _distance(df.join(final, "_pool", "left"), names)
    return placed.drop("_pool", "_also", "start", "logdet", *[f"m{i}" for i in range(d)], *[f"z{i}" for i in range(d)],
                       *[f"l{i}{j}" for i in range(d) for j in range(i + 1)])


def quality_rules(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), p: float = 0.99999, text: str = "text",
                  doc_id: str = "doc_id", share: float = 0.75, steps: int = 4, least: int = 60) -> DataFrame:
    """(doc_id, counts, features, base_failed, d2, kept) per row.

    ``base_failed``: under 50 words, or over half of the words repeated. The other texts give robust estimates per
    language and source; one farther out than the ``p`` quantile of the chi-squared distribution is rejected.
    A null text is empty and fails. Null languages or sources are groups of their own; rows of groups too small to
    judge are kept; repeated rows each count and are kept alike; an empty table gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(by)], F.col(text).alias("text"))
    df = features(counts(slim)).drop("text").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = stored(df, "counts")
    keys = [f"by{i}" for i in range(len(by))]
    passed = robust_distances(df.where("not base_failed"), FEATURES, keys, FLOOR, share, steps, least)
    failed = df.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    inside = F.coalesce(F.col("d2") <= chi2_quantile(p, len(FEATURES)), F.lit(True))
    return passed.unionByName(failed).withColumn("kept", ~F.col("base_failed") & inside).drop(*keys)

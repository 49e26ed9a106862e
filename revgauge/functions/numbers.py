"""Number scalars and descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revgauge import fixed_values as fv


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = _col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x, low=None, high=None) -> Column:
    out = _col(x)
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def half_life_weight(age, half_life=fv.HALF_LIFE_YEARS) -> Column:
    return F.pow(F.lit(0.5), _col(age) / F.lit(float(half_life)))


def informativeness_weight(tokens, ref=fv.TOKEN_REF, floor=fv.INFO_FLOOR, cap=fv.INFO_CAP) -> Column:
    return clip(F.sqrt(clip(_col(tokens).cast("double"), 0) / F.lit(float(ref))), floor, cap)


def effective_n(weight) -> Column:
    """Kish effective sample size of an aggregate's weights; 0 when they are all 0."""
    w = _col(weight)
    squares = F.sum(w * w)
    return F.when(squares == 0, F.lit(0.0)).otherwise(F.pow(F.sum(w), F.lit(2.0)) / squares)


def tier_from_percentile(p) -> Column:
    p = _col(p)
    return (F.when(p >= 75, fv.TIERS[0]).when(p >= 50, fv.TIERS[1]).when(p >= 25, fv.TIERS[2])
            .when(p.isNotNull(), fv.TIERS[3]))


def tier_from_breakpoints(score, p75=None, p50=None, p25=None) -> Column:
    """Tier of a raw score; a missing breakpoint falls back to its fixed value."""
    s = _col(score)

    def bound(given, name):
        fixed = F.lit(fv.DEFAULT_BREAKPOINTS[name])
        return fixed if given is None else F.coalesce(_col(given), fixed)

    return (F.when(s >= bound(p75, "p75"), fv.TIERS[0]).when(s >= bound(p50, "p50"), fv.TIERS[1])
            .when(s >= bound(p25, "p25"), fv.TIERS[2]).otherwise(fv.TIERS[3]))


def confidence_tier(review_count) -> Column:
    n = _col(review_count)
    return (F.when(n < fv.DIRECTIONAL_REVIEWS, "directional").when(n >= fv.PREMIER_REVIEWS, "premier")
            .otherwise("none"))


def persona(score) -> Column:
    s = _col(score)
    return F.when(s >= 80, "Headliner").when(s >= 65, "Opener").otherwise("Indie")


def describe(x, prefix: str) -> list[Column]:
    """Count, mean, sample deviation, minimum, quartiles and maximum of a whole-number column.

    The exact quartiles keep one counter per distinct value, which whole numbers keep small; for continuous columns
    use ``operators.positions.exact_quantiles``.
    """
    x = _col(x)
    cuts = F.percentile(x, F.lit([0.25, 0.5, 0.75]))   # one buffer for all three
    quartiles = [F.get(cuts, F.lit(i)).alias(f"{prefix}_{name}") for i, name in enumerate(("p25", "p50", "p75"))]
    return [F.count(x).alias(f"{prefix}_count"), F.avg(x).alias(f"{prefix}_mean"),
            F.stddev_samp(x).alias(f"{prefix}_std"), F.min(x).cast("double").alias(f"{prefix}_min"), *quartiles,
            F.max(x).cast("double").alias(f"{prefix}_max")]

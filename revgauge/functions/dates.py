"""Date scalars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from revgauge.fixed_values import DAYS_PER_YEAR


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Ways to write a date besides ISO, tried in this order; month before day where both would fit.
PATTERNS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy/M/d H:mm:ss", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy",
            "d MMMM yyyy", "d MMM yyyy")


def parse_date(text, patterns: Sequence[str] = PATTERNS) -> Column:
    """Text to timestamp without time zone: ISO first, then the patterns; what cannot be read becomes NULL."""
    c = F.trim(_col(text).cast("string"))
    others = [F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in patterns]
    return F.coalesce(c.try_cast("timestamp_ntz"), *others)


def seconds_between(start, end) -> Column:
    """Seconds from ``start`` to ``end``, with fraction."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(1e6)


def age_years_days(date, as_of, days_per_year: float = DAYS_PER_YEAR) -> Column:
    """Age in years from whole days (a day counts when 24 hours have passed)."""
    return F.floor(seconds_between(date, as_of) / 86400) / F.lit(float(days_per_year))


def age_years_exact(date, as_of, days_per_year: float = DAYS_PER_YEAR) -> Column:
    """Age in years to the second, never negative."""
    years = seconds_between(date, as_of) / F.lit(float(days_per_year) * 86400)
    return F.when(years < 0, F.lit(0.0)).otherwise(years)


def period_start(date, freq: str) -> Column:
    if freq not in ("day", "month", "quarter", "year"):
        raise ValueError(f"unknown period: {freq}")
    return F.date_trunc(freq, _col(date)).cast("date")


def period_label(date, freq: str) -> Column:
    """``2024-03``, ``2024-Q1`` or ``2024``; days as ``2024-03-05``."""
    date = _col(date)
    if freq == "quarter":
        return F.concat(F.date_format(date, "yyyy"), F.lit("-Q"), F.quarter(date).cast("string"))
    formats = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    if freq not in formats:
        raise ValueError(f"unknown period: {freq}")
    return F.date_format(date, formats[freq])

"""Time as microseconds since the epoch, so that results don't depend on a session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def window_start(us: Column | str, size: int) -> Column:
    """Start of the half-open window of `size` microseconds; rounds down before 1970, too."""
    us = F.col(us) if isinstance(us, str) else us
    return us - F.pmod(us, F.lit(size))


def whole(x: Column, by: int) -> Column:
    """Whole multiples of `by` in a non-negative number."""
    return F.floor(x / by).cast("long")

"""Time helpers that work for TIMESTAMP and TIMESTAMP_NTZ columns alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of the wall-clock value (no zone shift for
    TIMESTAMP_NTZ; TIMESTAMP is read in the session time zone)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz"))


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch (floor)."""
    return F.floor(epoch_micros(ts) / 1_000_000).cast("long")


def elapsed_ms(start, end) -> Column:
    """(end - start) in milliseconds, like ``(t1 - t0) * 1000`` on seconds."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1000.0)


def stamp(ts) -> Column:
    """Run stamp ``yyyyMMdd_HHmmss``."""
    return F.date_format(_c(ts).cast("timestamp_ntz"), "yyyyMMdd_HHmmss")

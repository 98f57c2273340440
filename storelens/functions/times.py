"""Zone-independent conversions between wall-clock timestamps and epoch
microseconds.

Driver timestamps are ``timestamp_ntz`` (no zone).  Casting them to
``timestamp`` would read them in the session time zone, so results would
shift with ``spark.sql.session.timeZone``; these helpers read them as UTC
wall clock whatever the session says.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH_NTZ_SQL = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_us_sql(expr: str) -> str:
    """SQL text: microseconds since the epoch of a ``timestamp_ntz`` expression."""
    return f"timestampdiff(MICROSECOND, {EPOCH_NTZ_SQL}, {expr})"


def epoch_us(c) -> Column:
    """Microseconds since the epoch of a ``timestamp_ntz`` column (name or Column)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ_SQL), col)


def ntz_from_us(us: Column) -> Column:
    """``timestamp_ntz`` wall clock (UTC) of an epoch-microsecond value."""
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH_NTZ_SQL))


def instant_from_us(us: Column) -> Column:
    """Event-time ``timestamp`` (an instant) of an epoch-microsecond value."""
    return F.timestamp_micros(us)

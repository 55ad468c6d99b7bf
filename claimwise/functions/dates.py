"""Date expressions (E1–E10).  Timestamps are TIMESTAMP_NTZ end to end, so no
plan depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

# Day-first formats first, then ISO (ruling Q8: every value parsed on its own).
DATE_FORMATS = [
    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy",
    "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy",
    "dd.MM.yyyy",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd", "yyyy/MM/dd",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_ts(c, dtype=None) -> Column:
    """E1 safe_to_datetime: timestamps pass through; strings are parsed
    day-first; anything unparseable -> null."""
    if isinstance(dtype, TimestampNTZType):
        return _c(c)
    if isinstance(dtype, (TimestampType, DateType)):
        return _c(c).cast("timestamp_ntz")
    s = F.regexp_replace(_c(c).cast("string"), r"^\s+|\s+$", "")
    parsed = [F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATE_FORMATS]
    # parse and cast share the session zone, so the wall-clock value is kept
    return F.coalesce(*parsed).cast("timestamp_ntz")


def seconds_between(start, end) -> Column:
    """Exact elapsed seconds (fractional) between two NTZ timestamps."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / 1e6


def whole_days(start, end) -> Column:
    """floor((end - start) / 1 day); negative -> null."""
    d = F.floor(seconds_between(start, end) / 86400.0)
    return F.when(d >= 0, d).cast("double")


def hours_between(start, end) -> Column:
    """Elapsed hours, negative -> null."""
    h = seconds_between(start, end) / 3600.0
    return F.when(h >= 0, h)


def date_key(c) -> Column:
    """E5: yyyyMMdd as int."""
    return F.date_format(_c(c), "yyyyMMdd").cast("int")


def day_of_week_mon0(c) -> Column:
    """Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(_c(c))


def month_start(c) -> Column:
    """First day of the month as DATE."""
    return F.trunc(_c(c).cast("date"), "MM")


def month_label(c) -> Column:
    """E8: 'MMMM yyyy' (e.g. 'March 2026')."""
    return F.date_format(_c(c), "MMMM yyyy")


def period_label(c) -> Column:
    """E8: 'yyyy-MM'."""
    return F.date_format(_c(c), "yyyy-MM")


def month_grid(start, months: int) -> Column:
    """Array of `months` consecutive month starts beginning at `start`."""
    s = _c(start)
    return F.sequence(s, F.add_months(s, months - 1), F.expr("interval 1 month"))

"""Log predicates (D1-D9) combined into one filter.

All predicates are built-in Column expressions with literal constants, so the
time range and IN lists reach the Parquet scan as PushedFilters, and on stored
(date-partitioned) tables the implied date range prunes whole partitions.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import ts_literal_like
from logtide.functions.text import contains_pattern, parse_time, split_list


def _as_time(value, now: datetime) -> datetime:
    return parse_time(value, now) if isinstance(value, str) else value


def time_bounds(df: DataFrame, col: str, start: datetime | None, end: datetime | None) -> Column:
    """start <= col < end (either may be open), with the date range this implies on a
    date-partitioned table, so that files of other dates are never opened."""
    conds = []
    if start is not None:
        conds.append(F.col(col) >= ts_literal_like(df, col, start))
    if end is not None:
        conds.append(F.col(col) < ts_literal_like(df, col, end))
    if "date" in df.columns:
        if start is not None:
            conds.append(F.col("date") >= F.lit(start.date().isoformat()).cast("date"))
        if end is not None:
            conds.append(F.col("date") <= F.lit(end.date().isoformat()).cast("date"))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def time_range(df: DataFrame, start: datetime, end: datetime, col: str = "timestamp") -> Column:
    """Half-open [start, end); adds the date range when the table is date-partitioned."""
    return time_bounds(df, col, start, end)


def message_contains(q: str | None, col: str = "message") -> Column | None:
    """Case-insensitive substring; `\\`, `%`, `_` and quotes are literal; NULL never matches."""
    if not q:
        return None
    return F.col(col).ilike(contains_pattern(q))


def one_of(col: str, values: str | list[str] | None) -> Column | None:
    """Membership in a comma-separated list (values not trimmed)."""
    vals = split_list(values) if isinstance(values, str) or values is None else list(values)
    if not vals:
        return None
    return F.col(col).isin(vals)


def priority_at_most(p: int | None, col: str = "priority") -> Column | None:
    """Severity threshold; NULL priority is excluded."""
    if p is None:
        return None
    return F.col(col) <= F.lit(int(p))


def minute_equals(df: DataFrame, minute: datetime) -> Column:
    """minute_key equality plus the implied one-minute time range, so files are skipped."""
    minute = minute.replace(second=0, microsecond=0)
    key = minute.strftime("%Y-%m-%dT%H:%M:00+00:00")
    return (F.col("minute_key") == F.lit(key)) & time_range(df, minute, minute + timedelta(minutes=1))


def log_filter(
    df: DataFrame,
    now: datetime,
    start="-1h",
    end="now",
    q: str | None = None,
    hostname=None,
    unit=None,
    priority: int | None = None,
) -> DataFrame:
    """D1-D6 in one filter: time range, text, hosts, units, severity."""
    s, e = _as_time(start, now), _as_time(end, now)
    conds = [
        time_range(df, s, e),
        message_contains(q),
        one_of("_HOSTNAME", hostname),
        one_of("_SYSTEMD_UNIT", unit),
        priority_at_most(priority),
    ]
    out = df
    for c in conds:
        if c is not None:
            out = out.filter(c)
    return out


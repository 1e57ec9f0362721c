"""Journal sources and read positions.

The journal is re-aimed at exported journal JSON lines (one object per line).
Read positions that the journal API offers by cursor become declarative
filters and top-k sorts over the time column; "newest N" is a top-k
(`TakeOrderedAndProject`), never a full sort into one task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.columns import ts_literal_like
from logtide.operators.ingest import parse_entries, rows_where_once, type_fields, with_entry_timestamp
from logtide.operators.predicates import time_bounds
from logtide.operators.ranking import locate_ranks, rank_slice
from logtide.session import ensure_utc

MAP_TYPE = "map<string,string>"
DEFAULT_HISTORY = timedelta(hours=1)


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON text lines -> `fields` map; lines that are not JSON objects are dropped.

    Non-text values (numbers, arrays) are kept as their JSON text.  A JSON null
    reads as NULL, the same as an absent field, and is left out of the overflow
    JSON; no lambda is applied here, so the parse stays in generated code, and
    `rows_where_once` keeps it to one parse per line.
    """
    parsed = lines.select(F.from_json(F.col(col), MAP_TYPE).alias("fields"))
    return rows_where_once(parsed, F.col("fields").isNotNull())


def line_report(lines: DataFrame, now: datetime | None = None, col: str = "value") -> DataFrame:
    """Ingest counters over raw lines in one pass: lines read, lines that are not
    JSON objects, entries accepted, entries rejected for an unparsable clock."""
    parsed = lines.select(F.from_json(F.col(col), MAP_TYPE).alias("fields"))
    tagged = with_entry_timestamp(parsed, now)
    ok_json = F.col("fields").isNotNull()
    return tagged.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~ok_json).alias("not_json"),
        F.count_if(ok_json & F.col("_ts_ok")).alias("accepted"),
        F.count_if(ok_json & ~F.col("_ts_ok")).alias("rejected"),
    )


def judged_lines(lines: DataFrame, now: datetime | None = None, col: str = "value") -> DataFrame:
    """(line, fields, timestamp, reason): every line parsed once; reason is NULL for an entry to
    accept, `not_json` for a line that is no JSON object, `bad_clock` for an entry whose clock is no number."""
    parsed = lines.select(F.col(col).alias("line"), F.from_json(F.col(col), MAP_TYPE).alias("fields"))
    reason = F.when(F.col("fields").isNull(), "not_json").when(~F.col("_ts_ok"), "bad_clock")
    return with_entry_timestamp(parsed, now).withColumn("reason", reason).drop("_ts_ok")


def accepted_rows(lines: DataFrame, now: datetime | None = None, col: str = "value") -> DataFrame:
    """Typed rows of the lines that are accepted."""
    judged = judged_lines(lines, now, col).select("fields", "timestamp", "reason")
    return type_fields(rows_where_once(judged, F.col("reason").isNull()))


def rejected_lines(lines: DataFrame, now: datetime | None = None, col: str = "value") -> DataFrame:
    """(reason, line) of the lines that are not: with `accepted_rows`, every line is in one of the two."""
    judged = judged_lines(lines, now, col).select("reason", "line")
    return rows_where_once(judged, F.col("reason").isNotNull())


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A1: exported journal files -> `fields` map rows (batch)."""
    ensure_utc(spark)
    return parse_lines(spark.read.text(path))


def stream_journal(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A2: follow a directory of exported journal files (streaming)."""
    ensure_utc(spark)
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_lines(reader.load(path))


def read_journal_typed(spark: SparkSession, path: str, now: datetime) -> DataFrame:
    """A1 + B1-B5: exported files straight to typed journal_logs rows."""
    return parse_entries(read_journal(spark, path), now)


def _newest_order(df: DataFrame) -> list[Column]:
    order = [F.col("timestamp").desc()]
    if "__SEQNUM" in df.columns:
        order.append(F.col("__SEQNUM").desc_nulls_last())
    return order


def newest_first(df: DataFrame) -> DataFrame:
    """A4: read backward (newest first)."""
    return df.orderBy(*_newest_order(df))


def _newest(df: DataFrame, n: int) -> DataFrame:
    tiebreak = "__SEQNUM" if "__SEQNUM" in df.columns else None
    return rank_slice(df, 0, int(n), descending=True, col="timestamp", tiebreak=tiebreak)


def tail(df: DataFrame, n: int) -> DataFrame:
    """A3: the newest n entries: a top-k when small, else the rows from the
    located n-th newest timestamp on (no P x n merge in one task)."""
    return _newest(df, n)


def tail_start(df: DataFrame, n: int) -> datetime | None:
    """A3 (stream form): the time from which the newest n stored entries begin,
    located by the bounded bucket descent; None when there are fewer than n."""
    found = locate_ranks(df, [int(n)], descending=True)[0]
    return found[0] if found else None


def follow_from(entries: DataFrame, start: datetime | None) -> DataFrame:
    """A3 (stream form): typed entries at or after `start` (all when None).
    Entries sharing the start time are all kept, so a tie can add a few more
    than n."""
    if start is None:
        return entries
    return entries.filter(F.col("timestamp") >= ts_literal_like(entries, "timestamp", start))


def at_timestamp(df: DataFrame, ts: datetime) -> DataFrame:
    """A5: entries whose microsecond clock equals ts exactly."""
    micros = F.unix_micros(F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
    exact = F.col("__REALTIME_TIMESTAMP") == micros
    if "date" in df.columns:
        # a stored entry with a clock has that clock as its timestamp: open its date only
        exact = exact & time_bounds(df, "timestamp", ts, ts + timedelta(microseconds=1))
    return df.filter(exact)


def skip_older_than(df: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """Entries at or after cutoff, and a one-row count of those skipped."""
    kept = df.filter(time_bounds(df, "timestamp", cutoff, None))
    skipped = df.filter(time_bounds(df, "timestamp", None, cutoff)).agg(F.count(F.lit(1)).alias("skipped"))
    return kept, skipped


def recent_history(df: DataFrame, now: datetime, cutoff: datetime | None = None,
                   max_checked: int | None = None) -> DataFrame:
    """Entries with cutoff <= ts <= now, of the newest `max_checked` ones if that is given.

    A cap is the caller's choice.  It applies before the window filter (the newest
    entries are checked first), so entries after `now` use up checks; the newest
    `max_checked` rows are cut out by locating the boundary timestamp.
    """
    cutoff = cutoff or (now - DEFAULT_HISTORY)
    lo, hi = ts_literal_like(df, "timestamp", cutoff), ts_literal_like(df, "timestamp", now)
    window = (F.col("timestamp") >= lo) & (F.col("timestamp") <= hi)
    if max_checked is None:
        return df.filter(window & time_bounds(df, "timestamp", cutoff, now + timedelta(microseconds=1)))
    return _newest(df, max_checked).filter(window)


def backfill(df: DataFrame, max_bytes: int) -> DataFrame:
    """Newest entries first, instant by instant, until the stored bytes reach the budget.

    An instant is loaded when the bytes of all newer ones are still under the
    budget.  The cutoff comes from bounded aggregates (`budget_cutoff`) and is
    applied as a pushed-down time filter, so the rows themselves are never
    sorted or shuffled.
    """
    from logtide.operators.maintenance import budget_cutoff

    cut = budget_cutoff(df, max_bytes, "reach")
    if cut is None:
        return df.limit(0)
    return df.filter(time_bounds(df, "timestamp", cut, None))

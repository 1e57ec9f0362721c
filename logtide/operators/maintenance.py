"""Sinks and table maintenance (C1-C11): append, schema conform, deletes,
retention by age and by size, the oldest-tenth cut, reports, compaction.

Stored tables are Parquet partitioned by `date`.  Deletes are expressed as the
complementary filter; table jobs rewrite only the dates a delete touches.  A job
lists the files it replaces before it reads them, writes their replacement beside
the table, claims their dates, looks whether the files are still there, and only then
moves the replacement in and deletes exactly the listed files.  Of two jobs on one date
one loses: it drops what it staged and starts again from what is stored by then.  Rows
that others append meanwhile are in files no job touches.  A note in the table names the
files to delete from the moment the replacement is whole, so the next job finishes
what a failed one began; between the two steps readers may see rows twice, never
miss any (`sources/files.py`).

What is stored per date is known from the ledger (`sources/ledger.py`): whole dates are
counted and dropped without a scan.

Cutoffs that depend on the data (the oldest tenth, size budgets) are found on
small aggregates whose size is bounded by the time span, never by the row
count: a bucket descent day -> minute -> millisecond -> microsecond
(`operators.ranking` for ranks, `budget_cutoff` for bytes) where each level holds
at most 60,000 buckets.  The
cutoff then reaches the scan as a literal time filter.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.columns import row_bytes, ts_literal_like
from logtide.operators.predicates import minute_equals, time_bounds
from logtide.operators.ranking import EPOCH, LEVELS, from_micros, kth_timestamp, locate_ranks
from logtide.sources.files import TableFiles, date_of
from logtide.sources.ledger import Ledger
from logtide.sources.tables import listed_dates

#: Dates whose totals are brought to the driver by one job of a size budget.
MOST_DATES = 64
#: Times a job starts anew after losing a date to another one, and the seconds it waits at most.
ATTEMPTS, LONGEST_WAIT = 40, 5.0
#: Bytes of rows, as tasks hold them, that a task sorts and writes; a larger batch gets more tasks, a larger date more files.
FILE_BYTES = 128 << 20
#: Bits of the Bloom filter of a batch's keys (4 MB), and bits of one of its rows.
BLOOM_BITS, BITMAP_BITS = 1 << 25, 32768


# C1-C4 --------------------------------------------------------------------------


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date(F.col("timestamp")))


def _time_ordered(df: DataFrame) -> DataFrame:
    """Rows in time order inside each task (no shuffle): the partitioned writer
    sorts by date anyway, and a timestamp order within each file keeps the
    Parquet row-group min/max tight, so time filters skip row groups."""
    return df.sortWithinPartitions("date", "timestamp")


def _memory(df: DataFrame) -> Column:
    """Bytes that rows take in a sort: 8 a field, a text its own besides."""
    return F.coalesce(F.sum(row_bytes(df) + F.lit(8 * len(df.columns))), F.lit(0))


def _by_value(df: DataFrame) -> Column:
    """A hash of a row's values but its date, by which rows of one time are spread."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.name != "date" and "map<" not in f.dataType.simpleString()])


def _write_layout(df: DataFrame) -> DataFrame:
    """Range-partition by (date, timestamp), then sort within each task.

    Each task gets a contiguous stretch of time, so it writes files for one or
    two dates instead of every date it happened to hold (tasks x dates small
    files), and a date holding a third of the rows is split over several tasks
    by the sampled range bounds.  Adaptive execution sizes the partition count by
    compressed bytes, which say little of rows of mostly empty columns: where a task
    for every core would hold more than `FILE_BYTES` of rows, there are as many as keep to it.
    """
    rows = with_date(df)
    tasks = -(-rows.agg(_memory(rows)).first()[0] // FILE_BYTES)
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return _time_ordered(rows.repartitionByRange("date", "timestamp"))
    return _time_ordered(rows.repartitionByRange(tasks, F.col("date"), F.col("timestamp"), _by_value(rows)))


def _append(df: DataFrame, path: str, mode: str) -> None:
    _write_layout(df).write.mode(mode).partitionBy("date").parquet(path)
    if not _is_stage(path):  # staged files are entered when they are in the table
        Ledger(df.sparkSession, path).refresh()


def _is_stage(path: str) -> bool:
    return path.rstrip("/").rsplit("/", 1)[-1].startswith("_stage-")


def write_logs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append typed log rows, partitioned by date, time-ordered per file, and enter them in the ledger."""
    _append(df, path, mode)


def write_process_metrics(df: DataFrame, path: str, mode: str = "append") -> int | None:
    """Append the process rows whose (timestamp, pid) is not stored (`append_samples`); returns how many.

    Other modes, and staging folders, get the rows as they are."""
    if mode == "append" and not _is_stage(path):
        return append_samples(df, path)
    _append(df, path, mode)


def absent_keys(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `batch` (read twice) whose keys `stored` (scanned once) lacks; keys are compared NULL-safe.

    A Bloom filter of the batch's keys, a bitmap aggregate of a fixed size, is broadcast to the
    scan and leaves few stored keys; an exact anti-join on those decides."""
    place = F.pmod(F.xxhash64(*keys), F.lit(BLOOM_BITS))
    bits = batch.groupBy(F.floor(place / BITMAP_BITS).cast("int").alias("_row")).agg(
        F.bitmap_construct_agg(F.pmod(place, F.lit(BITMAP_BITS))).alias("_bits"))
    own = stored.select(*keys).withColumn("_place", place)
    own = own.withColumn("_row", F.floor(F.col("_place") / BITMAP_BITS).cast("int")).withColumn("_bit", F.pmod("_place", F.lit(BITMAP_BITS)).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    likely = own.join(F.broadcast(bits), "_row").where(byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) != 0)
    likely = likely.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    return batch.join(likely, same, "left_anti")


def append_samples(df: DataFrame, path: str, order_col: str = "seq") -> int:
    """Append the samples whose (timestamp, pid) is not stored; returns how many.

    Of equal keys in `df` one row stays (`processes.one_per_key`).  The batch is written beside the
    table once; only stored files of its dates are read, once, and the dates are claimed before rows move
    in, so of two appends of one key, at once or later, the second adds nothing."""
    from logtide.operators.processes import one_per_key

    spark, name = df.sparkSession, uuid.uuid4().hex[:12]
    table = TableFiles(spark, path)
    batch = table.stage(name)
    _write_layout(one_per_key(df, order_col)).write.partitionBy("date").parquet(batch)
    dates = sorted(p.rsplit("=", 1)[1] for p in table._glob(f"{batch}/date=*"))
    if not dates:
        table.drop(f"_stage-{name}")
        return 0
    rows = spark.read.schema(with_date(df).drop(order_col).schema).parquet(batch)
    if not table.files(dates=dates):  # nothing to compare with: the batch itself moves in
        n = rows.count()
        if table.claim(name, dates) and not table.files(dates=dates) and table.note(name, []) is not False:
            table.finish(name)
            Ledger(spark, path).refresh()
            return n
        table.call_off(None)

    def plan(files: list[str]) -> tuple[list[str], DataFrame, int]:
        new = absent_keys(rows, _read_files(spark, path, files), ["timestamp", "pid"]) if files else rows
        # a date's rows go to a few tasks, so to a few files
        return [], _time_ordered(new.repartition("date", F.pmod(F.xxhash64("timestamp"), F.lit(8)))), -1

    try:
        return _exchange(spark, path, dates, plan, exact=True)
    finally:
        table.drop(f"_stage-{name}")


def conform(df: DataFrame, schema) -> DataFrame:
    """C4: bring rows of an older schema version to `schema`; missing columns are typed NULLs."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


# Deletes as complementary filters ------------------------------------------------


def delete_minute(df: DataFrame, minute: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows kept after deleting one minute, and the deleted count."""
    cond = minute_equals(df, minute)
    return df.filter(~cond), df.agg(F.count_if(cond).alias("deleted"))


def clear(df: DataFrame) -> DataFrame:
    """An empty frame of the same schema."""
    return df.limit(0)


def retain_by_age(df: DataFrame, now: datetime, days: int) -> tuple[DataFrame, DataFrame]:
    """Delete rows with timestamp < now - days (a row exactly at the cutoff stays)."""
    edge = now - timedelta(days=int(days))
    old = F.col("timestamp") < ts_literal_like(df, "timestamp", edge)
    kept = df.filter(~old if "date" not in df.columns else ~old & time_bounds(df, "timestamp", edge, None))
    gone = df.filter(old if "date" not in df.columns else time_bounds(df, "timestamp", None, edge))
    return kept, gone.agg(F.count(F.lit(1)).alias("deleted"))


def kth_smallest_timestamp(df: DataFrame, k: int) -> datetime | None:
    """The k-th smallest timestamp (1-based), by the bounded bucket descent."""
    return kth_timestamp(df, k, descending=False)


def drop_oldest_tenth(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete rows whose timestamp is among the oldest n/10 rows' timestamps.

    n/10 rounds half to even (5 rows -> 0, 15 -> 2, 25 -> 2).  Ties at the
    boundary all go: the deleted set is exactly `timestamp <= T_k` with T_k the
    k-th smallest timestamp, which is found by a bucket descent instead of a
    sort of 10% of the table.
    """
    # k = n/10, half to even (Python's round), resolved from the descent's first
    # level so the table is not counted in a separate pass.
    found = locate_ranks(df, [lambda n: int(round(n / 10))])[0]
    cut = found[0] if found else None
    spark = df.sparkSession
    if cut is None:
        report = spark.range(1).select(F.lit(0).cast("long").alias("deleted"), F.lit(None).cast("timestamp_ntz").alias("cutoff"))
        return df, report
    lit = ts_literal_like(df, "timestamp", cut)
    t, before, untimed = F.col("timestamp"), F.col("timestamp") <= lit, F.col("timestamp").isNull()
    after = t > lit
    if "date" in df.columns:  # either side opens its own dates only; a row without a time has no date
        day = F.lit(cut.date().isoformat()).cast("date")
        before, after, untimed = before & (F.col("date") <= day), after & (F.col("date") >= day), untimed & F.col("date").isNull()
    report = df.filter(before).agg(F.count(F.lit(1)).alias("deleted")).withColumn("cutoff", lit.cast("timestamp_ntz"))
    return df.filter(after | untimed), report


def minute_totals(df: DataFrame) -> DataFrame:
    """Bytes and rows per minute (bounded by the time span, 1,440 per day).

    The minute is zone-less (date_trunc alone returns a zoned timestamp, which
    the driver would read in its own local zone)."""
    minute = F.date_trunc("minute", F.col("timestamp").cast("timestamp_ntz")).cast("timestamp_ntz")
    return df.groupBy(minute.alias("minute")).agg(
        F.sum(row_bytes(df, exclude=("date",))).alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def _newest_first(df: DataFrame, ts: Column, rb: Column):
    """(day, bytes), newest first: whole table in one aggregate, or a few dates at a time
    of a date-partitioned one, so that a budget reads little more than it keeps."""
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    total = lambda part: sorted(part.groupBy(day.alias("b")).agg(F.sum(rb).alias("bytes")).collect(), key=lambda r: r["b"], reverse=True)
    dates = listed_dates(df)
    if dates is None:
        yield from total(df)
        return
    at, batch = 0, 1
    while at < len(dates):
        last, first = dates[at], dates[min(at + batch, len(dates)) - 1]
        yield from total(df.filter(F.col("date").between(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date"))))
        at += batch
        batch = min(2 * batch, MOST_DATES)


def budget_cutoff(df: DataFrame, max_bytes: int, rule: str = "fit", days: Iterable | None = None) -> datetime | None:
    """Oldest time kept when rows are taken newest first, instant by instant, under a
    byte budget; None when nothing is kept.

    rule "fit" (retention, C8): an instant is kept while it and all newer ones fit the
    budget; the newest one is kept by any budget above 0, so a heavy instant never
    empties a table.  rule "reach" (backfill, A8): an instant is loaded while the newer
    ones are still under the budget, so the last one crosses it.

    Bytes are those of `row_bytes` without `date`, for frames and stored tables alike.
    Days are walked newest first (`days`: their totals, if they are known already); the one where the budget runs out is cut into minutes,
    the minute into milliseconds, that into microseconds: at most 60,000 buckets a level.
    """
    budget = int(max_bytes)
    if budget <= 0:
        return None
    ts = F.col("timestamp").cast("timestamp_ntz")
    rb = row_bytes(df, exclude=("date",))
    live = df.filter(F.col("timestamp").isNotNull())
    used, keep_from = 0, None

    def boundary(buckets) -> datetime | None:
        nonlocal used, keep_from
        for r in buckets:
            if used + r["bytes"] > budget or (rule == "reach" and used + r["bytes"] == budget):
                return r["b"]
            used, keep_from = used + r["bytes"], r["b"]
        return None

    at, width = boundary(_newest_first(live, ts, rb) if days is None else days), LEVELS[0]
    for finer in LEVELS[1:]:
        if at is None:
            return keep_from
        lo = round((at - EPOCH) / timedelta(microseconds=1))
        inside = live.filter(time_bounds(live, "timestamp", at, from_micros(lo + width)))
        bucket = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(finer)).cast("long")
        rows = inside.groupBy(bucket.alias("k")).agg(F.sum(rb).alias("bytes")).collect()
        buckets = [{"b": from_micros(r["k"] * finer), "bytes": r["bytes"]} for r in rows]
        at, width = boundary(sorted(buckets, key=lambda r: r["b"], reverse=True)), finer
    # `at` is the instant that no longer fits
    return at if at is not None and (rule == "reach" or keep_from is None) else keep_from


def size_cutoff(df: DataFrame, max_bytes: int) -> DataFrame:
    """One-row frame `_keep_from`: the oldest time kept under a byte budget
    (NULL keeps none), by `budget_cutoff`."""
    cut = budget_cutoff(df, max_bytes, "fit")
    value = F.lit(None).cast("timestamp_ntz") if cut is None else ts_literal_like(df, "timestamp", cut).cast("timestamp_ntz")
    return df.sparkSession.range(1).select(value.alias("_keep_from"))


def retain_by_size(df: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Delete the oldest rows, instant by instant, until the table's bytes fit max_bytes.
    The cutoff is a literal, so the kept rows are a pushed-down time filter."""
    cut = budget_cutoff(df, max_bytes, "fit")
    keep = F.lit(False) if cut is None else F.col("timestamp") >= ts_literal_like(df, "timestamp", cut)
    kept = df.filter(keep if cut is None else time_bounds(df, "timestamp", cut, None))
    return kept, df.agg(F.count_if(~keep | F.col("timestamp").isNull()).alias("deleted"))


def retention_report(
    logs: DataFrame,
    procs: DataFrame,
    now: datetime,
    log_retention_days: int = 30,
    log_max_bytes: int | None = None,
    process_retention_days: int = 7,
    process_max_bytes: int | None = None,
) -> DataFrame:
    """The four deletion counters and their total, as one row.

    Age first, then size on what age left, per table, as the retention run does.
    """
    log_kept, log_age = retain_by_age(logs, now, log_retention_days)
    proc_kept, proc_age = retain_by_age(procs, now, process_retention_days)
    spark = logs.sparkSession
    zero = spark.range(1).select(F.lit(0).cast("long").alias("deleted"))
    log_size = retain_by_size(log_kept, log_max_bytes)[1] if log_max_bytes is not None else zero
    proc_size = retain_by_size(proc_kept, process_max_bytes)[1] if process_max_bytes is not None else zero
    out = (
        log_age.select(F.col("deleted").alias("logs_deleted_by_time"))
        .crossJoin(F.broadcast(log_size.select(F.col("deleted").alias("logs_deleted_by_size"))))
        .crossJoin(F.broadcast(proc_age.select(F.col("deleted").alias("processes_deleted_by_time"))))
        .crossJoin(F.broadcast(proc_size.select(F.col("deleted").alias("processes_deleted_by_size"))))
    )
    return out.withColumn(
        "total_deleted",
        F.col("logs_deleted_by_time") + F.col("logs_deleted_by_size")
        + F.col("processes_deleted_by_time") + F.col("processes_deleted_by_size"),
    )


# Table jobs on stored (date-partitioned) tables ------------------------------------


def _read_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*files)


def _date_counts(scope: DataFrame, keep: Column) -> list:
    """Rows kept and removed per date: one aggregate, one row per date."""
    return scope.groupBy("date").agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("gone")
    ).collect()


def _exchange(spark: SparkSession, path: str, dates: list[str] | None, plan: Callable[[list[str]], tuple[list[str], DataFrame | None, int]], exact: bool = False) -> int:
    """Exchange files of some dates (None: all) for others, against any number of other jobs.

    plan(files now stored) -> (the files to replace, the rows that replace them, the result).  The plan
    is made anew whenever another job has replaced one of its files meanwhile; `exact`: or added any file
    to the dates; then the result is the number of rows staged."""
    wait = 0.05
    for _ in range(ATTEMPTS):
        table, name = TableFiles(spark, path), uuid.uuid4().hex[:12]
        table.recover()
        files = table.files(dates=dates)
        stage = table.stage(name)
        try:
            old, rows, result = plan(files)
            if rows is not None:
                (rows if "date" in rows.columns else with_date(rows)).write.partitionBy("date").parquet(stage)
                if exact:
                    result = spark.read.schema("timestamp timestamp_ntz").parquet(stage).count()
                    if not result:
                        table.call_off(name)
                        return 0
        except Exception:
            table.call_off(name)
            if table.all_there(files):
                raise
            continue  # a file went while it was read
        if not old and rows is None:
            return result
        touched = sorted({date_of(p) for p in old}) if not exact else dates
        if table.claim(name, touched) and (table.files(dates=dates) == files if exact else table.all_there(old)) and table.note(name, old) is not False:
            table.finish(name)  # the new files enter the ledger when it is next asked
            return result
        table.call_off(name)
        time.sleep(wait * random.random())
        wait = min(2 * wait, LONGEST_WAIT)
    raise RuntimeError(f"other jobs kept replacing the same files of {path}")


def rewrite_dates(spark: SparkSession, path: str, keep: Column | Callable[[DataFrame], Column], dates: list | None = None,
                  files_per_date: int | None = None, whole: Callable[[str], bool] | None = None) -> int:
    """Keep only rows matching `keep` (a condition, or what makes one of the rows) in the given dates (all when None).

    Dates with nothing to remove are not written, a date that keeps nothing loses its
    files; dates that `whole` names go unread, counted by the ledger.  Returns the number of rows
    removed; rows appended meanwhile stay.
    """
    def plan(files: list[str]) -> tuple[list[str], DataFrame | None, int]:
        dropped = [p for p in files if whole is not None and whole(date_of(p))]
        removed = Ledger(spark, path).rows_of(dropped) if dropped else 0
        read = [p for p in files if p not in set(dropped)]
        kept, changed = None, set()
        if read:
            scope = _read_files(spark, path, read)
            stays = keep(scope) if callable(keep) and not isinstance(keep, Column) else keep
            per_date = _date_counts(scope, stays)
            removed += sum(r["gone"] for r in per_date)
            changed = {f"date={r['date']}" for r in per_date if r["gone"] > 0}
            touched = [str(r["date"]) for r in per_date if r["gone"] > 0 and r["kept"] > 0]
            if touched:
                kept = scope.filter(F.col("date").isin(touched)).filter(stays)
                kept = _per_date_buckets(kept, files_per_date)[0] if files_per_date else _time_ordered(kept)
        return dropped + [p for p in read if p.rsplit("/", 2)[1] in changed], kept, removed

    return _exchange(spark, path, None if dates is None else [str(d) for d in dates], plan)


def _per_date_buckets(df: DataFrame, files_per_date: int) -> tuple[DataFrame, int]:
    """(rows dealt to a task for each file, their number): `files_per_date` files a date, and as many more as
    keep each to about `FILE_BYTES` of rows, so that a task's memory does not grow with a date.
    Rows are dealt by their values; no two files share a task."""
    k = max(1, int(files_per_date))
    dates = df.groupBy("date").agg(F.count("*").alias("rows"), _memory(df).alias("size")).collect()  # a row a date
    files, first = [], 0
    for r in dates:
        files.append((r["date"], first, n := max(k, -(-r["size"] // FILE_BYTES))))
        first += n
    if not files:
        return df, 0
    date = df.schema["date"].dataType.simpleString()
    dealt = F.broadcast(df.sparkSession.createDataFrame(files, f"__date {date}, __first int, __files int"))
    file = F.col("__first") + F.when(F.col("__files") > 1, F.pmod(_by_value(df), F.col("__files"))).otherwise(0)
    rows = df.join(dealt, F.col("date").eqNullSafe(F.col("__date"))).repartitionById(first, file.cast("int")).select(*[F.col(f"`{c}`") for c in df.columns])
    return _time_ordered(rows), sum(r["rows"] for r in dates)


def compact(spark: SparkSession, path: str, dates: list, files_per_date: int = 1) -> int:
    """C11: rewrite the given dates into about `files_per_date` time-ordered files each, more for
    dates above `FILE_BYTES`; returns rows rewritten.  Rows appended meanwhile keep their own files."""
    def plan(files: list[str]) -> tuple[list[str], DataFrame | None, int]:
        if not files:
            return [], None, 0
        return files, *_per_date_buckets(_read_files(spark, path, files), files_per_date)

    return _exchange(spark, path, [str(d) for d in dates], plan)


def delete_before(spark: SparkSession, path: str, cutoff: datetime) -> int:
    """Delete stored rows with timestamp < cutoff.  Dates come from the folders' names:
    older ones are counted by the ledger and dropped, only the cutoff's date is read and rewritten."""
    day = cutoff.date().isoformat()
    dates = [d for d in TableFiles(spark, path).dates() if d <= day]
    if not dates:
        return 0
    keep = F.col("timestamp") >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
    return rewrite_dates(spark, path, keep, dates, whole=lambda d: d < day)


def apply_retention_by_age(spark: SparkSession, path: str, now: datetime, days: int) -> int:
    """C7 on a stored table; returns rows deleted."""
    return delete_before(spark, path, now - timedelta(days=int(days)))


def stored_size_cutoff(table: DataFrame, max_bytes: int) -> datetime | None:
    """Oldest time kept under a byte budget on a date-partitioned table: `budget_cutoff`,
    which walks its dates newest first, at most MOST_DATES a job."""
    return budget_cutoff(table, max_bytes, "fit")


def stored_cutoff(spark: SparkSession, path: str, max_bytes: int, rule: str = "fit") -> datetime | None:
    """The same from the ledger's totals: only the date where the budget runs out is scanned."""
    for attempt in range(ATTEMPTS):
        files = TableFiles(spark, path).files()
        try:
            days = Ledger(spark, path).by_date().where("date is not null").select(F.col("date").cast("timestamp_ntz").alias("b"), "bytes").collect()
            days.sort(key=lambda r: r["b"], reverse=True)
            newest = [p for p in files if days and date_of(p) == days[0]["b"].date().isoformat()]
            if not newest:
                return None
            schema = _read_files(spark, path, newest[:1]).schema  # no older footer is opened for it
            return budget_cutoff(spark.read.schema(schema).parquet(path), max_bytes, rule, days)
        except Exception:  # a file of the boundary date was replaced while it was read
            if attempt + 1 == ATTEMPTS or TableFiles(spark, path).all_there(files):
                raise
    return None


def apply_retention_by_size(spark: SparkSession, path: str, max_bytes: int) -> int:
    """C8 on a stored table: the cutoff from `stored_cutoff`, then whole older
    dates are dropped and the cutoff's date is rewritten."""
    if not TableFiles(spark, path).files():
        return 0
    cut = stored_cutoff(spark, path, max_bytes)
    if cut is None:
        return rewrite_dates(spark, path, F.lit(False), whole=lambda d: True)
    return delete_before(spark, path, cut)


def apply_delete_minute(spark: SparkSession, path: str, minute: datetime) -> int:
    """C5 on a stored table: only the minute's date is rewritten."""
    return rewrite_dates(spark, path, lambda rows: ~minute_equals(rows, minute), [minute.date()])


def clear_table(spark: SparkSession, path: str) -> None:
    """C6 on a stored table: the files it has now are removed; read it by its declared schema."""
    _exchange(spark, path, None, lambda files: (files, None, 0))


def run_retention(
    spark: SparkSession,
    logs_path: str,
    procs_path: str,
    now: datetime,
    log_retention_days: int = 30,
    log_max_bytes: int | None = None,
    process_retention_days: int = 7,
    process_max_bytes: int | None = None,
) -> DataFrame:
    """K5: one scheduled retention run over both stored tables (age, then size),
    returning the four counters and their total as one row."""
    a = apply_retention_by_age(spark, logs_path, now, log_retention_days)
    b = apply_retention_by_size(spark, logs_path, log_max_bytes) if log_max_bytes is not None else 0
    c = apply_retention_by_age(spark, procs_path, now, process_retention_days)
    d = apply_retention_by_size(spark, procs_path, process_max_bytes) if process_max_bytes is not None else 0
    return spark.createDataFrame(
        [(a, b, c, d, a + b + c + d)],
        "logs_deleted_by_time long, logs_deleted_by_size long, processes_deleted_by_time long, "
        "processes_deleted_by_size long, total_deleted long",
    )

"""Counts, minutes, buffer and storage statistics, filter values, column profile
(E5, G2-G11, G14, I4, I5, I8, I9).

Every statistic is a single aggregate pass with map-side partial aggregation;
one-row results are combined by broadcast cross joins of one-row frames (a
proven size bound of one row).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import PRIORITY_LABELS, priority_label, row_bytes
from logtide.operators.predicates import minute_equals
from logtide.schemas import DEFAULT_COLUMNS, EXCLUDED_COLUMNS
from logtide.sources.files import TableFiles
from logtide.sources.ledger import Filled, Ledger, Values
from logtide.sources.tables import read_logs

GIB = 1024.0**3

# --- fixed values: retention defaults and storage status limits -------------
LOG_RETENTION_DAYS = 30
LOG_MAX_SIZE_GB = 1.0
PROCESS_RETENTION_DAYS = 7
PROCESS_MAX_SIZE_GB = 0.5
WARNING_PERCENT = 75.0
CRITICAL_PERCENT = 90.0
# --- end fixed values --------------------------------------------------------


def count_entries(df: DataFrame) -> DataFrame:
    """G3."""
    return df.agg(F.count(F.lit(1)).alias("total_entries"))


def count_by_minute(df: DataFrame, minute: datetime) -> DataFrame:
    """Rows of one minute (the time range prunes files)."""
    return df.filter(minute_equals(df, minute)).agg(F.count(F.lit(1)).alias("count"))


def minute_counts(df: DataFrame) -> DataFrame:
    """G4 for every minute at once: rows per minute key (partial aggregate)."""
    return df.groupBy("minute_key").agg(F.count(F.lit(1)).alias("count"))


def distinct_minutes(df: DataFrame) -> DataFrame:
    """The distinct minute keys (partial distinct per task, then one shuffle)."""
    return df.select("minute_key").distinct()


def minute_bounds(df: DataFrame) -> DataFrame:
    """Oldest and newest minute key; NULL on an empty table."""
    return df.agg(F.min("minute_key").alias("oldest_minute"), F.max("minute_key").alias("newest_minute"))


def buffer_stats(df: DataFrame) -> DataFrame:
    """Total rows, distinct minutes, oldest and newest minute in one pass.

    Distinct minutes are counted exactly: minute keys are few (bounded by the
    time span), and the partial aggregate dedups them per task before the shuffle.
    """
    return df.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_distinct("minute_key").alias("buffered_minutes"),
        F.min("minute_key").alias("oldest_minute"),
        F.max("minute_key").alias("newest_minute"),
    )


def status(df: DataFrame) -> DataFrame:
    """Buffer statistics plus the stored byte total (sum of row sizes), one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_distinct("minute_key").alias("buffered_minutes"),
        F.min("minute_key").alias("oldest_minute"),
        F.max("minute_key").alias("newest_minute"),
        F.coalesce(F.sum(row_bytes(df, exclude=("date",))), F.lit(0)).cast("long").alias("stored_bytes"),
    )


def _log_side(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("journal_log_count"),
        F.min("timestamp").alias("oldest_log_timestamp"),
        F.max("timestamp").alias("newest_log_timestamp"),
        F.coalesce(F.sum(row_bytes(logs, exclude=("date",))), F.lit(0)).cast("long").alias("_log_bytes"),
    )


def _proc_side(procs: DataFrame) -> DataFrame:
    return procs.agg(
        F.count(F.lit(1)).alias("process_metric_count"),
        F.coalesce(F.sum(row_bytes(procs, exclude=("date",))), F.lit(0)).cast("long").alias("_proc_bytes"),
    )


def storage_stats(logs: DataFrame, procs: DataFrame) -> DataFrame:
    """Both row counts, oldest and newest log timestamp (one pass per table)."""
    return _log_side(logs).crossJoin(F.broadcast(_proc_side(procs))).select(
        "journal_log_count", "process_metric_count", "oldest_log_timestamp", "newest_log_timestamp"
    )


def storage_health(
    logs: DataFrame,
    procs: DataFrame,
    database_size_bytes: int | None = None,
    log_retention_days: int = LOG_RETENTION_DAYS,
    log_max_size_gb: float = LOG_MAX_SIZE_GB,
    process_retention_days: int = PROCESS_RETENTION_DAYS,
    process_max_size_gb: float = PROCESS_MAX_SIZE_GB,
) -> DataFrame:
    """Storage statistics, use percent and good / warning / critical.

    The size is rounded to 2 decimals of GiB before the percentage, as the
    status page does.  Without a given size, the stored row bytes of both
    tables are used; counts, bounds and bytes come from one pass per table.
    """
    both = _log_side(logs).crossJoin(F.broadcast(_proc_side(procs)))
    return _health(both, database_size_bytes, log_retention_days, log_max_size_gb, process_retention_days, process_max_size_gb)


def _health(both: DataFrame, database_size_bytes: int | None, log_retention_days: int, log_max_size_gb: float,
            process_retention_days: int, process_max_size_gb: float) -> DataFrame:
    """The health row from one row with counts, bounds and row bytes of both tables."""
    if database_size_bytes is None:
        size = (F.col("_log_bytes") + F.col("_proc_bytes")).cast("long")
    else:
        size = F.lit(int(database_size_bytes)).cast("long")
    max_gb = max(log_max_size_gb, process_max_size_gb)
    size_gb = F.round(F.col("database_size_bytes") / F.lit(GIB), 2)
    pct = size_gb / F.lit(float(max_gb)) * 100.0
    return (
        both.withColumn("database_size_bytes", size)
        .withColumn("size_gb", size_gb)
        .withColumn("usage_percent", pct)
        .withColumn(
            "status",
            F.when(F.col("usage_percent") >= CRITICAL_PERCENT, "critical")
            .when(F.col("usage_percent") >= WARNING_PERCENT, "warning")
            .otherwise("good"),
        )
        .withColumn("log_retention_days", F.lit(int(log_retention_days)))
        .withColumn("log_max_size_gb", F.lit(float(log_max_size_gb)))
        .withColumn("process_retention_days", F.lit(int(process_retention_days)))
        .withColumn("process_max_size_gb", F.lit(float(process_max_size_gb)))
        .select("journal_log_count", "process_metric_count", "oldest_log_timestamp", "newest_log_timestamp",
                "database_size_bytes", "size_gb", "usage_percent", "status", "log_retention_days",
                "log_max_size_gb", "process_retention_days", "process_max_size_gb")
    )


def stored_health(spark, logs_path: str, procs_path: str, size: str = "files", log_retention_days: int = LOG_RETENTION_DAYS, log_max_size_gb: float = LOG_MAX_SIZE_GB,
                  process_retention_days: int = PROCESS_RETENTION_DAYS, process_max_size_gb: float = PROCESS_MAX_SIZE_GB) -> DataFrame:
    """G14 / I8 of two stored tables from their ledgers: no stored date is scanned.

    The size is that of the files ("files") or of the row values ("rows")."""
    logs = Ledger(spark, logs_path).totals().select(
        F.col("rows").alias("journal_log_count"), F.col("first").alias("oldest_log_timestamp"), F.col("last").alias("newest_log_timestamp"), F.col("bytes").alias("_log_bytes"))
    procs = Ledger(spark, procs_path).totals().select(F.col("rows").alias("process_metric_count"), F.col("bytes").alias("_proc_bytes"))
    stored = sum(TableFiles(spark, p).stored_bytes() for p in (logs_path, procs_path)) if size == "files" else None
    return _health(logs.crossJoin(F.broadcast(procs)), stored, log_retention_days, log_max_size_gb, process_retention_days, process_max_size_gb)


def stored_status(spark, logs_path: str, size: str = "files") -> DataFrame:
    """I9 of a stored table: rows and size from the ledger and the listing; only minute keys are scanned."""
    ledger = Ledger(spark, logs_path).totals()
    stored = F.lit(TableFiles(spark, logs_path).stored_bytes()) if size == "files" else F.col("bytes")
    minutes = read_logs(spark, logs_path).agg(
        F.count_distinct("minute_key").alias("buffered_minutes"), F.min("minute_key").alias("oldest_minute"), F.max("minute_key").alias("newest_minute"))
    return ledger.select(F.col("rows").alias("total_entries"), stored.cast("long").alias("stored_bytes")).crossJoin(F.broadcast(minutes)).select(
        "total_entries", "buffered_minutes", "oldest_minute", "newest_minute", "stored_bytes")


def stored_filters(spark, logs_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G9 / G10 / I4 of a stored table from its dictionaries: hosts, units and severity counts, as `filters`
    gives them, without a scan of the rows of files that were asked before."""
    values = Values(spark, logs_path)
    hosts, units = (values.counts(c).where("value is not null").select("value").orderBy("value") for c in ("_HOSTNAME", "_SYSTEMD_UNIT"))
    counts = values.counts("priority").select(F.col("value").cast("int").alias("priority"), F.col("rows").alias("_n"))
    return hosts, units, _severities(counts)


def filter_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values (hosts or units)."""
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")


def severity_counts(df: DataFrame) -> DataFrame:
    """The eight levels with `p - label` and their row counts, zero where none.

    The eight-row dimension is generated; the per-priority counts are a partial
    aggregate over priorities 0..7 (at most eight rows, a proven bound), so they
    are the broadcast side of the left join.
    """
    counts = df.filter(F.col("priority").between(0, 7)).groupBy("priority").agg(F.count(F.lit(1)).alias("_n"))
    return _severities(counts)


def _severities(counts: DataFrame) -> DataFrame:
    """The eight levels with the rows that `counts` (priority, _n) has of them."""
    value = F.col("id").cast("int")
    levels = counts.sparkSession.range(len(PRIORITY_LABELS)).select(
        value.alias("value"), F.concat(value.cast("string"), F.lit(" - "), priority_label(value)).alias("label")
    )
    counts = counts.filter(F.col("priority").between(0, 7)).select(F.col("priority").alias("value"), F.col("_n").alias("count"))
    return (
        levels.join(F.broadcast(counts), "value", "left")
        .select("value", "label", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
        .orderBy("value")
    )


def filters(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I4: host values, unit values and the severity catalogue (with counts)."""
    return filter_values(df, "_HOSTNAME"), filter_values(df, "_SYSTEMD_UNIT"), severity_counts(df)


def column_profile(df: DataFrame) -> DataFrame:
    """Name, type, default flag and non-null count per catalogue column.

    One aggregate of count(col) over all columns (a single pass), then `stack`
    to one row per column.
    """
    fields = [f for f in df.schema.fields if f.name not in EXCLUDED_COLUMNS and f.name != "date"]
    return _profile(df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)]), fields)


def _profile(counts: DataFrame, fields: list) -> DataFrame:
    """The catalogue from one row of counts c0, c1, ... in the order of the fields."""
    defaults = {c.lower() for c in DEFAULT_COLUMNS}
    parts = []
    for i, f in enumerate(fields):
        name = f.name.replace("'", "\\'")
        typ = f.dataType.simpleString().upper()
        parts.append(f"'{name}', '{typ}', {str(f.name.lower() in defaults).lower()}, {i}, c{i}")
    expr = f"stack({len(fields)}, {', '.join(parts)}) as (name, column_type, is_default, position, non_null)"
    return counts.selectExpr(expr)


def stored_column_profile(spark, logs_path: str) -> DataFrame:
    """E5 / I5 of a stored table from the filled counts of its files: no column of files asked before is read."""
    fields = [f for f in read_logs(spark, logs_path).schema.fields if f.name not in EXCLUDED_COLUMNS and f.name != "date"]
    own = Filled(spark, logs_path).refresh()
    sums = [F.coalesce(F.sum(F.when(F.col("name") == f.name, F.col("rows"))), F.lit(0)).alias(f"c{i}") for i, f in enumerate(fields)]
    return _profile(own.agg(*sums), fields)

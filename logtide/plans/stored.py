"""Registered queries over stored tables: the derived logs and samples are
appended to date-partitioned Parquet in the shared checkpoint folder (C1, C2),
read back with the declared schema (A10), and queried or maintained there, so
the correctness check covers partition pruning and the table jobs as well.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logtide.operators import maintenance, processes, search, stats
from logtide.plans.catalog import (
    DEFAULT_SELECT,
    HEALTH_SQL,
    NOW,
    PROFILE_SQL,
    STATUS_SQL,
    TS_DESC,
    _LATEST,
    _PARSED_CTE,
    _procs,
    _logs,
    _search_sql,
    _size_deleted,
    _ts,
    _where,
    register,
)
from logtide.plans.oracle import JOURNAL_CTE, PROCESS_CTE, SAMPLES_TYPED_CTE, row_bytes_sql, with_ctes
from logtide.schemas import JOURNAL_SCHEMA, PROCESS_SCHEMA
from logtide.session import checkpoint_dir
from logtide.sources import journal as J
from logtide.sources import samples as S
from logtide.sources import tables
from logtide.sources.ledger import Ledger
from logtide.streaming import jobs

_SAMPLE_FIELDS = ", ".join(f'"{f.name}"' for f in PROCESS_SCHEMA.fields)


def _store(spark: SparkSession, sf: str, kind: str) -> str:
    base = f"{checkpoint_dir(spark).rstrip('/')}/logtide-store-{uuid.uuid4().hex}"
    if kind in ("logs", "both"):
        maintenance.write_logs(_logs(spark, sf), f"{base}/logs")
    if kind in ("procs", "both"):
        maintenance.write_process_metrics(_procs(spark, sf), f"{base}/procs")
    return base


@register("stored_search", _search_sql(_where(NOW - timedelta(days=7), q="user"), TS_DESC, select=DEFAULT_SELECT))
def q_stored_search(spark, sf):
    base = _store(spark, sf, "logs")
    logs = tables.read_logs(spark, f"{base}/logs")
    return search.search(logs, NOW, start="-7d", q="user")


@register("stored_latest_processes", with_ctes(
    f"SELECT l.*, (SELECT COUNT(*) FROM ({_LATEST})) AS total FROM ({_LATEST}) l", PROCESS_CTE))
def q_stored_latest_processes(spark, sf):
    base = _store(spark, sf, "procs")
    stored = tables.read_process_metrics(spark, f"{base}/procs")
    snap = processes.latest_processes(stored)
    return snap.select(*[f.name for f in PROCESS_SCHEMA.fields], "total")


_PROC_MINUTE = (
    "proc_minute AS (SELECT \"timestamp\" AS minute, SUM({rb}) AS bytes FROM process_metrics "
    f"WHERE \"timestamp\" >= {_ts(NOW - timedelta(days=7))} GROUP BY 1)"
).format(rb=row_bytes_sql(PROCESS_SCHEMA))
_LOG_MINUTE = (
    "log_minute AS (SELECT \"timestamp\" AS minute, SUM({rb}) AS bytes FROM journal_logs "
    f"WHERE \"timestamp\" >= {_ts(NOW - timedelta(days=20))} GROUP BY 1)"
).format(rb=row_bytes_sql(JOURNAL_SCHEMA))


@register("stored_retention_run", with_ctes(
    "SELECT a AS logs_deleted_by_time, b AS logs_deleted_by_size, c AS processes_deleted_by_time, "
    "d AS processes_deleted_by_size, a + b + c + d AS total_deleted, "
    f'(SELECT COUNT(*) FROM journal_logs) - a - b AS logs_left, (SELECT COUNT(*) FROM process_metrics) - c - d AS processes_left FROM (SELECT '
    f'(SELECT COUNT(*) FROM journal_logs WHERE "timestamp" < {_ts(NOW - timedelta(days=20))}) AS a, '
    f"{_size_deleted('journal_logs', 'log_minute', 20, 1_000_000)} AS b, "
    f'(SELECT COUNT(*) FROM process_metrics WHERE "timestamp" < {_ts(NOW - timedelta(days=7))}) AS c, '
    f"{_size_deleted('process_metrics', 'proc_minute', 7, 20_000)} AS d)",
    JOURNAL_CTE, PROCESS_CTE, _PROC_MINUTE, _LOG_MINUTE))
def q_stored_retention_run(spark, sf):
    """K5: the scheduled retention run on stored copies of both tables."""
    base = _store(spark, sf, "both")
    report = maintenance.run_retention(
        spark, f"{base}/logs", f"{base}/procs", NOW, log_retention_days=20, log_max_bytes=1_000_000,
        process_retention_days=7, process_max_bytes=20_000,
    )
    logs_left = tables.read_logs(spark, f"{base}/logs").count()
    procs_left = tables.read_process_metrics(spark, f"{base}/procs").count()
    return report.select(
        "logs_deleted_by_time", "logs_deleted_by_size", "processes_deleted_by_time", "processes_deleted_by_size",
        "total_deleted", F.lit(logs_left).cast("long").alias("logs_left"),
        F.lit(procs_left).cast("long").alias("processes_left"),
    )


@register("stored_compaction", with_ctes(
    'SELECT CAST("timestamp" AS DATE) AS date, COUNT(*) AS rows, MIN("timestamp") AS first_ts, '
    'MAX("timestamp") AS last_ts FROM journal_logs GROUP BY 1', JOURNAL_CTE))
def q_stored_compaction(spark, sf):
    """C11: every date rewritten into one time-ordered file (a very large one into several); rows per date unchanged."""
    base = _store(spark, sf, "logs")
    path = f"{base}/logs"
    dates = [r["date"] for r in tables.read_logs(spark, path).select("date").distinct().collect()]
    maintenance.compact(spark, path, dates, files_per_date=1)
    return tables.read_logs(spark, path).groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


_FIRST_MINUTE = "(SELECT MIN(minute_key) FROM journal_logs)"


@register("stored_delete_minute", with_ctes(
    f"SELECT (SELECT COUNT(*) FROM journal_logs WHERE minute_key = {_FIRST_MINUTE}) AS deleted, "
    f"(SELECT COUNT(*) FROM journal_logs WHERE minute_key <> {_FIRST_MINUTE}) AS left_rows", JOURNAL_CTE))
def q_stored_delete_minute(spark, sf):
    """C5 on a stored table: delete the oldest minute, only its date is rewritten."""
    base = _store(spark, sf, "logs")
    path = f"{base}/logs"
    first = tables.read_logs(spark, path).agg(F.min("minute_key")).first()[0]
    deleted = maintenance.apply_delete_minute(spark, path, datetime.strptime(first[:16], "%Y-%m-%dT%H:%M"))
    left = tables.read_logs(spark, path).count()
    return spark.range(1).select(F.lit(deleted).cast("long").alias("deleted"),
                                 F.lit(left).cast("long").alias("left_rows"))


@register("stored_clear", with_ctes(
    "SELECT COUNT(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM journal_logs", JOURNAL_CTE))
def q_stored_clear(spark, sf):
    """C6 on a stored table: every row removed, the table still readable."""
    base = _store(spark, sf, "logs")
    path = f"{base}/logs"
    before = tables.read_logs(spark, path).count()
    maintenance.clear_table(spark, path)
    after = tables.read_logs(spark, path).count()
    return spark.range(1).select(F.lit(before).cast("long").alias("rows_before"),
                                 F.lit(after).cast("long").alias("rows_after"))


@register("read_journal_files", with_ctes(
    'SELECT "timestamp", __CURSOR, message, priority, extra_fields FROM parsed', _PARSED_CTE))
def q_read_journal_files(spark, sf):
    """A1 as a batch: exported journal files, read and typed."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/logtide-journal-{uuid.uuid4().hex}"
    tables.raw_journal_lines(spark, sf).write.text(path)
    return J.read_journal_typed(spark, path, NOW).select("timestamp", "__CURSOR", "message", "priority", "extra_fields")


@register("read_sample_files", with_ctes("SELECT " + _SAMPLE_FIELDS + " FROM samples_typed", SAMPLES_TYPED_CTE))
def q_read_sample_files(spark, sf):
    """A9 as a batch: sample files, read and typed."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/logtide-samples-{uuid.uuid4().hex}"
    tables.raw_samples(spark, sf).drop("seq").write.json(path)
    return processes.to_process_metrics(S.read_process_samples(spark, path))


_BY_DATE = (
    'CAST("timestamp" AS DATE) AS date, COUNT(*) AS rows, MIN("timestamp") AS first_ts, MAX("timestamp") AS last_ts'
)


def _by_date(df):
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@register("stored_concurrent_jobs", with_ctes(
    f'SELECT {_BY_DATE} FROM journal_logs WHERE "timestamp" >= {_ts(NOW - timedelta(days=25))} '
    f"AND NOT (\"timestamp\" >= {_ts(datetime(2024, 1, 20, 12))} AND \"timestamp\" < {_ts(datetime(2024, 1, 20, 12, 1))}) GROUP BY 1", JOURNAL_CTE))
def q_stored_concurrent_jobs(spark, sf):
    """C5, C7, C11 at once: two compactions, age retention and a minute's deletion on the same dates;
    whichever loses a date starts again, and no row is doubled or lost."""
    path = f"{_store(spark, sf, 'logs')}/logs"
    dates = [f"2024-01-{d:02d}" for d in (6, 20, 21)]
    todo = [lambda: maintenance.compact(spark, path, dates), lambda: maintenance.compact(spark, path, dates, 2),
            lambda: maintenance.apply_retention_by_age(spark, path, NOW, 25),
            lambda: maintenance.apply_delete_minute(spark, path, datetime(2024, 1, 20, 12))]
    with ThreadPoolExecutor(len(todo)) as pool:
        for job in [pool.submit(f) for f in todo]:
            job.result()
    return _by_date(tables.read_logs(spark, path))


@register("stored_replayed_epochs", with_ctes(
    f'SELECT {_BY_DATE} FROM journal_logs WHERE "timestamp" >= {_ts(NOW - timedelta(days=20))} GROUP BY 1', JOURNAL_CTE))
def q_stored_replayed_epochs(spark, sf):
    """Two epochs of a stream, compacted and cut by retention, then replayed: nothing comes twice or back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/logtide-epochs-{uuid.uuid4().hex}"
    logs = _logs(spark, sf)
    halves = [logs.where(F.col("__SEQNUM") % 2 == i) for i in (0, 1)]
    run = jobs._append_once(maintenance.write_logs, path, f"{path}-checkpoint")
    for epoch, rows in enumerate(halves):
        run(rows, epoch)
    maintenance.compact(spark, path, [f"2024-01-{d:02d}" for d in range(1, 32)])
    maintenance.apply_retention_by_age(spark, path, NOW, 20)
    for epoch, rows in enumerate(halves):
        run(rows, epoch)
    return _by_date(tables.read_logs(spark, path))


@register("stored_append_twice", with_ctes("SELECT " + _SAMPLE_FIELDS + " FROM process_metrics", PROCESS_CTE))
def q_stored_append_twice(spark, sf):
    """A third of the samples, all of them, and all again: every (timestamp, pid) is stored once."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/logtide-append-{uuid.uuid4().hex}"
    procs = _procs(spark, sf)
    for batch in (procs.where(F.col("pid") % 3 == 0), procs, procs):
        maintenance.write_process_metrics(batch, path)
    return tables.read_process_metrics(spark, path).select(*[f.name for f in PROCESS_SCHEMA.fields])


@register("stored_ledger", with_ctes(
    f'SELECT {_BY_DATE}, CAST(SUM({row_bytes_sql(JOURNAL_SCHEMA)}) AS BIGINT) AS bytes FROM journal_logs '
    f'WHERE "timestamp" >= {_ts(NOW - timedelta(days=15))} GROUP BY 1', JOURNAL_CTE))
def q_stored_ledger(spark, sf):
    """The date ledger after appends, compaction and retention: what a scan of the table would say."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/logtide-ledger-{uuid.uuid4().hex}"
    logs = _logs(spark, sf)
    for i in (0, 1):
        maintenance.write_logs(logs.where(F.col("__SEQNUM") % 2 == i), path)
    maintenance.compact(spark, path, ["2024-01-16", "2024-01-20"])
    maintenance.apply_retention_by_age(spark, path, NOW, 15)
    return Ledger(spark, path).by_date().select("date", "rows", F.col("first").alias("first_ts"), F.col("last").alias("last_ts"), F.col("bytes").cast("long").alias("bytes"))


@register("stored_health", with_ctes(HEALTH_SQL, JOURNAL_CTE, PROCESS_CTE))
def q_stored_health(spark, sf):
    """G14 / I8 of stored tables, from their ledgers."""
    base = _store(spark, sf, "both")
    return stats.stored_health(spark, f"{base}/logs", f"{base}/procs", size="rows")


@register("stored_status", with_ctes(STATUS_SQL, JOURNAL_CTE))
def q_stored_status(spark, sf):
    """I9 of a stored table: size and rows from its ledger."""
    return stats.stored_status(spark, f"{_store(spark, sf, 'logs')}/logs", size="rows")


_FILTERS = (
    "SELECT 'host' AS kind, _HOSTNAME AS value, CAST(NULL AS BIGINT) AS count FROM journal_logs WHERE _HOSTNAME IS NOT NULL AND {keep} GROUP BY 2 "
    "UNION ALL SELECT 'unit', _SYSTEMD_UNIT, NULL FROM journal_logs WHERE _SYSTEMD_UNIT IS NOT NULL AND {keep} GROUP BY 2 "
    "UNION ALL SELECT 'severity', CAST(v AS VARCHAR), (SELECT COUNT(*) FROM journal_logs WHERE priority = v AND {keep}) FROM range(8) r(v)"
).format(keep=f'"timestamp" >= {_ts(NOW - timedelta(days=15))}')


@register("stored_filters", with_ctes(_FILTERS, JOURNAL_CTE))
def q_stored_filters(spark, sf):
    """G9 / G10 / I4 from the dictionaries of a stored table, asked before and after rewrites."""
    path = f"{_store(spark, sf, 'logs')}/logs"
    stats.stored_filters(spark, path)[0].count()
    maintenance.compact(spark, path, ["2024-01-16", "2024-01-20"])
    maintenance.apply_retention_by_age(spark, path, NOW, 15)
    hosts, units, severities = stats.stored_filters(spark, path)
    none = F.lit(None).cast("long").alias("count")
    return hosts.select(F.lit("host").alias("kind"), "value", none).unionByName(units.select(F.lit("unit").alias("kind"), "value", none)).unionByName(
        severities.select(F.lit("severity").alias("kind"), F.col("value").cast("string").alias("value"), "count"))


@register("stored_column_profile", PROFILE_SQL)
def q_stored_column_profile(spark, sf):
    """E5 / I5 from the filled counts of a stored table."""
    return stats.stored_column_profile(spark, f"{_store(spark, sf, 'logs')}/logs")


@register("stored_text_search", _search_sql(_where(NOW - timedelta(days=30), q="USER_17"), TS_DESC, select=DEFAULT_SELECT))
def q_stored_text_search(spark, sf):
    """A text search that reads only files whose trigrams allow it."""
    path = f"{_store(spark, sf, 'logs')}/logs"
    return search.search(tables.read_logs_with_text(spark, path, "USER_17"), NOW, start="-30d", q="USER_17")

"""Registered queries: one per operator of the inventory, each paired (where SQL
can express it) with DuckDB SQL computing the same answer on the same tables.

Every query reads `events` (or tables Spark derives from it) in full; a fixed
`now` keeps answers repeatable.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions import columns as C
from logtide.functions.text import escape_like
from logtide.operators import charts, ingest, maintenance, processes, search, stats
from logtide.plans.oracle import (
    JOURNAL_CTE,
    LEVEL_SQL,
    PROCESS_CTE,
    SAMPLES_TYPED_CTE,
    journal_select,
    row_bytes_sql,
    with_ctes,
)
from logtide.schemas import JOURNAL_SCHEMA, PROCESS_SCHEMA, PROCESS_SCHEMA_V1
from logtide.session import ensure_utc
from logtide.sources import journal as J
from logtide.sources import tables

NOW = datetime(2024, 1, 31)
MINUTE = datetime(2024, 1, 1, 0, 0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    ensure_utc(spark)
    return tables.journal_logs(spark, sf)


def _procs(spark: SparkSession, sf: str) -> DataFrame:
    ensure_utc(spark)
    return tables.process_metrics(spark, sf)


def _ts(dt: datetime) -> str:
    return f"TIMESTAMP '{dt.strftime('%Y-%m-%d %H:%M:%S')}'"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _where(start: datetime, end: datetime = NOW, q=None, hosts=None, units=None, prio=None) -> str:
    w = [f'"timestamp" >= {_ts(start)}', f'"timestamp" < {_ts(end)}']
    if q:
        w.append(f"message ILIKE {_lit('%' + escape_like(q) + '%')} ESCAPE '\\'")
    if hosts:
        w.append("_HOSTNAME IN (" + ",".join(_lit(h) for h in hosts.split(",")) + ")")
    if units:
        w.append("_SYSTEMD_UNIT IN (" + ",".join(_lit(u) for u in units.split(",")) + ")")
    if prio is not None:
        w.append(f"priority <= {int(prio)}")
    return " AND ".join(w)


DEFAULT_SELECT = (
    'CAST("timestamp" AS VARCHAR) AS "timestamp", _HOSTNAME AS hostname, _SYSTEMD_UNIT AS unit, '
    "priority, CAST(_PID AS VARCHAR) AS pid, _COMM AS comm, message"
)


def _search_sql(where: str, order: str, limit: int = 1000, offset: int = 0, select: str = DEFAULT_SELECT) -> str:
    off = f" OFFSET {offset}" if offset else ""
    return with_ctes(f"SELECT {select} FROM journal_logs WHERE {where} ORDER BY {order} LIMIT {limit}{off}", JOURNAL_CTE)


TS_DESC = '"timestamp" DESC NULLS LAST, __CURSOR DESC NULLS LAST'

# --------------------------------------------------------------------------- I3


TIMECHART_SQL = """SELECT date_trunc('minute', "timestamp") AS time_bin, COALESCE(priority, 6) AS priority,
 {level} AS level, COUNT(*) AS count FROM journal_logs WHERE {where} GROUP BY 1, 2 ORDER BY 1, 2"""


@register("timechart", with_ctes(TIMECHART_SQL.format(level=LEVEL_SQL.format(p="COALESCE(priority, 6)"),
                                                     where=_where(NOW - timedelta(days=30))), JOURNAL_CTE))
def q_timechart(spark, sf):
    return charts.timechart(_logs(spark, sf), NOW, start="-30d")


@register("timechart_filtered", with_ctes(TIMECHART_SQL.format(
    level=LEVEL_SQL.format(p="COALESCE(priority, 6)"),
    where=_where(NOW - timedelta(days=14), NOW - timedelta(days=2), q="user", hosts="host-1,host-2,host-4",
                 prio=5)), JOURNAL_CTE))
def q_timechart_filtered(spark, sf):
    return charts.timechart(_logs(spark, sf), NOW, start="-14d", end="-2d", q="user",
                            hostname="host-1,host-2,host-4", priority=5)


_PIVOT_LEVELS = C.PRIORITY_LABELS
_PIVOT_CTE = """chart AS (SELECT date_trunc('minute', "timestamp") AS time_bin,
 CASE WHEN COALESCE(priority, 6) BETWEEN 0 AND 7 THEN COALESCE(priority, 6) ELSE 6 END AS lv, COUNT(*) AS n
 FROM journal_logs WHERE {where} GROUP BY 1, 2),
 pivoted AS (SELECT time_bin, {cols} FROM chart GROUP BY time_bin)""".format(
    where=_where(NOW - timedelta(days=7)),
    cols=", ".join(f'CAST(SUM(CASE WHEN lv = {i} THEN n ELSE 0 END) AS BIGINT) AS "{name}"'
                   for i, name in enumerate(_PIVOT_LEVELS)),
)


@register("timechart_pivot", with_ctes("SELECT * FROM pivoted ORDER BY time_bin", JOURNAL_CTE, _PIVOT_CTE))
def q_timechart_pivot(spark, sf):
    return charts.timechart_pivot(charts.timechart(_logs(spark, sf), NOW, start="-7d"))


_STACK_SQL = """, long AS ({unions}),
 stacked AS (SELECT time_bin, level_order, level, count,
   SUM(count) OVER (PARTITION BY time_bin ORDER BY level_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upper
   FROM long)
SELECT time_bin, level_order, level, count, CAST(upper - count AS BIGINT) AS lower, CAST(upper AS BIGINT) AS upper,
 (SELECT COALESCE(MAX({total}), 0) FROM pivoted) AS max_stack FROM stacked""".format(
    unions=" UNION ALL ".join(
        f"SELECT time_bin, {i} AS level_order, '{name}' AS level, \"{name}\" AS count FROM pivoted"
        for i, name in enumerate(_PIVOT_LEVELS)
    ),
    total=" + ".join(f'"{n}"' for n in _PIVOT_LEVELS),
)


@register("timechart_stacked", "WITH " + JOURNAL_CTE + ",\n" + _PIVOT_CTE + _STACK_SQL)
def q_timechart_stacked(spark, sf):
    pivot = charts.timechart_pivot(charts.timechart(_logs(spark, sf), NOW, start="-7d"))
    return charts.timechart_stacked(pivot)


# --------------------------------------------------------------------------- I1 / I2


@register("search_default", _search_sql(_where(NOW - timedelta(days=7)), TS_DESC))
def q_search_default(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-7d")


@register("search_text", _search_sql(_where(NOW - timedelta(days=30), q="100% OF"), TS_DESC))
def q_search_text(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-30d", q="100% OF")


@register("search_text_wildcards", _search_sql(_where(NOW - timedelta(days=30), q="of user_"), TS_DESC))
def q_search_text_wildcards(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-30d", q="of user_")


@register("search_backslash", _search_sql(_where(NOW - timedelta(days=30), q="PATH\\user 1"), TS_DESC))
def q_search_backslash(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-30d", q="PATH\\user 1")


@register("search_quote", _search_sql(_where(NOW - timedelta(days=30), q="it's USER-1"), TS_DESC))
def q_search_quote(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-30d", q="it's USER-1")


@register("search_hosts_units", _search_sql(
    _where(NOW - timedelta(days=30), hosts="host-1,host-3", units="error.service,view.service"),
    TS_DESC, select='CAST("timestamp" AS VARCHAR) AS "timestamp", _HOSTNAME AS hostname, '
                    '_SYSTEMD_UNIT AS unit, message, __CURSOR'))
def q_search_hosts_units(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-30d", hostname="host-1,host-3",
                         unit="error.service,view.service",
                         columns=" timestamp, _hostname ,_systemd_unit,message,__CURSOR,no_such_column")


@register("search_priority", _search_sql(
    _where(NOW - timedelta(days=30), prio=3),
    "priority ASC NULLS LAST, __CURSOR ASC NULLS LAST", limit=2000))
def q_search_priority(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-30d", priority=3, sort="PRI", sort_dir="asc", limit=2000)


@register("search_sorted_nulls", _search_sql(
    _where(NOW - timedelta(days=30)), "_HOSTNAME ASC NULLS LAST, __CURSOR ASC NULLS LAST", limit=3000,
    offset=500))
def q_search_sorted_nulls(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-30d", sort="host", sort_dir="ASC", limit=3000, offset=500)


@register("search_unit_desc", _search_sql(
    _where(NOW - timedelta(days=30)), "_SYSTEMD_UNIT DESC NULLS LAST, __CURSOR DESC NULLS LAST", limit=700))
def q_search_unit_desc(spark, sf):
    return search.search(_logs(spark, sf), NOW, start="-30d", sort="unit", sort_dir="sideways", limit=700)


@register("search_deep_page", _search_sql(_where(NOW - timedelta(days=30)), TS_DESC, limit=2000, offset=3000))
def q_search_deep_page(spark, sf):
    # A page past the top-k bound takes the distributed numbering route.
    return search.search(_logs(spark, sf), NOW, start="-30d", limit=2000, offset=3000, topk_max_rows=1000)


@register("search_total", with_ctes(
    f"SELECT COUNT(*) AS total FROM journal_logs WHERE {_where(NOW - timedelta(days=30), q='OF', hosts='host-2')}",
    JOURNAL_CTE))
def q_search_total(spark, sf):
    return search.search_total(_logs(spark, sf), NOW, start="-30d", q="OF", hostname="host-2")


@register("search_page", with_ctes(
    """SELECT total, CAST(500 AS BIGINT) AS "offset", LEAST(1000, GREATEST(total - 500, 0)) AS returned,
     CASE WHEN 500 + LEAST(1000, GREATEST(total - 500, 0)) < total THEN 500 + LEAST(1000, GREATEST(total - 500, 0)) END AS next_offset,
     CASE WHEN 500 + LEAST(1000, GREATEST(total - 500, 0)) < total THEN 'more' WHEN total = 0 THEN 'none' ELSE 'end' END AS state
     FROM (SELECT COUNT(*) AS total FROM journal_logs WHERE """ + _where(NOW - timedelta(days=30), q="user") + ")",
    JOURNAL_CTE))
def q_search_page(spark, sf):
    _, state = search.search_page(_logs(spark, sf), NOW, start="-30d", q="user", offset=500, limit=1000)
    return state


@register("search_page_rows", _search_sql(
    _where(NOW - timedelta(days=30), q="user"), TS_DESC, limit=1000, offset=500))
def q_search_page_rows(spark, sf):
    rows, _ = search.search_page(_logs(spark, sf), NOW, start="-30d", q="user", offset=500, limit=1000,
                                 columns="nothing,valid")
    return rows


@register("entries_for_minute", with_ctes(
    f"SELECT \"timestamp\", __CURSOR, message FROM journal_logs WHERE minute_key = "
    f"'{MINUTE.strftime('%Y-%m-%dT%H:%M:00+00:00')}' ORDER BY \"timestamp\", __CURSOR", JOURNAL_CTE))
def q_entries_for_minute(spark, sf):
    return search.entries_for_minute(_logs(spark, sf), MINUTE).select("timestamp", "__CURSOR", "message")


_BUSIEST = "(SELECT minute_key FROM journal_logs GROUP BY 1 ORDER BY COUNT(*) DESC, minute_key LIMIT 1)"


@register("entries_for_busiest_minute", with_ctes(
    'SELECT row_number() OVER (ORDER BY "timestamp", __CURSOR) - 1 AS place, "timestamp", __CURSOR, message FROM journal_logs '
    f"WHERE minute_key = {_BUSIEST}", JOURNAL_CTE))
def q_entries_for_busiest_minute(spark, sf):
    """F5 / D7 on a minute of several rows, in the order in which they come."""
    logs = _logs(spark, sf)
    top = logs.groupBy("minute_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "minute_key").first()["minute_key"]
    rows = search.entries_for_minute(logs, datetime.strptime(top[:16], "%Y-%m-%dT%H:%M"))
    return rows.coalesce(1).select(F.monotonically_increasing_id().alias("place"), "timestamp", "__CURSOR", "message")


@register("delete_busiest_minute", with_ctes(
    f"SELECT COUNT(*) FILTER (WHERE minute_key = {_BUSIEST}) AS deleted, COUNT(*) FILTER (WHERE minute_key <> {_BUSIEST}) AS kept, "
    f"(SELECT COUNT(*) FROM journal_logs WHERE minute_key = {_BUSIEST}) AS count FROM journal_logs", JOURNAL_CTE))
def q_delete_busiest_minute(spark, sf):
    """C5 and G4 on a minute of several rows."""
    logs = _logs(spark, sf)
    top = logs.groupBy("minute_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "minute_key").first()["minute_key"]
    minute = datetime.strptime(top[:16], "%Y-%m-%dT%H:%M")
    kept, deleted = maintenance.delete_minute(logs, minute)
    return deleted.crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept")))).crossJoin(F.broadcast(stats.count_by_minute(logs, minute)))


# --------------------------------------------------------------------------- I4, I5, stats


@register("filter_hosts", with_ctes(
    "SELECT DISTINCT _HOSTNAME AS value FROM journal_logs WHERE _HOSTNAME IS NOT NULL ORDER BY value", JOURNAL_CTE))
def q_filter_hosts(spark, sf):
    return stats.filter_values(_logs(spark, sf), "_HOSTNAME")


@register("filter_units", with_ctes(
    "SELECT DISTINCT _SYSTEMD_UNIT AS value FROM journal_logs WHERE _SYSTEMD_UNIT IS NOT NULL ORDER BY value",
    JOURNAL_CTE))
def q_filter_units(spark, sf):
    return stats.filter_values(_logs(spark, sf), "_SYSTEMD_UNIT")


@register("severity_counts", with_ctes(
    "SELECT v.value, concat(CAST(v.value AS VARCHAR), ' - ', " + LEVEL_SQL.format(p="v.value") + ") AS label, "
    "COALESCE(c.n, 0) AS count FROM range(0, 8) r(value0) "
    "CROSS JOIN LATERAL (SELECT CAST(value0 AS INTEGER) AS value) v "
    "LEFT JOIN (SELECT priority, COUNT(*) AS n FROM journal_logs GROUP BY priority) c ON c.priority = v.value "
    "ORDER BY v.value", JOURNAL_CTE))
def q_severity_counts(spark, sf):
    return stats.severity_counts(_logs(spark, sf))


def _profile_sql() -> str:
    defaults = {"timestamp", "_hostname", "_systemd_unit", "priority", "_pid", "_comm", "message"}
    fields = [f for f in JOURNAL_SCHEMA.fields if f.name not in ("__CURSOR", "__MONOTONIC_TIMESTAMP", "minute_key")]
    parts = []
    for i, f in enumerate(fields):
        parts.append(
            f"SELECT '{f.name}' AS name, '{f.dataType.simpleString().upper()}' AS column_type, "
            f"{str(f.name.lower() in defaults).upper()} AS is_default, {i} AS position, "
            f'COUNT("{f.name}") AS non_null FROM journal_logs'
        )
    return with_ctes(" UNION ALL ".join(parts), JOURNAL_CTE)


PROFILE_SQL = _profile_sql()


@register("column_profile", PROFILE_SQL)
def q_column_profile(spark, sf):
    return stats.column_profile(_logs(spark, sf))


@register("count_entries", with_ctes("SELECT COUNT(*) AS total_entries FROM journal_logs", JOURNAL_CTE))
def q_count_entries(spark, sf):
    return stats.count_entries(_logs(spark, sf))


@register("count_by_minute", with_ctes(
    f"SELECT COUNT(*) AS count FROM journal_logs WHERE minute_key = '{MINUTE.strftime('%Y-%m-%dT%H:%M:00+00:00')}'",
    JOURNAL_CTE))
def q_count_by_minute(spark, sf):
    return stats.count_by_minute(_logs(spark, sf), MINUTE)


@register("minute_counts", with_ctes(
    "SELECT minute_key, COUNT(*) AS count FROM journal_logs GROUP BY minute_key", JOURNAL_CTE))
def q_minute_counts(spark, sf):
    return stats.minute_counts(_logs(spark, sf))


@register("distinct_minutes", with_ctes("SELECT DISTINCT minute_key FROM journal_logs", JOURNAL_CTE))
def q_distinct_minutes(spark, sf):
    return stats.distinct_minutes(_logs(spark, sf))


@register("minute_bounds", with_ctes(
    "SELECT MIN(minute_key) AS oldest_minute, MAX(minute_key) AS newest_minute FROM journal_logs", JOURNAL_CTE))
def q_minute_bounds(spark, sf):
    return stats.minute_bounds(_logs(spark, sf))


@register("buffer_stats", with_ctes(
    "SELECT COUNT(*) AS total_entries, COUNT(DISTINCT minute_key) AS buffered_minutes, "
    "MIN(minute_key) AS oldest_minute, MAX(minute_key) AS newest_minute FROM journal_logs", JOURNAL_CTE))
def q_buffer_stats(spark, sf):
    return stats.buffer_stats(_logs(spark, sf))


STATUS_SQL = (
    "SELECT COUNT(*) AS total_entries, COUNT(DISTINCT minute_key) AS buffered_minutes, "
    "MIN(minute_key) AS oldest_minute, MAX(minute_key) AS newest_minute, "
    f"CAST(COALESCE(SUM({row_bytes_sql(JOURNAL_SCHEMA)}), 0) AS BIGINT) AS stored_bytes FROM journal_logs"
)


@register("status", with_ctes(STATUS_SQL, JOURNAL_CTE))
def q_status(spark, sf):
    return stats.status(_logs(spark, sf))


_STORAGE_SQL = (
    "SELECT (SELECT COUNT(*) FROM journal_logs) AS journal_log_count, "
    "(SELECT COUNT(*) FROM process_metrics) AS process_metric_count, "
    '(SELECT MIN("timestamp") FROM journal_logs) AS oldest_log_timestamp, '
    '(SELECT MAX("timestamp") FROM journal_logs) AS newest_log_timestamp'
)


@register("storage_stats", with_ctes(_STORAGE_SQL, JOURNAL_CTE, PROCESS_CTE))
def q_storage_stats(spark, sf):
    return stats.storage_stats(_logs(spark, sf), _procs(spark, sf))


HEALTH_SQL = (
    """SELECT s.*, z.database_size_bytes, round(z.database_size_bytes / 1073741824.0, 2) AS size_gb,
     round(z.database_size_bytes / 1073741824.0, 2) / 1.0 * 100.0 AS usage_percent,
     CASE WHEN round(z.database_size_bytes / 1073741824.0, 2) / 1.0 * 100.0 >= 90 THEN 'critical'
          WHEN round(z.database_size_bytes / 1073741824.0, 2) / 1.0 * 100.0 >= 75 THEN 'warning' ELSE 'good' END AS status,
     30 AS log_retention_days, CAST(1.0 AS DOUBLE) AS log_max_size_gb, 7 AS process_retention_days,
     CAST(0.5 AS DOUBLE) AS process_max_size_gb
     FROM (""" + _STORAGE_SQL + """) s, (SELECT CAST(
       (SELECT COALESCE(SUM(""" + row_bytes_sql(JOURNAL_SCHEMA) + """), 0) FROM journal_logs)
     + (SELECT COALESCE(SUM(""" + row_bytes_sql(PROCESS_SCHEMA) + """), 0) FROM process_metrics) AS BIGINT)
       AS database_size_bytes) z""")


@register("storage_health", with_ctes(HEALTH_SQL, JOURNAL_CTE, PROCESS_CTE))
def q_storage_health(spark, sf):
    return stats.storage_health(_logs(spark, sf), _procs(spark, sf))


# sizes in GiB against the default limit of 1 GB
_LEVEL_SIZES = {"good": 0.5, "warning": 0.75, "critical": 0.9}


@register("storage_levels", with_ctes(
    " UNION ALL ".join(f"SELECT CAST({int(x * 2**30)} AS BIGINT) AS database_size_bytes, round({int(x * 2**30)} / 1073741824.0, 2) / 1.0 * 100.0 "
                       f"AS usage_percent, '{state}' AS status, COUNT(*) AS journal_log_count FROM journal_logs" for state, x in _LEVEL_SIZES.items()), JOURNAL_CTE))
def q_storage_levels(spark, sf):
    """G14 with a known size, in each state; the plan reads no text column."""
    logs, procs = _logs(spark, sf), _procs(spark, sf)
    rows = [stats.storage_health(logs, procs, int(x * 2**30)).select("database_size_bytes", "usage_percent", "status", "journal_log_count")
            for x in _LEVEL_SIZES.values()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("priority_labels", with_ctes(
    "SELECT DISTINCT priority, " + LEVEL_SQL.format(p="priority") + " AS level, "
    "CASE WHEN priority <= 2 THEN 'critical' WHEN priority = 3 THEN 'error' WHEN priority = 4 THEN 'warning' "
    "ELSE '' END AS severity FROM journal_logs", JOURNAL_CTE))
def q_priority_labels(spark, sf):
    return (
        _logs(spark, sf).select("priority").distinct()
        .select("priority", C.priority_label("priority").alias("level"), C.severity_class("priority").alias("severity"))
    )


# --------------------------------------------------------------------------- I6, I7


_LATEST = 'SELECT * FROM process_metrics WHERE "timestamp" = (SELECT MAX("timestamp") FROM process_metrics)'


@register("latest_processes", with_ctes(
    f"SELECT l.*, (SELECT COUNT(*) FROM ({_LATEST})) AS total FROM ({_LATEST}) l", JOURNAL_CTE, PROCESS_CTE))
def q_latest_processes(spark, sf):
    return processes.latest_processes(_procs(spark, sf))


_PTABLE_SELECT = """SELECT "timestamp", pid, name, cpu_usage, mem_usage, "user", runtime, cmdline,
 COALESCE(virtual_memory, 0.0) AS virtual_memory, status, parent_pid,
 CASE WHEN mem_usage IS NULL OR mem_usage <= 0 THEN '-'
      WHEN mem_usage < 1024 THEN printf('%.1f B', mem_usage)
      WHEN mem_usage < 1048576 THEN printf('%.1f KB', mem_usage / 1024.0)
      WHEN mem_usage < 1073741824 THEN printf('%.1f MB', mem_usage / 1048576.0)
      WHEN mem_usage < 1099511627776 THEN printf('%.1f GB', mem_usage / 1073741824.0)
      WHEN mem_usage < 1125899906842624 THEN printf('%.1f TB', mem_usage / 1099511627776.0)
      ELSE printf('%.1f PB', mem_usage / 1125899906842624.0) END AS mem_text,
 CASE WHEN runtime < 60 THEN concat(runtime, 's')
      WHEN runtime // 60 < 60 THEN CASE WHEN runtime % 60 > 0 THEN concat(runtime // 60, 'm ', runtime % 60, 's') ELSE concat(runtime // 60, 'm') END
      WHEN runtime // 3600 < 24 THEN CASE WHEN (runtime // 60) % 60 > 0 THEN concat(runtime // 3600, 'h ', (runtime // 60) % 60, 'm') ELSE concat(runtime // 3600, 'h') END
      ELSE CASE WHEN (runtime // 3600) % 24 > 0 THEN concat(runtime // 86400, 'd ', (runtime // 3600) % 24, 'h') ELSE concat(runtime // 86400, 'd') END END AS runtime_text,
 CASE WHEN mem_usage IS NULL OR mem_usage <= 0 THEN 0.0 ELSE mem_usage / 17179869184.0 * 100.0 END AS mem_percent"""


@register("process_table", with_ctes(
    f"{_PTABLE_SELECT} FROM ({_LATEST}) ORDER BY cpu_usage DESC NULLS LAST, pid LIMIT 100", PROCESS_CTE))
def q_process_table(spark, sf):
    return processes.process_table(_procs(spark, sf))


_SEARCH_TEXT_SQL = (
    "lower(concat_ws(' ', CAST(pid AS VARCHAR), COALESCE(name, ''), COALESCE(\"user\", ''), "
    "printf('%.1f', cpu_usage), CAST(\"timestamp\" AS VARCHAR)))"
)


@register("process_fuzzy", with_ctes(
    f"{_PTABLE_SELECT} FROM ({_LATEST}) WHERE regexp_matches({_SEARCH_TEXT_SQL}, '1.*v.*i') "
    "ORDER BY cpu_usage DESC NULLS LAST, pid LIMIT 5 OFFSET 3", PROCESS_CTE))
def q_process_fuzzy(spark, sf):
    return processes.process_table(_procs(spark, sf), q="1VI", limit=5, offset=3)


_SHOWN = (
    "\"timestamp\", pid, COALESCE(CAST(parent_pid AS VARCHAR), '-') AS parent_pid_text, name, COALESCE(status, '-') AS status_text, "
    "concat(printf('%.1f', cpu_usage), '%') AS cpu_text, mem_text, '-' AS virtual_memory_text, COALESCE(\"user\", '-') AS user_text, "
    "runtime_text, COALESCE(cmdline, '-') AS cmdline_text"
)
_SHOWN_ROWS = f"(SELECT {_SHOWN}, runtime, cpu_usage, \"user\" FROM (SELECT {_PTABLE_SELECT.split(' ', 1)[1]} FROM ({_LATEST})))"


@register("process_page", with_ctes(
    f"SELECT s.*, r.* EXCLUDE (runtime, cpu_usage, \"user\") FROM (SELECT * FROM {_SHOWN_ROWS} ORDER BY cpu_usage DESC NULLS LAST, pid LIMIT 7 OFFSET 2) r, "
    f"(SELECT MAX(\"timestamp\") AS snapshot, COUNT(*) AS total, CAST(2 AS BIGINT) AS \"offset\", LEAST(7, GREATEST(COUNT(*) - 2, 0)) AS returned, "
    f"CASE WHEN COUNT(*) > 9 THEN CAST(9 AS BIGINT) END AS next_offset, CASE WHEN COUNT(*) > 9 THEN 'more' WHEN COUNT(*) = 0 THEN 'none' ELSE 'end' END AS state "
    f"FROM ({_LATEST})) s", PROCESS_CTE))
def q_process_page(spark, sf):
    """I7 as shown: display texts beside the page state of the newest snapshot."""
    rows, state = processes.process_page(_procs(spark, sf), limit=7, offset=2)
    return rows.crossJoin(F.broadcast(state))


@register("process_sorted", with_ctes(
    f"{_PTABLE_SELECT} FROM ({_LATEST}) ORDER BY \"user\" ASC NULLS LAST, pid LIMIT 20", PROCESS_CTE))
def q_process_sorted(spark, sf):
    """I7 sorted by another shown column, NULLs last."""
    return processes.process_table(_procs(spark, sf), limit=20, sort="user", sort_dir="asc")


@register("process_search_text", with_ctes(
    f'SELECT "timestamp", pid, {_SEARCH_TEXT_SQL} AS search_text FROM process_metrics', PROCESS_CTE))
def q_process_search_text(spark, sf):
    return _procs(spark, sf).select("timestamp", "pid", C.search_text().alias("search_text"))


@register("format_bytes", with_ctes(
    'SELECT "timestamp", pid, mem_text FROM (' + _PTABLE_SELECT.replace("mem_usage", "(mem_usage * 1000.0)")
    + " FROM process_metrics)", PROCESS_CTE))
def q_format_bytes(spark, sf):
    return _procs(spark, sf).select("timestamp", "pid", C.human_bytes(F.col("mem_usage") * 1000.0).alias("mem_text"))


@register("format_runtime", with_ctes(
    'SELECT "timestamp", pid, runtime_text FROM (' + _PTABLE_SELECT + " FROM process_metrics)", PROCESS_CTE))
def q_format_runtime(spark, sf):
    return _procs(spark, sf).select("timestamp", "pid", C.human_runtime("runtime").alias("runtime_text"))


@register("memory_percent", with_ctes(
    'SELECT "timestamp", pid, mem_percent FROM (' + _PTABLE_SELECT + " FROM process_metrics)", PROCESS_CTE))
def q_memory_percent(spark, sf):
    return _procs(spark, sf).select("timestamp", "pid", C.memory_percent("mem_usage").alias("mem_percent"))


@register("age_seconds", with_ctes(
    f'SELECT "timestamp", pid, CAST(floor(epoch_us({_ts(NOW)}) / 1000000.0 - epoch_us("timestamp") / 1000000.0) AS BIGINT) '
    "AS age_seconds FROM process_metrics", PROCESS_CTE))
def q_age_seconds(spark, sf):
    return _procs(spark, sf).select("timestamp", "pid", C.age_seconds("timestamp", NOW).alias("age_seconds"))


_SIZE_TEXT = (
    "concat(CAST(user_id AS VARCHAR), CASE event_id % 6 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'g' "
    "WHEN 3 THEN 'T' WHEN 4 THEN '.5G' ELSE '' END)"
)


def _sized(suffix: str, factor: str) -> str:
    return f"WHEN right(size_text, 1) = '{suffix}' THEN TRY_CAST(left(size_text, length(size_text) - 1) AS DOUBLE) * {factor} "


# a capital suffix multiplies, anything else must be a number as it stands
@register("size_text", f"""SELECT event_id, size_text, CAST(trunc(CASE WHEN v < 0 THEN 0 ELSE v END) AS BIGINT) AS size_bytes FROM (SELECT event_id, size_text,
 CASE {_sized("T", "1099511627776.0")}{_sized("G", "1073741824.0")}{_sized("M", "1048576.0")}{_sized("K", "1024.0")}
 ELSE TRY_CAST(size_text AS DOUBLE) END AS v FROM (SELECT event_id, {_SIZE_TEXT} AS size_text FROM events))""")
def q_size_text(spark, sf):
    ev = tables.read_events(spark, sf)
    e, u = F.col("event_id"), F.col("user_id")
    suffix = (F.when(e % 6 == 0, "K").when(e % 6 == 1, "M").when(e % 6 == 2, "g").when(e % 6 == 3, "T")
              .when(e % 6 == 4, ".5G").otherwise(""))
    txt = F.concat(u.cast("string"), suffix)
    return ev.select("event_id", txt.alias("size_text"), C.size_bytes(txt).alias("size_bytes"))


# --------------------------------------------------------------------------- A, B, E6


_PARSED_SQL = journal_select({
    "timestamp": "CASE WHEN event_id % 101 = 0 THEN " + _ts(NOW) + " ELSE CAST(ts AS TIMESTAMP) END",
    "minute_key": "CASE WHEN event_id % 101 = 0 THEN '" + NOW.strftime("%Y-%m-%dT%H:%M:00+00:00")
                  + "' ELSE strftime(ts, '%Y-%m-%dT%H:%M:00+00:00') END",
    "priority": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE "
                "CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 5 WHEN 'view' THEN 7 "
                "WHEN 'signup' THEN NULL ELSE event_id % 10 END AS INTEGER) END",
    "__REALTIME_TIMESTAMP": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE epoch_us(ts) END",
})
_PARSED_CTE = f"parsed AS ({_PARSED_SQL})"


@register("parse_journal", with_ctes(
    'SELECT "timestamp", minute_key, message, priority, _HOSTNAME, _SYSTEMD_UNIT, _PID, _COMM, __CURSOR, '
    "__SEQNUM, __REALTIME_TIMESTAMP, extra_fields FROM parsed", _PARSED_CTE))
def q_parse_journal(spark, sf):
    entries = J.parse_lines(tables.raw_journal_lines(spark, sf))
    typed = ingest.parse_entries(entries, NOW)
    return typed.select("timestamp", "minute_key", "message", "priority", "_HOSTNAME", "_SYSTEMD_UNIT", "_PID",
                        "_COMM", "__CURSOR", "__SEQNUM", "__REALTIME_TIMESTAMP", "extra_fields")


@register("typed_fields", with_ctes(
    "SELECT " + ", ".join(f'"{f.name}"' for f in JOURNAL_SCHEMA.fields) + " FROM parsed", _PARSED_CTE))
def q_typed_fields(spark, sf):
    entries = J.parse_lines(tables.raw_journal_lines(spark, sf))
    return ingest.parse_entries(entries, NOW)


@register("extra_fields", with_ctes(
    "SELECT __CURSOR, extra_fields, json_extract_string(extra_fields, '$.CUSTOM_K') AS custom_k FROM parsed",
    _PARSED_CTE))
def q_extra_fields(spark, sf):
    entries = J.parse_lines(tables.raw_journal_lines(spark, sf))
    typed = ingest.parse_entries(entries, NOW)
    return typed.select("__CURSOR", "extra_fields",
                        F.get_json_object("extra_fields", "$.CUSTOM_K").alias("custom_k"))


_NOT_JSON, _BAD_CLOCK = "event_id % 89 = 0", "event_id % 83 = 0 AND event_id % 101 <> 0"


@register("ingest_report", f"""SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE {_NOT_JSON}) AS not_json,
 COUNT(*) FILTER (WHERE NOT ({_NOT_JSON}) AND NOT ({_BAD_CLOCK})) AS accepted,
 COUNT(*) FILTER (WHERE NOT ({_NOT_JSON}) AND {_BAD_CLOCK}) AS rejected FROM events""")
def q_ingest_report(spark, sf):
    """Every 89th line is cut off and every 83rd has a clock that is not a number."""
    return J.line_report(spoiled_lines(spark, sf), NOW)


def spoiled_lines(spark, sf, keep_seq: bool = False):
    seq = F.get_json_object("value", "$.__SEQNUM").cast("long")
    bad_clock = F.regexp_replace("value", '"__REALTIME_TIMESTAMP":"', '"__REALTIME_TIMESTAMP":"x')
    value = F.when(seq % 89 == 0, F.left(F.col("value"), F.lit(12))).when(seq % 83 == 0, bad_clock).otherwise(F.col("value"))
    return tables.raw_journal_lines(spark, sf).select(value.alias("value"), *([seq.alias("seq")] if keep_seq else []))


@register("ingest_rejects", f"""SELECT 'not_json' AS reason, CAST(NULL AS BIGINT) AS seq, COUNT(*) AS lines FROM events WHERE {_NOT_JSON}
 UNION ALL SELECT 'bad_clock', CAST(event_id AS BIGINT), COUNT(*) FROM events WHERE NOT ({_NOT_JSON}) AND {_BAD_CLOCK} GROUP BY 2""")
def q_ingest_rejects(spark, sf):
    """A1 / B1: the lines that are not accepted, with their reason."""
    seq = F.get_json_object("line", "$.__SEQNUM").cast("long")
    return J.rejected_lines(spoiled_lines(spark, sf), NOW).groupBy("reason", seq.alias("seq")).agg(F.count("*").alias("lines"))


def _nonnull_count_sql() -> str:
    from logtide.schemas import KNOWN_FIELDS

    return " + ".join(f'CASE WHEN "{c}" IS NULL THEN 0 ELSE 1 END' for c, _, _ in KNOWN_FIELDS)


@register("rebuild_fields", with_ctes(
    f"""SELECT "timestamp", __CURSOR, {_nonnull_count_sql()} + CASE WHEN extra_fields IS NULL THEN 0 ELSE 1 END
     AS n_fields, CAST(priority AS VARCHAR) AS f_priority, CAST(_PID AS VARCHAR) AS f_pid,
     json_extract_string(extra_fields, '$.CUSTOM_K') AS f_custom_k, message AS f_message FROM journal_logs""",
    JOURNAL_CTE))
def q_rebuild_fields(spark, sf):
    # Row-wise map building: spread a single-split input over the cores first.
    logs = tables.spread(_logs(spark, sf))
    rebuilt = ingest.rebuild_fields(logs)
    m = F.col("fields")
    return rebuilt.select(
        "timestamp",
        m["__CURSOR"].alias("__CURSOR"),
        F.size(m).alias("n_fields"),
        m["PRIORITY"].alias("f_priority"),
        m["_PID"].alias("f_pid"),
        m["CUSTOM_K"].alias("f_custom_k"),
        m["MESSAGE"].alias("f_message"),
    )


def _field_texts_sql() -> str:
    from logtide.schemas import KNOWN_FIELDS

    known = ", ".join(f"CASE WHEN \"{c}\" IS NOT NULL THEN concat('{n}=', CAST(\"{c}\" AS VARCHAR)) END" for c, n, _ in KNOWN_FIELDS)
    extra = "CASE WHEN extra_fields IS NOT NULL THEN concat('CUSTOM_K=', json_extract_string(extra_fields, '$.CUSTOM_K')) END"
    return f"array_to_string(list_sort(list_filter([{known}, {extra}], lambda x: x IS NOT NULL)), chr(10))"


@register("rebuild_fields_whole", with_ctes(f'SELECT "timestamp", {_field_texts_sql()} AS fields FROM journal_logs', JOURNAL_CTE))
def q_rebuild_fields_whole(spark, sf):
    """Every key and value of the rebuilt maps, as sorted text."""
    rebuilt = ingest.rebuild_fields(tables.spread(_logs(spark, sf)))
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rebuilt.select("timestamp", F.array_join(F.sort_array(pairs), "\n").alias("fields"))


@register("tail", with_ctes(
    'SELECT __CURSOR, "timestamp" FROM journal_logs ORDER BY "timestamp" DESC, __SEQNUM DESC LIMIT 100', JOURNAL_CTE))
def q_tail(spark, sf):
    return J.tail(_logs(spark, sf), 100).select("__CURSOR", "timestamp")


@register("newest_first", with_ctes('SELECT __CURSOR, "timestamp" FROM journal_logs', JOURNAL_CTE))
def q_newest_first(spark, sf):
    return J.newest_first(_logs(spark, sf)).select("__CURSOR", "timestamp")


@register("at_timestamp", with_ctes(
    "SELECT __CURSOR, message FROM journal_logs WHERE __REALTIME_TIMESTAMP = "
    "epoch_us(TIMESTAMP '2024-01-01 00:00:07.179575')", JOURNAL_CTE))
def q_at_timestamp(spark, sf):
    return J.at_timestamp(_logs(spark, sf), datetime(2024, 1, 1, 0, 0, 7, 179575)).select("__CURSOR", "message")


@register("skip_older_than", with_ctes(
    f'SELECT COUNT(*) FILTER (WHERE "timestamp" < {_ts(NOW - timedelta(days=10))}) AS skipped, '
    f'COUNT(*) FILTER (WHERE "timestamp" >= {_ts(NOW - timedelta(days=10))}) AS kept FROM journal_logs', JOURNAL_CTE))
def q_skip_older_than(spark, sf):
    kept, skipped = J.skip_older_than(_logs(spark, sf), NOW - timedelta(days=10))
    return skipped.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("kept"))))


_HISTORY = f'"timestamp" >= {_ts(NOW - timedelta(days=2))} AND "timestamp" <= {_ts(NOW)}'


@register("recent_history", with_ctes(f'SELECT __CURSOR, "timestamp" FROM journal_logs WHERE {_HISTORY}', JOURNAL_CTE))
def q_recent_history(spark, sf):
    return J.recent_history(_logs(spark, sf), NOW, NOW - timedelta(days=2)).select("__CURSOR", "timestamp")


@register("recent_history_capped", with_ctes(
    'SELECT __CURSOR, "timestamp" FROM (SELECT * FROM journal_logs ORDER BY "timestamp" DESC, __SEQNUM DESC '
    f"LIMIT 500) WHERE {_HISTORY}", JOURNAL_CTE))
def q_recent_history_capped(spark, sf):
    """A7 with a cap the caller gives: of the newest 500 entries only."""
    return J.recent_history(_logs(spark, sf), NOW, NOW - timedelta(days=2), max_checked=500).select("__CURSOR", "timestamp")


_INSTANT_BYTES = (
    "per_instant AS (SELECT \"timestamp\" AS instant, SUM({rb}) AS bytes FROM journal_logs GROUP BY 1)"
).format(rb=row_bytes_sql(JOURNAL_SCHEMA))


@register("backfill_budget", with_ctes(
    'SELECT __CURSOR, "timestamp" FROM journal_logs WHERE "timestamp" >= (SELECT MIN(instant) FROM ('
    "SELECT instant, COALESCE(SUM(bytes) OVER (ORDER BY instant DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    " AS newer FROM per_instant) WHERE newer < 250000)", JOURNAL_CTE, _INSTANT_BYTES))
def q_backfill_budget(spark, sf):
    return J.backfill(_logs(spark, sf), 250_000).select("__CURSOR", "timestamp")


# --------------------------------------------------------------------------- C


@register("retain_by_age", with_ctes(
    f'SELECT __CURSOR, "timestamp" FROM journal_logs WHERE "timestamp" >= {_ts(NOW - timedelta(days=20))}',
    JOURNAL_CTE))
def q_retain_by_age(spark, sf):
    kept, _ = maintenance.retain_by_age(_logs(spark, sf), NOW, 20)
    return kept.select("__CURSOR", "timestamp")


@register("retain_by_size", with_ctes(
    'SELECT __CURSOR, "timestamp" FROM journal_logs WHERE "timestamp" >= (SELECT MIN(instant) FROM ('
    "SELECT instant, SUM(bytes) OVER (ORDER BY instant DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum "
    "FROM per_instant) WHERE cum <= 400000)", JOURNAL_CTE, _INSTANT_BYTES))
def q_retain_by_size(spark, sf):
    kept, _ = maintenance.retain_by_size(_logs(spark, sf), 400_000)
    return kept.select("__CURSOR", "timestamp")


@register("drop_oldest_tenth", with_ctes(
    'SELECT __CURSOR, "timestamp" FROM journal_logs WHERE "timestamp" NOT IN (SELECT "timestamp" FROM journal_logs '
    'ORDER BY "timestamp" ASC LIMIT (SELECT COUNT(*) / 10 FROM journal_logs))', JOURNAL_CTE))
def q_drop_oldest_tenth(spark, sf):
    kept, _ = maintenance.drop_oldest_tenth(_logs(spark, sf))
    return kept.select("__CURSOR", "timestamp")


@register("delete_minute", with_ctes(
    f"SELECT COUNT(*) FILTER (WHERE minute_key = '{MINUTE.strftime('%Y-%m-%dT%H:%M:00+00:00')}') AS deleted, "
    f"COUNT(*) FILTER (WHERE minute_key <> '{MINUTE.strftime('%Y-%m-%dT%H:%M:00+00:00')}') AS kept "
    "FROM journal_logs", JOURNAL_CTE))
def q_delete_minute(spark, sf):
    kept, deleted = maintenance.delete_minute(_logs(spark, sf), MINUTE)
    return deleted.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("kept"))))


_PROC_MINUTE_BYTES = (
    "proc_minute AS (SELECT \"timestamp\" AS minute, SUM({rb}) AS bytes FROM process_metrics "
    f"WHERE \"timestamp\" >= {_ts(NOW - timedelta(days=7))} GROUP BY 1)"
).format(rb=row_bytes_sql(PROCESS_SCHEMA))
_LOG_MINUTE_AFTER_AGE = (
    "log_minute AS (SELECT \"timestamp\" AS minute, SUM({rb}) AS bytes FROM journal_logs "
    f"WHERE \"timestamp\" >= {_ts(NOW - timedelta(days=20))} GROUP BY 1)"
).format(rb=row_bytes_sql(JOURNAL_SCHEMA))


def _size_deleted(table: str, instants: str, age_days: int, budget: int) -> str:
    """Rows that age left and the size budget removes: older than the oldest instant that
    still fits with all newer ones, or than the newest one if none fits."""
    cum = f"SELECT minute, SUM(bytes) OVER (ORDER BY minute DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM {instants}"
    return (
        f'(SELECT COUNT(*) FROM {table} WHERE "timestamp" >= {_ts(NOW - timedelta(days=age_days))} AND "timestamp" < '
        f"(SELECT COALESCE(MIN(minute) FILTER (WHERE cum <= {budget}), MAX(minute)) FROM ({cum})))"
    )


@register("retention_report", with_ctes(
    "SELECT a + b + c + d AS total_deleted, a AS logs_deleted_by_time, b AS logs_deleted_by_size, "
    "c AS processes_deleted_by_time, d AS processes_deleted_by_size FROM (SELECT "
    f'(SELECT COUNT(*) FROM journal_logs WHERE "timestamp" < {_ts(NOW - timedelta(days=20))}) AS a, '
    f"{_size_deleted('journal_logs', 'log_minute', 20, 1_000_000)} AS b, "
    f'(SELECT COUNT(*) FROM process_metrics WHERE "timestamp" < {_ts(NOW - timedelta(days=7))}) AS c, '
    f"{_size_deleted('process_metrics', 'proc_minute', 7, 20_000)} AS d)",
    JOURNAL_CTE, PROCESS_CTE, _PROC_MINUTE_BYTES, _LOG_MINUTE_AFTER_AGE))
def q_retention_report(spark, sf):
    return maintenance.retention_report(
        _logs(spark, sf), _procs(spark, sf), NOW, log_retention_days=20, log_max_bytes=1_000_000,
        process_retention_days=7, process_max_bytes=20_000,
    ).select("total_deleted", "logs_deleted_by_time", "logs_deleted_by_size", "processes_deleted_by_time",
             "processes_deleted_by_size")


@register("conform_schema", with_ctes(
    'SELECT "timestamp", pid, name, cpu_usage, mem_usage, "user", runtime, CAST(NULL AS VARCHAR) AS cmdline, '
    "CAST(NULL AS DOUBLE) AS virtual_memory, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS INTEGER) AS parent_pid "
    "FROM process_metrics", PROCESS_CTE))
def q_conform_schema(spark, sf):
    v1 = _procs(spark, sf).select(*[f.name for f in PROCESS_SCHEMA_V1.fields])
    return maintenance.conform(v1, PROCESS_SCHEMA)


@register("dedupe_samples", with_ctes(
    'SELECT "timestamp", pid, name, cpu_usage, mem_usage, "user", runtime, cmdline, virtual_memory, status, '
    'parent_pid FROM (SELECT *, row_number() OVER (PARTITION BY "timestamp", pid ORDER BY seq) AS rn '
    "FROM samples_typed) WHERE rn = 1", SAMPLES_TYPED_CTE))
def q_dedupe_samples(spark, sf):
    typed = processes.to_process_metrics(tables.raw_samples(spark, sf))
    return processes.dedupe_samples(typed, "seq").select(*[f.name for f in PROCESS_SCHEMA.fields])


@register("ingest_summary", with_ctes(
    "SELECT time_bucket(INTERVAL 5 MINUTE, \"timestamp\") AS window_start, "
    "time_bucket(INTERVAL 5 MINUTE, \"timestamp\") + INTERVAL 5 MINUTE AS window_end, 'journal' AS source, "
    "COUNT(*) AS rows FROM journal_logs GROUP BY 1, 2", JOURNAL_CTE))
def q_ingest_summary(spark, sf):
    return ingest.ingest_summary(_logs(spark, sf), "journal")


@register("ingest_summary_all", with_ctes(
    "SELECT time_bucket(INTERVAL 5 MINUTE, \"timestamp\") AS window_start, "
    "time_bucket(INTERVAL 5 MINUTE, \"timestamp\") + INTERVAL 5 MINUTE AS window_end, 'journal' AS source, "
    "COUNT(*) AS rows FROM journal_logs GROUP BY 1, 2 UNION ALL "
    "SELECT time_bucket(INTERVAL 5 MINUTE, \"timestamp\") AS window_start, "
    "time_bucket(INTERVAL 5 MINUTE, \"timestamp\") + INTERVAL 5 MINUTE AS window_end, 'samples' AS source, "
    "COUNT(*) AS rows FROM samples_typed GROUP BY 1, 2", JOURNAL_CTE, SAMPLES_TYPED_CTE))
def q_ingest_summary_all(spark, sf):
    samples = processes.to_process_metrics(tables.raw_samples(spark, sf))
    return ingest.ingest_summary_all(_logs(spark, sf), samples)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from logtide.plans import stored, streams  # noqa: F401  registers the stored-table and streaming queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from logtide.plans import stored, streams  # noqa: F401

    return dict(ORACLE)

"""DuckDB SQL for the derived fixture tables, used by the oracle queries.

The same rules as `logtide.sources.derived`, written as SQL over `events`.
"""

from __future__ import annotations

from logtide.schemas import JOURNAL_SCHEMA

_DUCK_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
               "timestamp_ntz": "TIMESTAMP"}

MESSAGE_SQL = (
    "CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat(event_type, "
    "CASE event_id % 4 WHEN 0 THEN ' 100% of user_' WHEN 1 THEN ' 100 of userX' "
    "WHEN 2 THEN concat(' it', chr(39), 's user-') ELSE concat(' path', chr(92), 'user ') END, "
    "CAST(user_id AS VARCHAR)) END"
)
PRIORITY_SQL = (
    "CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 5 WHEN 'view' THEN 7 "
    "WHEN 'signup' THEN NULL ELSE event_id % 10 END AS INTEGER)"
)
HOSTNAME_SQL = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('host-', CAST(user_id % 5 AS VARCHAR)) END"
CURSOR_SQL = "concat('c-', lpad(CAST(event_id AS VARCHAR), CAST(greatest(10, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0'))"
EXTRA_SQL = "concat('{\"CUSTOM_K\":\"', json_extract_string(props, '$.k'), '\"}')"

JOURNAL_FILLED = {
    "timestamp": "CAST(ts AS TIMESTAMP)",
    "minute_key": "strftime(ts, '%Y-%m-%dT%H:%M:00+00:00')",
    "message": MESSAGE_SQL,
    "priority": PRIORITY_SQL,
    "_HOSTNAME": HOSTNAME_SQL,
    "_SYSTEMD_UNIT": "concat(event_type, '.service')",
    "_PID": "CAST(1000 + user_id AS INTEGER)",
    "_COMM": "event_type",
    "__CURSOR": CURSOR_SQL,
    "__SEQNUM": "CAST(event_id AS BIGINT)",
    "__REALTIME_TIMESTAMP": "epoch_us(ts)",
    "extra_fields": EXTRA_SQL,
}


def duck_type(spark_type) -> str:
    return _DUCK_TYPES[spark_type.simpleString()]


def journal_select(overrides: dict[str, str] | None = None) -> str:
    filled = dict(JOURNAL_FILLED)
    filled.update(overrides or {})
    cols = []
    for f in JOURNAL_SCHEMA.fields:
        expr = filled.get(f.name, f"CAST(NULL AS {duck_type(f.dataType)})")
        cols.append(f'{expr} AS "{f.name}"')
    return "SELECT " + ",\n ".join(cols) + " FROM events"


JOURNAL_CTE = f"journal_logs AS ({journal_select()})"

PROCESS_CTE = """process_metrics AS (
 SELECT "timestamp", pid, name, cpu_usage, mem_usage, "user", runtime,
  CAST(NULL AS VARCHAR) AS cmdline, CAST(NULL AS DOUBLE) AS virtual_memory,
  CAST(NULL AS VARCHAR) AS status, CAST(NULL AS INTEGER) AS parent_pid FROM (
 SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS "timestamp", CAST(1000 + user_id AS INTEGER) AS pid,
  event_type AS name, value AS cpu_usage, value * 1048576.0 AS mem_usage,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 3 AS VARCHAR) END AS "user",
  (event_id * 37) % 400000 AS runtime,
  row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id ORDER BY event_id) AS rn
 FROM events) t WHERE rn = 1)"""

# Raw samples typed by the ingest rules (before de-duplication); `seq` = event_id.
SAMPLES_TYPED_CTE = """samples_typed AS (
 SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS "timestamp", CAST(1000 + user_id AS INTEGER) AS pid,
  event_type AS name, CAST(CAST(value AS FLOAT) AS DOUBLE) AS cpu_usage,
  CAST(CAST(round(value * 1048576.0) AS BIGINT) AS DOUBLE) AS mem_usage,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 3 AS VARCHAR) END AS "user",
  (event_id * 37) % 400000 AS runtime,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('/usr/bin/', event_type, ' --id ', CAST(event_id AS VARCHAR)) END AS cmdline,
  CAST(CAST(round(value * 2097152.0) AS BIGINT) AS DOUBLE) AS virtual_memory,
  CASE WHEN event_id % 2 = 0 THEN 'Run' ELSE 'Sleep' END AS status,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE 1 END AS parent_pid,
  event_id AS seq
 FROM events)"""

LEVEL_SQL = (
    "CASE {p} WHEN 0 THEN 'Emergency' WHEN 1 THEN 'Alert' WHEN 2 THEN 'Critical' WHEN 3 THEN 'Error' "
    "WHEN 4 THEN 'Warning' WHEN 5 THEN 'Notice' WHEN 6 THEN 'Info' WHEN 7 THEN 'Debug' ELSE 'Unknown' END"
)


def row_bytes_sql(schema, exclude=()) -> str:
    parts = []
    for f in schema.fields:
        if f.name in exclude:
            continue
        if f.dataType.simpleString() == "string":
            parts.append(f'coalesce(strlen("{f.name}"), 0)')
        else:
            parts.append("8")
    return " + ".join(parts)


def with_ctes(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + sql

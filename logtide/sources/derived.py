"""Journal logs, process samples and raw journal lines derived from `events`.

The supplied tables hold no journal data, so the fixtures are derived from the
`events` table by fixed rules (see FIXTURES.md).  Each function is a plain
projection or a partial (map-side combined) aggregate, so the derived tables
scale with `events` and never pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import minute_key
from logtide.schemas import JOURNAL_SCHEMA, PROCESS_SCHEMA

_UNIX_MICROS = "unix_micros(CAST(ts AS TIMESTAMP))"


def _conform(df: DataFrame, schema) -> DataFrame:
    """All columns of `schema` in order and type; absent ones as typed NULLs.
    One SQL projection, so a wide table costs one call, not one per column."""
    have = set(df.columns)
    exprs = [
        f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name in have
        else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ]
    return df.selectExpr(*exprs)


def _message(event_id: Column, event_type: Column, user_id: Column) -> Column:
    m4 = event_id % 4
    middle = (
        F.when(m4 == 0, F.lit(" 100% of user_"))
        .when(m4 == 1, F.lit(" 100 of userX"))
        .when(m4 == 2, F.lit(" it's user-"))
        .otherwise(F.lit(" path\\user "))
    )
    return F.when(event_id % 50 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(event_type, middle, user_id.cast("string"))
    )


def _priority(event_id: Column, event_type: Column) -> Column:
    return (
        F.when(event_type == "error", F.lit(3))
        .when(event_type == "purchase", F.lit(5))
        .when(event_type == "view", F.lit(7))
        .when(event_type == "signup", F.lit(None).cast("int"))
        .otherwise((event_id % 10).cast("int"))
    )


def _hostname(event_id: Column, user_id: Column) -> Column:
    return F.when(event_id % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("host-"), (user_id % 5).cast("string"))
    )


def _cursor(event_id: Column) -> Column:
    return F.concat(F.lit("c-"), F.lpad(event_id.cast("string"), F.greatest(F.lit(10), F.length(event_id.cast("string"))), F.lit("0")))


def journal_logs_from_events(events: DataFrame) -> DataFrame:
    """Typed `journal_logs` rows, one per event, all 76 columns."""
    e, t, u = F.col("event_id"), F.col("event_type"), F.col("user_id")
    filled = {
        "timestamp": F.col("ts").cast("timestamp_ntz"),
        "minute_key": minute_key(F.col("ts")),
        "message": _message(e, t, u),
        "priority": _priority(e, t),
        "_HOSTNAME": _hostname(e, u),
        "_SYSTEMD_UNIT": F.concat(t, F.lit(".service")),
        "_PID": (F.lit(1000) + u).cast("int"),
        "_COMM": t,
        "__CURSOR": _cursor(e),
        "__SEQNUM": e.cast("long"),
        "__REALTIME_TIMESTAMP": F.expr(_UNIX_MICROS),
        "extra_fields": F.to_json(
            F.create_map(F.lit("CUSTOM_K"), F.get_json_object(F.col("props"), "$.k"))
        ),
    }
    return _conform(events.select(*[c.alias(n) for n, c in filled.items()]), JOURNAL_SCHEMA)


def raw_journal_lines_from_events(events: DataFrame) -> DataFrame:
    """One exported journal JSON object per line (`value` text column).

    Every value is text; NULL fields are absent.  PRIORITY is `bad` where
    event_id % 97 = 0, and __REALTIME_TIMESTAMP is left out where
    event_id % 101 = 0, so both ingest edge cases occur in the data.
    """
    e, t, u = F.col("event_id"), F.col("event_type"), F.col("user_id")
    prio = F.when(e % 97 == 0, F.lit("bad")).otherwise(_priority(e, t).cast("string"))
    realtime = F.when(e % 101 == 0, F.lit(None).cast("string")).otherwise(
        F.expr(_UNIX_MICROS).cast("string")
    )
    pairs = [
        ("MESSAGE", _message(e, t, u)),
        ("PRIORITY", prio),
        ("_HOSTNAME", _hostname(e, u)),
        ("_SYSTEMD_UNIT", F.concat(t, F.lit(".service"))),
        ("_PID", (F.lit(1000) + u).cast("string")),
        ("_COMM", t),
        ("__CURSOR", _cursor(e)),
        ("__SEQNUM", e.cast("string")),
        ("__REALTIME_TIMESTAMP", realtime),
        ("CUSTOM_K", F.get_json_object(F.col("props"), "$.k")),
    ]
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    m = F.map_filter(m, lambda k, v: v.isNotNull())
    return events.select(F.to_json(m).alias("value"))


def process_metrics_from_events(events: DataFrame) -> DataFrame:
    """One sample per (hour, user): the lowest event_id of each group.

    A partial hash aggregate (min_by) rather than a window, so a hot group is
    combined map-side instead of landing whole in one task.
    """
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    first = (
        events.groupBy(hour.alias("timestamp"), F.col("user_id"))
        .agg(F.min_by(F.struct("event_id", "event_type", "value"), F.col("event_id")).alias("s"))
    )
    u, e = F.col("user_id"), F.col("s.event_id")
    filled = {
        "timestamp": F.col("timestamp"),
        "pid": (F.lit(1000) + u).cast("int"),
        "name": F.col("s.event_type"),
        "cpu_usage": F.col("s.value"),
        "mem_usage": F.col("s.value") * F.lit(1048576.0),
        "user": F.when(u % 7 == 0, F.lit(None).cast("string")).otherwise((u % 3).cast("string")),
        "runtime": (e * 37) % 400000,
    }
    return _conform(first.select(*[c.alias(n) for n, c in filled.items()]), PROCESS_SCHEMA)


def raw_samples_from_events(events: DataFrame) -> DataFrame:
    """Raw sampler rows (before typing), every event one sample, duplicates kept.

    `seq` is the arrival order used to keep the first of duplicate samples.
    """
    e, u, t, v = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value")
    return events.select(
        F.date_trunc("hour", F.col("ts")).cast("timestamp").alias("timestamp"),
        (F.lit(1000) + u).cast("int").alias("pid"),
        t.alias("name"),
        v.cast("float").alias("cpu_percent"),
        F.round(v * F.lit(1048576.0)).cast("long").alias("memory_bytes"),
        F.when(u % 7 == 0, F.lit("root")).otherwise(
            F.concat(F.lit("Uid("), (u % 3).cast("string"), F.lit(")"))
        ).alias("user_id"),
        ((e * 37) % 400000).alias("runtime_secs"),
        F.when(e % 13 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("/usr/bin/"), t), F.lit("--id"), e.cast("string"))
        ).alias("cmd"),
        F.round(v * F.lit(2097152.0)).cast("long").alias("virtual_memory_bytes"),
        F.when(e % 2 == 0, F.lit("Run")).otherwise(F.lit("Sleep")).alias("status"),
        F.when(u % 4 == 0, F.lit(None).cast("int")).otherwise(F.lit(1)).alias("parent_pid"),
        e.alias("seq"),
    )

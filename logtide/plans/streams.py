"""Registered streaming queries (K1-K4): each drives a Structured Streaming job
to completion with `availableNow` and returns what it produced.

Inputs are the supplied `events` table read as a file stream, or journal /
sample files that Spark derives from it into a fresh folder under the shared
checkpoint directory.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.plans.catalog import NOW, _BAD_CLOCK, _NOT_JSON, _PARSED_CTE, register, spoiled_lines
from logtide.plans.oracle import JOURNAL_CTE, LEVEL_SQL, SAMPLES_TYPED_CTE, with_ctes
from logtide.schemas import EVENTS_SCHEMA, PROCESS_SCHEMA
from logtide.session import checkpoint_dir, ensure_utc
from logtide.sources import journal as J
from logtide.sources import samples as S
from logtide.sources import tables
from logtide.sources.derived import journal_logs_from_events
from logtide.streaming import jobs


def _scratch(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/logtide-{kind}-{uuid.uuid4().hex}"


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream (the parquet file is the only input file)."""
    ensure_utc(spark)
    return (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf.rstrip("/"))
    )


@register("stream_timechart", with_ctes(
    "SELECT date_trunc('minute', \"timestamp\") AS time_bin, COALESCE(priority, 6) AS priority, "
    + LEVEL_SQL.format(p="COALESCE(priority, 6)") + " AS level, COUNT(*) AS count FROM journal_logs GROUP BY 1, 2", JOURNAL_CTE))
def q_stream_timechart(spark, sf):
    """K3: the live chart after all events, open bins included."""
    out = _scratch(spark, "timechart-out")
    jobs.start_live_timechart(journal_logs_from_events(_events_stream(spark, sf)), out).awaitTermination()
    return jobs.read_live_timechart(spark, out)


@register("stream_ingest_summary", with_ctes(
    "SELECT time_bucket(INTERVAL 5 MINUTE, \"timestamp\") AS window_start, "
    "time_bucket(INTERVAL 5 MINUTE, \"timestamp\") + INTERVAL 5 MINUTE AS window_end, 'journal' AS source, "
    "COUNT(*) AS rows FROM journal_logs GROUP BY 1, 2", JOURNAL_CTE))
def q_stream_ingest_summary(spark, sf):
    """K4: rows per five minutes, the open windows included."""
    out = _scratch(spark, "summary-out")
    jobs.start_live_summary(journal_logs_from_events(_events_stream(spark, sf)), "journal", out).awaitTermination()
    return jobs.read_live_summary(spark, out)


@register("stream_ingest", with_ctes(
    'SELECT "timestamp", minute_key, message, priority, _HOSTNAME, _SYSTEMD_UNIT, _PID, _COMM, __CURSOR, '
    "__SEQNUM, __REALTIME_TIMESTAMP, extra_fields FROM parsed", _PARSED_CTE))
def q_stream_ingest(spark, sf):
    ensure_utc(spark)
    src = _scratch(spark, "journal-in")
    tables.raw_journal_lines(spark, sf).write.text(src)
    out = _scratch(spark, "journal-out")
    q = jobs.start_log_ingest(J.stream_journal(spark, src), NOW, out)
    q.awaitTermination()
    return spark.read.parquet(out).select(
        "timestamp", "minute_key", "message", "priority", "_HOSTNAME", "_SYSTEMD_UNIT", "_PID", "_COMM",
        "__CURSOR", "__SEQNUM", "__REALTIME_TIMESTAMP", "extra_fields")


_SAMPLE_COLUMNS = [f.name for f in PROCESS_SCHEMA.fields]
_LEAST = ", ".join(f'"{c}" NULLS FIRST' for c in _SAMPLE_COLUMNS if c not in ("timestamp", "pid"))


@register("stream_samples", with_ctes(
    "SELECT " + ", ".join(f'"{c}"' for c in _SAMPLE_COLUMNS) + " FROM (SELECT *, row_number() OVER (PARTITION BY \"timestamp\", pid "
    f"ORDER BY CASE WHEN seq % 3 = 0 THEN 2 ELSE seq % 3 - 1 END, {_LEAST}) AS _n FROM samples_typed) WHERE _n = 1", SAMPLES_TYPED_CTE))
def q_stream_samples(spark, sf):
    """K2: three files, out of time order, one micro-batch each; the first arrival of a (timestamp, pid) stays."""
    ensure_utc(spark)
    src = _scratch(spark, "samples-in")
    raw = tables.raw_samples(spark, sf)
    for arrival, third in enumerate((1, 2, 0)):
        raw.where(F.col("seq") % 3 == third).drop("seq").coalesce(1).write.json(f"{src}/{arrival}")
        time.sleep(0.05)  # files of a stream are read in order of their times
    out = _scratch(spark, "samples-out")
    jobs.start_sample_ingest(S.stream_process_samples(spark, f"{src}/*", max_files_per_trigger=1), out).awaitTermination()
    return tables.read_process_metrics(spark, out).select(*_SAMPLE_COLUMNS)


@register("stream_rejects", f"""SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE NOT ({_NOT_JSON}) AND NOT ({_BAD_CLOCK})) AS accepted,
 COUNT(*) FILTER (WHERE {_NOT_JSON}) AS not_json, COUNT(*) FILTER (WHERE NOT ({_NOT_JSON}) AND {_BAD_CLOCK}) AS bad_clock,
 (SELECT COUNT(*) FROM events WHERE NOT ({_NOT_JSON}) AND NOT ({_BAD_CLOCK})) AS stored FROM events GROUP BY event_id % 2""")
def q_stream_rejects(spark, sf):
    """K1 with counted rejects: two files of lines, some spoiled, a micro-batch each."""
    ensure_utc(spark)
    src, out, side = _scratch(spark, "spoiled-in"), _scratch(spark, "spoiled-out"), _scratch(spark, "spoiled-rejects")
    lines = spoiled_lines(spark, sf, keep_seq=True)
    for half in (0, 1):
        lines.where(F.col("seq") % 2 == half).select("value").coalesce(1).write.text(f"{src}/{half}")
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", "1").load(f"{src}/*")
    jobs.start_journal_ingest(lines, NOW, out, side).awaitTermination()
    stored = spark.read.parquet(out).count()
    return jobs.read_ingest_counts(spark, side).select("lines", "accepted", "not_json", "bad_clock", F.lit(stored).cast("long").alias("stored"))


@register("stream_timechart_merged", with_ctes(
    "SELECT date_trunc('minute', \"timestamp\") AS time_bin, COALESCE(priority, 6) AS priority, "
    + LEVEL_SQL.format(p="COALESCE(priority, 6)") + " AS level, COUNT(*) AS count FROM journal_logs GROUP BY 1, 2", JOURNAL_CTE))
def q_stream_timechart_merged(spark, sf):
    """K3 over ten micro-batches whose count files are merged on the way."""
    src, out = _scratch(spark, "chart-in"), _scratch(spark, "chart-out")
    events = tables.read_events(spark, sf)
    for i in range(10):
        events.where(F.col("event_id") % 10 == i).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{src}/*")
    jobs.start_live_timechart(journal_logs_from_events(stream), out).awaitTermination()
    return jobs.read_live_timechart(spark, out)

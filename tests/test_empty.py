"""The composite queries (I1-I9) on empty tables: they run, keep their shape,
and report zero / NULL, like the reference's endpoint tests on an empty
database."""

from datetime import datetime

from logtide.operators import charts, ingest, processes, search, stats
from logtide.schemas import JOURNAL_SCHEMA, PROCESS_SCHEMA

NOW = datetime(2026, 1, 17, 15, 0)


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_search_and_page(spark):
    logs = _empty(spark, JOURNAL_SCHEMA)
    assert search.search(logs, NOW, q="x", hostname="h", unit="u", priority=3).count() == 0
    rows, state = search.search_page(logs, NOW, limit=50, offset=10)
    s = state.first()
    assert rows.count() == 0 and (s.total, s.returned, s.state, s.next_offset) == (0, 0, "none", None)


def test_timechart_and_pivot(spark):
    logs = _empty(spark, JOURNAL_SCHEMA)
    chart = charts.timechart(logs, NOW)
    assert chart.columns == ["time_bin", "priority", "level", "count"] and chart.count() == 0
    assert charts.timechart_stacked(charts.timechart_pivot(chart)).count() == 0


def test_filters_columns_status(spark):
    logs = _empty(spark, JOURNAL_SCHEMA)
    hosts, units, sev = stats.filters(logs)
    assert hosts.count() == 0 and units.count() == 0
    assert [r["count"] for r in sev.collect()] == [0] * 8
    prof = stats.column_profile(logs).collect()
    assert len(prof) == 73 and {r.non_null for r in prof} == {0}
    st = stats.status(logs).first()
    assert (st.total_entries, st.buffered_minutes, st.oldest_minute, st.stored_bytes) == (0, 0, None, 0)


def test_storage_and_processes(spark):
    logs, procs = _empty(spark, JOURNAL_SCHEMA), _empty(spark, PROCESS_SCHEMA)
    h = stats.storage_health(logs, procs).first()
    assert (h.journal_log_count, h.process_metric_count, h.oldest_log_timestamp, h.status) == (0, 0, None, "good")
    assert processes.latest_processes(procs).count() == 0
    assert processes.process_table(procs, q="x").count() == 0


def test_field_accessor(spark):
    e = spark.createDataFrame([({"MESSAGE": "m", "_PID": "7"},)], "fields map<string,string>")
    r = e.select(ingest.field("MESSAGE").alias("m"), ingest.field("_PID").alias("p"),
                 ingest.field("NOPE").alias("n")).first()
    assert (r.m, r.p, r.n) == ("m", "7", None)


def test_checkpoint_folder_comes_from_the_session(spark):
    from logtide.session import checkpoint_dir

    configured = spark.sparkContext.getCheckpointDir()
    assert configured and checkpoint_dir(spark) == configured

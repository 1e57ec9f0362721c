"""Timechart, pivot, stack; filter values, severity counts, column profile,
storage statistics and health."""

from datetime import datetime, timedelta

from logtide.functions.columns import PRIORITY_LABELS
from logtide.operators import charts, stats
from tests.helpers import typed

NOW = datetime(2026, 1, 17, 15, 0)
T0 = datetime(2026, 1, 17, 14, 0)


def _logs(spark):
    rows = [
        (T0 + timedelta(seconds=5), {"PRIORITY": "3", "_HOSTNAME": "h1", "_SYSTEMD_UNIT": "a"}),
        (T0 + timedelta(seconds=50), {"PRIORITY": "3", "_HOSTNAME": "h2"}),
        (T0 + timedelta(seconds=59), {"_HOSTNAME": "h1"}),  # NULL priority -> Info (6)
        (T0 + timedelta(minutes=1), {"PRIORITY": "9"}),  # Unknown
        (T0 + timedelta(minutes=1, seconds=1), {"PRIORITY": "6", "_SYSTEMD_UNIT": "b"}),
        (T0 + timedelta(minutes=2), {"PRIORITY": "0"}),
    ]
    return typed(spark, rows, now=NOW)


def test_timechart_bins_and_levels(spark):
    rows = charts.timechart(_logs(spark), NOW, start="-2h").collect()
    got = [(r.time_bin.minute, r.priority, r.level, r["count"]) for r in rows]
    assert got == [(0, 3, "Error", 2), (0, 6, "Info", 1), (1, 6, "Info", 1), (1, 9, "Unknown", 1),
                   (2, 0, "Emergency", 1)]


def test_timechart_pivot_folds_unknown_into_info(spark):
    piv = charts.timechart_pivot(charts.timechart(_logs(spark), NOW, start="-2h"))
    assert piv.columns == ["time_bin", *PRIORITY_LABELS]
    rows = piv.collect()
    assert [r.Info for r in rows] == [1, 2, 0]
    assert [r.Error for r in rows] == [2, 0, 0]


def test_timechart_stacked(spark):
    piv = charts.timechart_pivot(charts.timechart(_logs(spark), NOW, start="-2h"))
    st = charts.timechart_stacked(piv).filter("level in ('Error', 'Info')").orderBy("time_bin", "level_order").collect()
    first = [(r.level, r.lower, r.upper) for r in st[:2]]
    assert first == [("Error", 0, 2), ("Info", 2, 3)]
    assert {r.max_stack for r in st} == {3}


def test_filter_values_and_severity_counts(spark):
    df = _logs(spark)
    assert [r.value for r in stats.filter_values(df, "_HOSTNAME").collect()] == ["h1", "h2"]
    assert [r.value for r in stats.filter_values(df, "_SYSTEMD_UNIT").collect()] == ["a", "b"]
    sev = stats.severity_counts(df).collect()
    assert [r.label for r in sev][:2] == ["0 - Emergency", "1 - Alert"]
    assert [r["count"] for r in sev] == [1, 0, 0, 2, 0, 0, 1, 0]


def test_column_profile(spark):
    prof = {r.name: r for r in stats.column_profile(_logs(spark)).collect()}
    assert "__CURSOR" not in prof and "minute_key" not in prof and "__MONOTONIC_TIMESTAMP" not in prof
    assert prof["priority"].non_null == 5 and prof["priority"].is_default
    assert prof["_HOSTNAME"].is_default and not prof["message_id"].is_default
    assert prof["timestamp"].column_type == "TIMESTAMP_NTZ"
    assert len(prof) == 73


def test_storage_stats_and_health(spark):
    logs = _logs(spark)
    procs = spark.createDataFrame([(NOW, 1)], "timestamp timestamp_ntz, pid int")
    s = stats.storage_stats(logs, procs).first()
    assert (s.journal_log_count, s.process_metric_count) == (6, 1)
    assert s.oldest_log_timestamp == T0 + timedelta(seconds=5)
    h = stats.storage_health(logs, procs, database_size_bytes=int(0.80 * 1024**3)).first()
    assert (h.size_gb, h.usage_percent, h.status) == (0.8, 80.0, "warning")
    h = stats.storage_health(logs, procs, database_size_bytes=int(0.95 * 1024**3)).first()
    assert h.status == "critical"
    h = stats.storage_health(logs, procs, database_size_bytes=1000).first()
    assert h.status == "good" and h.size_gb == 0.0


def test_minute_counts(spark):
    df = _logs(spark)
    assert stats.count_by_minute(df, T0).first()["count"] == 3
    assert stats.distinct_minutes(df).count() == 3
    b = stats.minute_bounds(df).first()
    assert (b.oldest_minute, b.newest_minute) == ("2026-01-17T14:00:00+00:00", "2026-01-17T14:02:00+00:00")

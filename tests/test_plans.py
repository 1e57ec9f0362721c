"""Physical-plan properties that the design relies on at scale: pushdown,
partition pruning, column pruning, map-side partial aggregation, bounded
broadcasts, no joins for the latest snapshot."""

from datetime import datetime

import pytest

from logtide.operators import charts, maintenance, processes, search, stats
from logtide.sources import tables
from tests.conftest import SF001

NOW = datetime(2024, 1, 31)


def _plan(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")  # scan metadata untruncated
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("stored"))
    maintenance.write_logs(tables.journal_logs(spark, SF001), f"{base}/logs")
    maintenance.write_process_metrics(tables.process_metrics(spark, SF001), f"{base}/procs")
    return base


def test_search_prunes_dates_pushes_time_and_columns(spark, stored):
    logs = tables.read_logs(spark, f"{stored}/logs")
    plan = _plan(search.search(logs, NOW, start="-2d", q="user", hostname="host-1"))
    assert "PartitionFilters: [isnotnull(date" in plan and "(date#" in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan
    assert "In(_HOSTNAME" in plan or "EqualTo(_HOSTNAME" in plan
    assert "_UID" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in plan


def test_timechart_aggregates_map_side(spark, stored):
    logs = tables.read_logs(spark, f"{stored}/logs")
    plan = _plan(charts.timechart(logs, NOW, start="-7d"))
    assert "partial_count" in plan


def test_latest_snapshot_is_a_pruned_scan_not_a_join(spark, stored):
    procs = tables.read_process_metrics(spark, f"{stored}/procs")
    plan = _plan(processes.latest_processes(procs))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "EqualTo(timestamp" in plan


def test_severity_counts_broadcasts_bounded_side(spark, stored):
    logs = tables.read_logs(spark, f"{stored}/logs")
    plan = _plan(stats.severity_counts(logs))
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan


def test_dedupe_combines_before_the_shuffle(spark):
    from logtide.operators.processes import dedupe_samples, to_process_metrics

    plan = _plan(dedupe_samples(to_process_metrics(tables.raw_samples(spark, SF001)), "seq"))
    assert "partial_min_by" in plan


def test_journal_lines_are_parsed_once(spark, tmp_path_factory):
    from logtide.sources import journal as J

    path = str(tmp_path_factory.mktemp("lines")) + "/lines"
    tables.raw_journal_lines(spark, SF001).write.text(path)
    plan = _plan(J.read_journal_typed(spark, path, NOW))
    assert plan.count("from_json(") == 1


def test_write_layout_is_range_partitioned_and_time_sorted(spark):
    from logtide.operators.maintenance import _write_layout

    plan = _plan(_write_layout(tables.journal_logs(spark, SF001)))
    assert "rangepartitioning(date" in plan and "timestamp" in plan.split("rangepartitioning(")[1].split(")")[0]
    assert "Sort [date" in plan


def test_time_windows_open_their_dates_only(spark, stored):
    from datetime import timedelta

    from logtide.operators.ranking import rank_slice
    from logtide.sources import journal as J

    logs = tables.read_logs(spark, f"{stored}/logs")
    frames = [J.at_timestamp(logs, datetime(2024, 1, 9, 1, 2, 3)), J.skip_older_than(logs, NOW - timedelta(days=3))[0], J.skip_older_than(logs, NOW - timedelta(days=3))[1],
              maintenance.retain_by_age(logs, NOW, 5)[0], maintenance.retain_by_age(logs, NOW, 5)[1], maintenance.retain_by_size(logs, 60_000)[0],
              maintenance.drop_oldest_tenth(logs)[1], J.backfill(logs, 60_000), J.recent_history(logs, NOW, NOW - timedelta(days=1)), rank_slice(logs, 100, 300, small=0, tiebreak="__CURSOR")]
    for df in frames:
        scans = [line for line in _plan(df).split("\n") if "FileScan" in line or "Scan parquet" in line]
        assert scans and all("PartitionFilters: [isnotnull(date" in s for s in scans)


def test_health_with_a_known_size_reads_no_text(spark, stored):
    for df in (stats.stored_health(spark, f"{stored}/logs", f"{stored}/procs"), stats.stored_status(spark, f"{stored}/logs")):
        plan = _plan(df)
        assert "message" not in plan and "extra_fields" not in plan and "cmdline" not in plan
    assert stats.stored_health(spark, f"{stored}/logs", f"{stored}/procs").first().database_size_bytes > 10_000


def test_oldest_tenth_keeps_its_own_dates_and_rows_without_time(spark, stored):
    kept, _ = maintenance.drop_oldest_tenth(tables.read_logs(spark, f"{stored}/logs"))
    scan = next(line for line in _plan(kept).split("\n") if "FileScan" in line)
    assert "PartitionFilters: [((date" in scan or "PartitionFilters: [(isnull(date" in scan or ">= 2024" in scan.split("PushedFilters")[0]


def test_overflow_fields_share_a_projection_with_the_columns(spark):
    from logtide.operators import ingest
    from logtide.sources import journal as J

    plan = _plan(ingest.parse_entries(J.parse_lines(tables.raw_journal_lines(spark, SF001)), NOW))
    assert "_common_expr" not in plan and plan.count("map_filter(") == 1

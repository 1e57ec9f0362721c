"""Retention, the oldest-tenth cut, size budgets (checked against brute force),
stored-table jobs (append, date rewrite, age retention, compaction), schema
conform."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F
from hypothesis import strategies as st

from logtide.functions.columns import row_bytes, ts_literal
from logtide.operators import maintenance as M
from logtide.schemas import PROCESS_SCHEMA, PROCESS_SCHEMA_V1
from logtide.sources import journal as J
from logtide.sources import tables

T0 = datetime(2026, 1, 1)


def _frame(spark, stamps):
    rows = [(t, f"c-{i:05d}", "x" * (i % 7)) for i, t in enumerate(stamps)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, __CURSOR string, message string")


@pytest.mark.parametrize("n,k", [(5, 0), (6, 1), (15, 2), (25, 2), (35, 4), (10, 1)])
def test_oldest_tenth_rounds_half_to_even(spark, n, k):
    df = _frame(spark, [T0 + timedelta(seconds=i) for i in range(n)])
    kept, rep = M.drop_oldest_tenth(df)
    assert rep.first().deleted == k and kept.count() == n - k


def test_oldest_tenth_ties_all_go(spark):
    stamps = [T0] * 3 + [T0 + timedelta(seconds=1)] * 7
    kept, rep = M.drop_oldest_tenth(_frame(spark, stamps))  # k = 1, but all three at T0 go
    assert rep.first().deleted == 3 and kept.count() == 7


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=3 * 86_400_000_000), min_size=1, max_size=40),
       st.integers(min_value=1, max_value=40))
def test_kth_smallest_matches_sort(spark, offsets, k):
    k = min(k, len(offsets))
    stamps = [T0 + timedelta(microseconds=o) for o in offsets]
    got = M.kth_smallest_timestamp(_frame(spark, stamps), k)
    assert got == sorted(stamps)[k - 1]


def _brute_size_keep(pdf, budget):
    """Keep newest instants while cumulative bytes (incl. the instant) <= budget; the newest for any budget."""
    per = pdf.groupby("timestamp")["bytes"].sum().sort_index(ascending=False)
    keep, cum = set(), 0
    for instant, b in per.items():
        cum += b
        if cum <= budget or (not keep and 0 < budget):
            keep.add(instant)
    return sorted(pdf[pdf.timestamp.isin(keep)]["__CURSOR"])


def _brute_backfill(pdf, budget):
    per = pdf.groupby("timestamp")["bytes"].sum().sort_index(ascending=False)
    keep, newer = set(), 0
    for instant, b in per.items():
        if newer < budget:
            keep.add(instant)
        newer += b
    return sorted(pdf[pdf.timestamp.isin(keep)]["__CURSOR"])


def test_size_budgets_match_brute_force(spark):
    rnd = random.Random(7)
    stamps = [T0 + timedelta(seconds=rnd.randint(0, 3600)) for _ in range(300)]
    df = _frame(spark, stamps)
    pdf = df.select("__CURSOR", "timestamp", row_bytes(df).alias("bytes")).toPandas()
    total = int(pdf["bytes"].sum())
    for budget in [0, 50, total // 3, total // 2, total, total * 2]:
        kept, rep = M.retain_by_size(df, budget)
        assert sorted(r["__CURSOR"] for r in kept.collect()) == _brute_size_keep(pdf, budget)
        assert rep.first().deleted == len(stamps) - kept.count()
        got = sorted(r["__CURSOR"] for r in J.backfill(df, budget).collect())
        assert got == _brute_backfill(pdf, budget)


def test_retention_report(spark):
    now = datetime(2026, 3, 1)
    logs = _frame(spark, [now - timedelta(days=d) for d in (40, 35, 2, 1)])
    procs = spark.createDataFrame([(now - timedelta(days=d), 1) for d in (10, 3)], "timestamp timestamp_ntz, pid int")
    r = M.retention_report(logs, procs, now, 30, None, 7, None).first()
    assert (r.logs_deleted_by_time, r.logs_deleted_by_size, r.processes_deleted_by_time,
            r.processes_deleted_by_size, r.total_deleted) == (2, 0, 1, 0, 3)
    r = M.retention_report(logs, procs, now, 30, 0, 7, 10**9).first()
    assert (r.logs_deleted_by_size, r.total_deleted) == (2, 5)


def test_conform_adds_typed_nulls(spark):
    v1 = spark.createDataFrame([(T0, 1, "n", 1.0, 2.0, "u", 3)], PROCESS_SCHEMA_V1)
    out = M.conform(v1, PROCESS_SCHEMA)
    assert out.dtypes == [(f.name, f.dataType.simpleString()) for f in PROCESS_SCHEMA.fields]
    assert out.columns == [f.name for f in PROCESS_SCHEMA.fields]
    r = out.first()
    assert r.cmdline is None and r.parent_pid is None and r.pid == 1


def test_stored_table_jobs(spark, tmp_dir):
    logs = tables.journal_logs(spark, "/root/testdata/sf0.001")
    path = f"{tmp_dir}/logs"
    M.write_logs(logs, path)
    stored = tables.read_logs(spark, path)
    n = logs.count()
    assert stored.count() == n
    dates = sorted(r.date for r in stored.select("date").distinct().collect())
    # age retention: whole dates dropped by partition, the edge date rewritten
    now = datetime(2024, 1, 31)
    removed = M.apply_retention_by_age(spark, path, now, 10)
    expect_removed = logs.filter(logs.timestamp < ts_literal(datetime(2024, 1, 21))).count()
    assert removed == expect_removed
    after = tables.read_logs(spark, path)
    assert after.count() == n - expect_removed
    assert after.agg({"timestamp": "min"}).first()[0] >= datetime(2024, 1, 21)
    # compaction keeps every row and leaves one file per date
    last = max(dates)
    before = after.filter(after.date == last).count()
    assert M.compact(spark, path, [last], 1) == before
    assert tables.read_logs(spark, path).filter(f"date = '{last}'").count() == before
    import glob

    assert len(glob.glob(f"{path}/date={last}/*.parquet")) == 1


def test_stored_table_delete_size_clear_and_scheduled_run(spark, tmp_dir):
    from logtide.operators.stats import buffer_stats

    logs = tables.journal_logs(spark, "/root/testdata/sf0.001")
    procs = tables.process_metrics(spark, "/root/testdata/sf0.001")
    lp, pp = f"{tmp_dir}/logs", f"{tmp_dir}/procs"
    M.write_logs(logs, lp)
    M.write_process_metrics(procs, pp)
    n = logs.count()

    first_minute = tables.read_logs(spark, lp).agg({"timestamp": "min"}).first()[0].replace(second=0, microsecond=0)
    in_minute = logs.filter(logs.minute_key == first_minute.strftime("%Y-%m-%dT%H:%M:00+00:00")).count()
    assert M.apply_delete_minute(spark, lp, first_minute) == in_minute >= 1
    assert tables.read_logs(spark, lp).count() == n - in_minute

    stored = tables.read_logs(spark, lp).drop("date")
    budget = 60_000
    kept_df, _ = M.retain_by_size(stored, budget)
    expect_kept = kept_df.count()
    removed = M.apply_retention_by_size(spark, lp, budget)
    assert removed == n - in_minute - expect_kept
    assert tables.read_logs(spark, lp).count() == expect_kept

    rep = M.run_retention(spark, lp, pp, datetime(2024, 1, 31), 3, 10**9, 7, 0).first()
    procs_n = procs.count()
    assert rep.processes_deleted_by_time + rep.processes_deleted_by_size == procs_n
    after_procs = tables.read_process_metrics(spark, pp).count()
    assert after_procs == 0  # a zero budget keeps nothing
    assert rep.total_deleted == (rep.logs_deleted_by_time + rep.logs_deleted_by_size
                                 + rep.processes_deleted_by_time + rep.processes_deleted_by_size)

    M.clear_table(spark, lp)
    assert tables.read_logs(spark, lp).count() == 0
    assert buffer_stats(tables.read_logs(spark, lp)).first().total_entries == 0


def test_stored_size_cutoff_matches_whole_table_rule(spark, tmp_dir):
    logs = tables.journal_logs(spark, "/root/testdata/sf0.001")
    path = f"{tmp_dir}/logs"
    M.write_logs(logs, path)
    table = spark.read.parquet(path)
    for budget in [0, 1, 5_000, 60_000, 250_000, 10**9]:
        whole = M.size_cutoff(table.drop("date"), budget).first()["_keep_from"]
        assert M.stored_size_cutoff(table, budget) == whole
        kept = sorted(r["__CURSOR"] for r in M.retain_by_size(table.drop("date"), budget)[0].collect())
        assert kept == sorted(r["__CURSOR"] for r in M.retain_by_size(table, budget)[0].collect())
        loaded = sorted(r["__CURSOR"] for r in J.backfill(logs, budget).collect())
        assert loaded == sorted(r["__CURSOR"] for r in J.backfill(table, budget).collect())


def test_a_heavy_newest_minute_does_not_empty_a_table(spark, tmp_dir):
    start = datetime(2026, 1, 20, 12, 0, 0)
    logs = _frame(spark, [start + timedelta(milliseconds=i) for i in range(1000)])
    path = f"{tmp_dir}/logs"
    M.write_logs(logs, path)
    one = logs.agg(F.max(row_bytes(logs))).first()[0]
    assert M.apply_retention_by_size(spark, path, 100 * one) <= 900
    left = spark.read.parquet(path)
    assert 100 <= left.count() < 1000 and left.agg(F.sum(row_bytes(left, exclude=("date",)))).first()[0] <= 100 * one
    M.apply_retention_by_size(spark, path, 1)
    assert spark.read.parquet(path).count() == 1  # the newest instant


def _append_between(monkeypatch, spark, path, rows):
    """Appends `rows` after a job has written its replacement and before it exchanges files."""
    from logtide.sources.files import TableFiles

    note = TableFiles.note

    def later(self, name, old):
        M.write_logs(rows, path)
        note(self, name, old)

    monkeypatch.setattr(TableFiles, "note", later)


def test_rows_appended_during_a_rewrite_stay(spark, tmp_dir, monkeypatch):
    import glob

    path = f"{tmp_dir}/logs"
    M.write_logs(_frame(spark, [T0 + timedelta(seconds=i) for i in range(50)]), path)
    late = _frame(spark, [T0 + timedelta(milliseconds=500 + i) for i in range(7)])
    _append_between(monkeypatch, spark, path, late)
    day = T0.date()
    assert M.compact(spark, path, [day]) == 50
    assert spark.read.parquet(path).count() == 57
    assert M.delete_before(spark, path, T0 + timedelta(hours=1)) == 57 and spark.read.parquet(path).count() == 7
    assert not (glob.glob(f"{path}/_stage*") + glob.glob(f"{path}/_replace*"))  # nothing staged is left behind


def test_a_failed_exchange_is_finished_by_the_next_job(spark, tmp_dir, monkeypatch):
    import glob

    from logtide.sources.files import TableFiles

    path = f"{tmp_dir}/logs"
    M.write_logs(_frame(spark, [T0 + timedelta(seconds=i) for i in range(120)]), path)
    want = sorted(r["__CURSOR"] for r in spark.read.parquet(path).where("date is not null").collect())

    def fail(self, files):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(TableFiles, "delete", fail)
        try:
            M.compact(spark, path, [T0.date()])
        except OSError:
            pass
    assert spark.read.parquet(path).count() >= 120  # doubled, never short
    assert TableFiles(spark, path).recover() == 1
    assert sorted(r["__CURSOR"] for r in spark.read.parquet(path).collect()) == want
    assert not (glob.glob(f"{path}/_stage*") + glob.glob(f"{path}/_replace*"))


def test_written_files_are_time_ordered_and_compaction_splits_dates(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq

    logs = tables.journal_logs(spark, "/root/testdata/sf0.001")
    path = f"{tmp_dir}/logs"
    M.write_logs(logs.repartition(3), path)
    for f in glob.glob(f"{path}/date=*/*.parquet"):
        ts = pq.read_table(f, columns=["timestamp"]).column(0).to_pylist()
        assert ts == sorted(ts)
    dates = sorted(r.date for r in tables.read_logs(spark, path).select("date").distinct().collect())[:2]
    n = tables.read_logs(spark, path).filter(F.col("date").isin([str(d) for d in dates])).count()
    assert M.compact(spark, path, dates, files_per_date=2) == n
    for d in dates:
        files = glob.glob(f"{path}/date={d}/*.parquet")
        assert 1 <= len(files) <= 2
        for f in files:
            ts = pq.read_table(f, columns=["timestamp"]).column(0).to_pylist()
            assert ts == sorted(ts)
    assert tables.read_logs(spark, path).count() == logs.count()


def test_tasks_hold_a_bounded_part_of_a_large_date(spark, tmp_dir, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    # one moment, other ids: neither dates nor times can part the rows
    logs = tables.journal_logs(spark, "/root/testdata/sf0.001").drop("timestamp").withColumn("timestamp", F.lit("2024-01-03 10:00:00").cast("timestamp_ntz"))
    n = logs.count()
    want = sorted(r["__CURSOR"] or "" for r in logs.collect())
    size = M.with_date(logs).agg(M._memory(M.with_date(logs))).first()[0]
    monkeypatch.setattr(M, "FILE_BYTES", size // 40)
    path = f"{tmp_dir}/logs"
    rows_of = lambda: [pq.read_metadata(f).num_rows for f in glob.glob(f"{path}/date=*/*.parquet")]
    M.write_logs(logs, path)
    assert sum(rows_of()) == n and max(rows_of()) < n / 5
    assert M.compact(spark, path, ["2024-01-03"], 1) == n
    assert sum(rows_of()) == n and max(rows_of()) < n / 5 and 30 < len(rows_of()) <= 41
    assert sorted(r["__CURSOR"] or "" for r in tables.read_logs(spark, path).collect()) == want
    monkeypatch.setattr(M, "FILE_BYTES", 128 << 20)
    assert M.compact(spark, path, ["2024-01-03"], 1) == n and rows_of() == [n]

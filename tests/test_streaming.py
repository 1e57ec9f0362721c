"""Structured Streaming jobs: live timechart against the batch answer over
closed bins, late rows beyond the watermark, log ingest, sample de-duplication."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from logtide.functions.columns import ts_literal
from logtide.operators import charts
from logtide.sources import journal as J
from logtide.sources import samples as S
from logtide.sources import tables
from logtide.sources.derived import journal_logs_from_events
from logtide.streaming import jobs
from tests.conftest import SF001

NOW = datetime(2024, 1, 31)


def _copy_events(spark, folder):
    """A fresh input folder holding the events table (as the stream's first file)."""
    tables.read_table(spark, SF001, "events").coalesce(1).write.parquet(f"{folder}/part0")
    return tables.read_table(spark, SF001, "events").schema


def test_live_timechart_matches_batch_on_closed_bins_and_drops_late_rows(spark, tmp_dir):
    src = f"{tmp_dir}/events"
    schema = _copy_events(spark, src)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    chart = jobs.live_timechart(journal_logs_from_events(stream), "10 minutes")
    out = f"{tmp_dir}/chart"

    def run():
        q = (chart.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(out)

    got = run()
    batch = charts.timechart(tables.journal_logs(spark, SF001), NOW, start="-40d")
    max_ts = tables.read_table(spark, SF001, "events").agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("time_bin") + F.expr("INTERVAL 1 MINUTE") <= ts_literal(max_ts - timedelta(minutes=10)))
    key = ["time_bin", "priority", "level", "count"]
    a = got.select(*key).toPandas().sort_values(key).reset_index(drop=True)
    b = closed.select(*key).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    first_run = a

    # second file: one row far ahead (moves the watermark), one far behind it (late, dropped)
    late = spark.createDataFrame(
        [(900001, max_ts + timedelta(minutes=30), 1, "error", 1.0, '{"k": 1}'),
         (900002, datetime(2024, 1, 1, 0, 0, 30), 1, "error", 1.0, '{"k": 1}')], schema)
    late.coalesce(1).write.parquet(f"{src}/part1")
    both = run().select(*key).toPandas()
    early = both[both.time_bin == pd.Timestamp("2024-01-01 00:00:00")]
    assert early["count"].sum() == first_run[first_run.time_bin == pd.Timestamp("2024-01-01 00:00:00")]["count"].sum()
    # every batch bin is emitted now: the bins left open by the first run were closed by the new watermark
    full = batch.select(*key).toPandas()
    assert len(both) == len(full)


def test_log_ingest_stream_matches_batch(spark, tmp_dir):
    src = f"{tmp_dir}/journal"
    tables.raw_journal_lines(spark, SF001).write.text(src)
    out = f"{tmp_dir}/logs"
    q = jobs.start_log_ingest(J.stream_journal(spark, src), NOW, out, checkpoint=f"{tmp_dir}/ckpt")
    q.awaitTermination()
    streamed = spark.read.parquet(out)
    batch = J.read_journal_typed(spark, src, NOW)
    cols = ["__CURSOR", "timestamp", "priority", "extra_fields"]
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert streamed.count() == batch.count() == 1000
    # rerun: the checkpoint has consumed every file, nothing is appended twice
    q = jobs.start_log_ingest(J.stream_journal(spark, src), NOW, out, checkpoint=f"{tmp_dir}/ckpt")
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 1000


def test_sample_stream_dedupes_within_watermark(spark, tmp_dir):
    src = f"{tmp_dir}/samples"
    raw = tables.raw_samples(spark, SF001)
    raw.drop("seq").write.json(src)
    out = f"{tmp_dir}/procs"
    q = jobs.start_sample_ingest(S.stream_process_samples(spark, src), out, checkpoint=f"{tmp_dir}/ckpt")
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == raw.select("timestamp", "pid").distinct().count()
    assert got.groupBy("timestamp", "pid").count().filter("count > 1").count() == 0


def test_follow_from_tail(spark, tmp_dir):
    stored = tables.journal_logs(spark, SF001)
    start = J.tail_start(stored, 50)
    newest = stored.orderBy(F.col("timestamp").desc()).limit(50).agg(F.min("timestamp")).first()[0]
    assert start == newest
    src = f"{tmp_dir}/journal"
    tables.raw_journal_lines(spark, SF001).write.text(src)
    typed = jobs.typed_log_stream(J.stream_journal(spark, src), NOW)
    out = f"{tmp_dir}/followed"
    jobs.run_to_table(J.follow_from(typed, start), out, f"{tmp_dir}/ckpt")
    got = spark.read.parquet(out)
    batch = J.read_journal_typed(spark, src, NOW)  # same lines; entries without a clock get NOW
    assert got.count() == batch.filter(F.col("timestamp") >= ts_literal(start)).count() >= 50
    assert J.tail_start(stored, 10**6) is None


def test_sample_dedupe_across_micro_batches(spark, tmp_dir):
    raw = tables.raw_samples(spark, SF001).drop("seq")
    src = f"{tmp_dir}/samples"
    first = raw.filter(F.col("pid") % 2 == 0)
    first.coalesce(1).write.json(f"{src}/a")
    # a later file repeats every (timestamp, pid) of the first one, plus new samples
    raw.coalesce(1).write.json(f"{src}/b")
    stream = (spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", "1")
              .option("recursiveFileLookup", "true").json(src))
    out = f"{tmp_dir}/procs"
    q = jobs.start_sample_ingest(stream, out, checkpoint=f"{tmp_dir}/ckpt", watermark="7 days")
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert q.lastProgress is not None
    assert got.groupBy("timestamp", "pid").count().filter("count > 1").count() == 0
    assert got.count() == raw.select("timestamp", "pid").distinct().count()


def test_stream_and_batch_jobs_share_one_table(spark, tmp_dir):
    from logtide.operators import maintenance as M

    table = f"{tmp_dir}/logs"
    batch_part = tables.journal_logs(spark, SF001).filter(F.col("__SEQNUM") < 500)
    M.write_logs(batch_part, table)
    src = f"{tmp_dir}/journal"
    tables.raw_journal_lines(spark, SF001).write.text(src)
    q = jobs.start_log_ingest(J.stream_journal(spark, src), NOW, table, checkpoint=f"{tmp_dir}/ckpt")
    q.awaitTermination()
    both = tables.read_logs(spark, table)
    assert both.count() == 500 + 1000  # batch rows and streamed rows are all visible
    removed = M.apply_retention_by_age(spark, table, NOW, 10)
    left = tables.read_logs(spark, table)
    assert left.count() == 1500 - removed and left.filter(F.col("timestamp") < ts_literal(datetime(2024, 1, 21))).count() == 0
    dates = [r.date for r in left.select("date").distinct().collect()][:3]
    M.compact(spark, table, dates, 1)
    assert tables.read_logs(spark, table).count() == 1500 - removed


def test_replayed_micro_batch_is_not_appended_twice(spark, tmp_dir):
    from logtide.operators.maintenance import write_logs

    run = jobs._append_once(write_logs, f"{tmp_dir}/logs", f"{tmp_dir}/ckpt")
    batch = tables.journal_logs(spark, SF001).limit(10)
    run(batch, 7)
    run(batch, 7)  # a replay of the same epoch after a restart
    assert spark.read.parquet(f"{tmp_dir}/logs").count() == 10
    run(batch, 8)
    assert spark.read.parquet(f"{tmp_dir}/logs").count() == 20


def test_late_samples_are_kept_and_stored_keys_are_not_repeated(spark, tmp_dir):
    raw = tables.raw_samples(spark, SF001).drop("seq")
    one = raw.limit(1)

    def at(minute, folder):
        stamp = datetime(2024, 1, 1, 0, minute)
        one.withColumn("timestamp", ts_literal(stamp, ntz=False)).coalesce(1).write.mode("append").json(f"{tmp_dir}/in/{folder}")

    stream = lambda: spark.readStream.schema(raw.schema).option("recursiveFileLookup", "true").json(f"{tmp_dir}/in")
    out = f"{tmp_dir}/procs"
    # files out of time order, one run each, then a repeat of a stored key
    for n, minute in enumerate((10, 5, 11, 5)):
        at(minute, n)
        jobs.start_sample_ingest(stream(), out).awaitTermination()
    got = sorted(r.timestamp.minute for r in tables.read_process_metrics(spark, out).collect())
    assert got == [5, 10, 11]
    # a second stream of the same files adds nothing either
    jobs.start_sample_ingest(stream(), out, checkpoint=f"{tmp_dir}/other").awaitTermination()
    assert tables.read_process_metrics(spark, out).count() == 3


def test_replay_after_a_half_finished_append(spark, tmp_dir):
    import glob
    import os
    import shutil

    from logtide.operators.maintenance import write_logs

    run = jobs._append_once(write_logs, f"{tmp_dir}/logs", f"{tmp_dir}/ckpt")
    batch = tables.journal_logs(spark, SF001)
    run(batch, 0)
    run(batch.limit(5), 1)
    # as if the driver was lost half way: some of the epoch's files are gone, a staging folder is left
    files = sorted(glob.glob(f"{tmp_dir}/logs/date=*/epoch-*-0-*"))
    for f in files[: len(files) // 2]:
        shutil.move(f, f"{tmp_dir}/aside-{os.path.basename(f)}")
    os.makedirs(f"{tmp_dir}/logs/_stage-x")
    run(batch, 0)
    assert spark.read.parquet(f"{tmp_dir}/logs").count() == 1005


def test_live_counts_hold_open_bins_and_late_rows(spark, tmp_dir):
    src = f"{tmp_dir}/events"
    schema = _copy_events(spark, src)
    stream = lambda: journal_logs_from_events(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src))
    jobs.start_live_timechart(stream(), f"{tmp_dir}/chart").awaitTermination()
    jobs.start_live_summary(stream(), "journal", f"{tmp_dir}/summary").awaitTermination()
    late = spark.createDataFrame([(900002, datetime(2024, 1, 1, 0, 0, 30), 1, "error", 1.0, '{"k": 1}')], schema)
    late.coalesce(1).write.parquet(f"{src}/part1")
    jobs.start_live_timechart(stream(), f"{tmp_dir}/chart").awaitTermination()
    jobs.start_live_summary(stream(), "journal", f"{tmp_dir}/summary").awaitTermination()
    whole = journal_logs_from_events(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(src))
    key = ["time_bin", "priority", "level", "count"]
    chart = charts.timechart(whole, NOW, start="-40d").select(*key)
    live = jobs.read_live_timechart(spark, f"{tmp_dir}/chart").select(*key)
    assert live.exceptAll(chart).count() == 0 == chart.exceptAll(live).count()
    summary = jobs.read_live_summary(spark, f"{tmp_dir}/summary")
    assert summary.agg(F.sum("rows")).first()[0] == whole.count()


def test_checkpoints_follow_the_output(spark):
    assert jobs._checkpoint("/a/logs/", None) != jobs._checkpoint("/a/procs", None) and jobs._checkpoint("/a", "/b") == "/b"

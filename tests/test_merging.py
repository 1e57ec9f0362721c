"""Merging of live counts: bounded files, equal answers before, during and after, death in between."""

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logtide.sources.files import TableFiles
from logtide.streaming import jobs, merging

T0 = datetime(2026, 1, 1)
KEYS = ("bin", "priority")


def _parts(spark, path, batches, start=0):
    """One small count file a batch, written as the stream's epochs are."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    for b in range(start, start + batches):
        day = (T0 + timedelta(days=b % 2)).date().isoformat()
        os.makedirs(f"{path}/date={day}", exist_ok=True)
        bins = [T0 + timedelta(days=b % 2, minutes=m) for m in range(3)]
        table = pa.table({"bin": pa.array(bins, pa.timestamp("us")), "priority": pa.array([b % 8] * 3, pa.int32()), "n": pa.array([b, 1, 2], pa.int64())})
        pq.write_table(table, f"{path}/date={day}/epoch-run-{b}-part-0.parquet")


def _chart(spark, path):
    return sorted(map(tuple, jobs.read_live_timechart(spark, path).collect()))


def test_many_batches_leave_few_files(spark, tmp_dir):
    path = f"{tmp_dir}/chart"
    _parts(spark, path, 300)
    want = _chart(spark, path)
    table = TableFiles(spark, path, lease=-1.0)
    assert merging.merge_counts(spark, path, KEYS, fan=8, table=table) >= 1
    assert _chart(spark, path) == want and len(merging.live_files(TableFiles(spark, path))) <= 2 * 7 * 4
    for i in range(4):
        _parts(spark, path, 9, 300 + 9 * i)
        want = _chart(spark, path)
        merging.merge_counts(spark, path, KEYS, fan=8, table=table)
        assert _chart(spark, path) == want
    merging._tidy(table)
    assert len(table.files()) <= 2 * 7 * 4 and not glob.glob(f"{path}/_merged/*") and _chart(spark, path) == want


@pytest.mark.parametrize("step", ["stage", "move_in", "publish"])
def test_readers_see_the_same_at_every_step_and_after_a_death(spark, tmp_dir, monkeypatch, step):
    path = f"{tmp_dir}/chart"
    _parts(spark, path, 20)
    want, seen = _chart(spark, path), []

    def watched(real):
        def run(self, *a):
            seen.append(_chart(spark, path))
            out = real(self, *a)
            seen.append(_chart(spark, path))
            if step == "publish" and not str(a[0]).endswith(".end"):
                return out
            if step == "publish" and a[1] != merging.IN:
                return out
            raise KeyboardInterrupt
        return run

    with monkeypatch.context() as m:
        m.setattr(TableFiles, step, watched(getattr(TableFiles, step)))
        with pytest.raises(KeyboardInterrupt):
            merging.merge_counts(spark, path, KEYS)
    assert seen and all(s == want for s in seen) and _chart(spark, path) == want
    assert merging.merge_counts(spark, path, KEYS) == 0  # the dates are still held
    late = TableFiles(spark, path, lease=-1.0)
    merging.merge_counts(spark, path, KEYS, table=late)
    assert _chart(spark, path) == want and len(merging.live_files(TableFiles(spark, path))) <= 8


def test_the_stream_merges_and_a_replay_adds_nothing(spark, tmp_dir):
    schema = "timestamp timestamp_ntz, priority int"
    src, path = f"{tmp_dir}/in", f"{tmp_dir}/chart"
    for i in range(10):
        spark.createDataFrame([(T0 + timedelta(seconds=30 * i), i % 3)], schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{src}/*")
    jobs.start_live_timechart(stream(), path).awaitTermination()
    assert jobs.read_live_timechart(spark, path).agg(F.sum("count")).first()[0] == 10
    assert len(merging.live_files(TableFiles(spark, path))) == 3
    run_name = jobs._run_name(TableFiles(spark, path), f"{path}-checkpoint")
    assert TableFiles(spark, path).epoch_state(run_name, 0) == "skip"

"""Rejected lines and counters of journal ingest, in a batch and in a stream."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logtide.sources import journal as J
from logtide.sources import tables
from logtide.streaming import jobs

NOW = datetime(2026, 1, 20)
GOOD = ['{"MESSAGE":"a","__REALTIME_TIMESTAMP":"1768900000000000","__CURSOR":"c1"}', '{"MESSAGE":"no clock"}', "{}"]
BAD = [("not_json", "{"), ("not_json", ""), ("not_json", "plain text"), ("not_json", "[1]"), ("bad_clock", '{"__REALTIME_TIMESTAMP":"12x"}'), ("bad_clock", '{"__REALTIME_TIMESTAMP":""}')]


def _lines(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string").repartition(3)


def test_every_line_is_accepted_or_rejected_with_a_reason(spark):
    lines = _lines(spark, GOOD + [x for _, x in BAD] + [None])
    rejected = sorted((r.reason, r.line) for r in J.rejected_lines(lines, NOW).collect() if r.line is not None)
    assert rejected == sorted(BAD)
    assert J.accepted_rows(lines, NOW).count() == len(GOOD)
    assert J.rejected_lines(lines, NOW).count() + J.accepted_rows(lines, NOW).count() == lines.count()
    r = J.line_report(lines, NOW).first()
    assert (r.lines, r.not_json, r.accepted, r.rejected) == (10, 5, 3, 2)


def test_batches_count_and_a_replay_completes(spark, tmp_dir, monkeypatch):
    path, side, ckpt = f"{tmp_dir}/logs", f"{tmp_dir}/side", f"{tmp_dir}/ckpt"
    batches = [_lines(spark, GOOD + [x for _, x in BAD]), _lines(spark, GOOD), _lines(spark, [x for _, x in BAD[:2]])]

    def fail(spark_, table):
        raise KeyboardInterrupt

    for epoch, batch in enumerate(batches):
        jobs.ingest_lines(batch, NOW, path, side, ckpt, epoch)
        jobs.ingest_lines(batch, NOW, path, side, ckpt, epoch)  # replayed whole
    with monkeypatch.context() as m:
        m.setattr(jobs, "_dated_parts", fail)  # lost after the table had its rows
        with pytest.raises(KeyboardInterrupt):
            jobs.ingest_lines(batches[0], NOW, path, side, ckpt, 3)
    jobs.ingest_lines(batches[0], NOW, path, side, ckpt, 3)
    counts = sorted(tuple(r)[:5] for r in jobs.read_ingest_counts(spark, side).collect())
    assert counts == [(0, 9, 3, 4, 2), (1, 3, 3, 0, 0), (2, 2, 0, 2, 0), (3, 9, 3, 4, 2)]
    assert all(n == a + j + c for _, n, a, j, c in counts)
    assert tables.read_logs(spark, path).count() == 9
    rejects = jobs.read_rejects(spark, side)
    assert rejects.count() == 14 and rejects.groupBy("reason").count().orderBy("reason").collect()[0][:] == ("bad_clock", 4)
    assert rejects.agg(F.min("date"), F.max("date")).first()[:] == (NOW.date(), NOW.date())

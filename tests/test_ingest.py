"""Typed ingest and the storage unit cases: round trip, conversions, overflow,
NULL fields, statistics, minute delete, retention."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from logtide.operators import ingest, maintenance, stats
from logtide.schemas import JOURNAL_COLUMNS
from logtide.sources.journal import parse_lines
from tests.helpers import entries, typed

TS = datetime(2026, 1, 17, 14, 30, 45)
NOW = datetime(2026, 1, 20)


def test_round_trip(spark):
    fields = {"MESSAGE": "hello", "PRIORITY": "6", "_SYSTEMD_UNIT": "test.service", "_HOSTNAME": "test-host",
              "_PID": "1234", "CUSTOM_FIELD": "custom"}
    df = typed(spark, [(TS, fields)])
    assert df.columns == JOURNAL_COLUMNS and len(JOURNAL_COLUMNS) == 76
    row = df.first()
    assert row["timestamp"] == TS and row["minute_key"] == "2026-01-17T14:30:00+00:00"
    assert row["priority"] == 6 and row["_PID"] == 1234 and row["_HOSTNAME"] == "test-host"
    back = ingest.rebuild_fields(df).first()
    want = dict(fields)
    want["__REALTIME_TIMESTAMP"] = str(int((TS - datetime(1970, 1, 1)).total_seconds() * 1_000_000))
    assert back["timestamp"] == TS
    assert dict(back["fields"]) == want  # integers come back as text


def test_statistics(spark):
    df = typed(spark, [(TS, {"MESSAGE": "m", "PRIORITY": "6"})])
    s = stats.buffer_stats(df).first()
    assert s.total_entries == 1 and s.buffered_minutes == 1
    assert s.oldest_minute == s.newest_minute == "2026-01-17T14:30:00+00:00"


def test_delete_minute(spark):
    df = typed(spark, [(TS, {"MESSAGE": "m", "PRIORITY": "6"})])
    kept, deleted = maintenance.delete_minute(df, datetime(2026, 1, 17, 14, 30))
    assert deleted.first().deleted == 1 and kept.count() == 0


def test_type_conversions(spark):
    df = typed(spark, [(TS, {"PRIORITY": "6", "_PID": "1234", "_UID": "1000", "_GID": "1000",
                             "INVALID_PRIORITY": "invalid"})])
    r = df.first()
    assert (r.priority, r._PID, r._UID, r._GID) == (6, 1234, 1000, 1000)
    assert r.extra_fields == '{"INVALID_PRIORITY":"invalid"}'


def test_invalid_known_integer_is_null_and_not_overflow(spark):
    r = typed(spark, [(TS, {"PRIORITY": "invalid", "CODE_LINE": " 7 ", "ERRNO": "+2"})]).first()
    assert r.priority is None and r.code_line is None and r.errno == 2
    assert r.extra_fields is None


def test_overflow_fields(spark):
    r = typed(spark, [(TS, {"MESSAGE": "m", "CUSTOM_FIELD_1": "a", "CUSTOM_FIELD_2": "b"})]).first()
    import json

    assert json.loads(r.extra_fields) == {"CUSTOM_FIELD_1": "a", "CUSTOM_FIELD_2": "b"}


def test_null_fields(spark):
    r = typed(spark, [(TS, {"MESSAGE": "only"})]).first()
    assert r.message == "only"
    assert all(r[c] is None for c in JOURNAL_COLUMNS if c not in ("timestamp", "minute_key", "message",
                                                                   "__REALTIME_TIMESTAMP"))
    back = ingest.rebuild_fields(typed(spark, [(TS, {"MESSAGE": "only"})])).first()
    assert set(back.fields) == {"MESSAGE", "__REALTIME_TIMESTAMP"}


def test_entry_timestamp_missing_and_bad(spark):
    e = spark.createDataFrame(
        [({"MESSAGE": "no clock"},), ({"MESSAGE": "bad", "__REALTIME_TIMESTAMP": "12x"},),
         ({"MESSAGE": "neg", "__REALTIME_TIMESTAMP": "-5"},), ({"MESSAGE": "ok", "__REALTIME_TIMESTAMP": "+1000000"},)],
        "fields map<string,string>",
    )
    out = ingest.parse_entries(e, NOW).orderBy("message").collect()
    assert [(r.message, r.timestamp) for r in out] == [("no clock", NOW), ("ok", datetime(1970, 1, 1, 0, 0, 1))]
    rep = ingest.ingest_report(e, NOW).first()
    assert (rep.accepted, rep.rejected) == (2, 2)


def test_parse_lines_json_values(spark):
    lines = spark.createDataFrame(
        [('{"MESSAGE":"x","PRIORITY":3,"_BYTES":[1,2],"GONE":null}',), ("not json",)], "value string"
    )
    rows = parse_lines(lines).collect()
    assert len(rows) == 1  # the non-JSON line is dropped
    f = dict(rows[0].fields)
    assert {k: v for k, v in f.items() if v is not None} == {"MESSAGE": "x", "PRIORITY": "3", "_BYTES": "[1,2]"}
    typed_row = ingest.parse_entries(parse_lines(lines), NOW).first()
    assert typed_row.extra_fields == '{"_BYTES":"[1,2]"}'  # JSON null left out like an absent field


def test_rebuild_overflow_wins_on_duplicate(spark):
    df = typed(spark, [(TS, {"MESSAGE": "typed"})]).withColumn("extra_fields", F.lit('{"MESSAGE":"overflow"}'))
    assert ingest.rebuild_fields(df).first().fields["MESSAGE"] == "overflow"


def test_age_retention(spark):
    now = datetime(2026, 3, 1)
    df = typed(spark, [(now - timedelta(days=40), {"MESSAGE": "old"}), (now - timedelta(days=5), {"MESSAGE": "new"})])
    kept, deleted = maintenance.retain_by_age(df, now, 30)
    assert deleted.first().deleted == 1
    assert [r.message for r in kept.collect()] == ["new"]


def test_age_retention_noop_and_edge(spark):
    now = datetime(2026, 3, 1)
    df = typed(spark, [(now - timedelta(days=1), {"MESSAGE": "recent"}), (now - timedelta(days=30), {"MESSAGE": "edge"})])
    kept, deleted = maintenance.retain_by_age(df, now, 30)
    assert deleted.first().deleted == 0 and kept.count() == 2  # a row exactly at the cutoff stays


def test_ingest_summary(spark):
    df = typed(spark, [(datetime(2026, 1, 1, 0, m), {"MESSAGE": "x"}) for m in (0, 1, 4, 5, 12)])
    rows = ingest.ingest_summary(df, "journal").orderBy("window_start").collect()
    assert [(r.window_start.minute, r.rows) for r in rows] == [(0, 3), (5, 1), (10, 1)]


def test_entries_unused_helper(spark):
    assert entries(spark, [(None, {"A": "b"})]).count() == 1


def test_missing_clock_defaults_to_current_time(spark):
    e = spark.createDataFrame([({"MESSAGE": "no clock"},)], "fields map<string,string>")
    def utc_now():
        return datetime.now(timezone.utc).replace(tzinfo=None)

    before = utc_now()
    ts = ingest.parse_entries(e).first().timestamp
    assert before - timedelta(seconds=5) <= ts <= utc_now() + timedelta(seconds=5)


def test_line_report(spark):
    from logtide.sources.journal import line_report

    lines = spark.createDataFrame(
        [('{"MESSAGE":"a","__REALTIME_TIMESTAMP":"5"}',), ('{"MESSAGE":"b"}',), ("garbage",),
         ('{"MESSAGE":"c","__REALTIME_TIMESTAMP":"x"}',)], "value string")
    r = line_report(lines, NOW).first()
    assert (r.lines, r.not_json, r.accepted, r.rejected) == (4, 1, 2, 1)


def test_cursors_of_long_ids_are_distinct(spark):
    from logtide.sources.derived import _cursor

    df = spark.createDataFrame([(7,), (12345678901,), (12345678902,)], "event_id long")
    assert [r.c for r in df.select(_cursor(F.col("event_id")).alias("c")).collect()] == ["c-0000000007", "c-12345678901", "c-12345678902"]


def test_overflow_json_is_parsed_once(spark):
    df = typed(spark, [(TS, {"MESSAGE": "x", "K": "v"})])
    plan = ingest.rebuild_fields(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1

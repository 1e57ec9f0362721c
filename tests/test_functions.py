"""Scalar functions and argument parsers (time text, LIKE escape, labels, sizes,
formatting), with the reference's unit-test values."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from logtide.functions import columns as C
from logtide.functions.text import escape_like, parse_size, parse_time

NOW = datetime(2026, 1, 17, 14, 30, 45)


def test_parse_time_relative_and_now():
    assert parse_time("now", NOW) == NOW
    assert parse_time("-1h", NOW) == NOW - timedelta(hours=1)
    assert parse_time("-15m", NOW) == NOW - timedelta(minutes=15)
    assert parse_time("-7d", NOW) == NOW - timedelta(days=7)
    assert parse_time("-30s", NOW) == NOW - timedelta(seconds=30)
    # the number may itself be signed: --5h is five hours ahead
    assert parse_time("--5h", NOW) == NOW + timedelta(hours=5)


def test_parse_time_rfc3339():
    assert parse_time("2026-01-17T14:30:45Z", NOW) == datetime(2026, 1, 17, 14, 30, 45)
    assert parse_time("2026-01-17T16:30:45+02:00", NOW) == datetime(2026, 1, 17, 14, 30, 45)
    assert parse_time("2026-01-17T14:30:45.25Z", NOW) == datetime(2026, 1, 17, 14, 30, 45, 250000)


@pytest.mark.parametrize("bad", ["-1x", "-h", "yesterday", "2026-01-17", "-1.5h", ""])
def test_parse_time_errors(bad):
    with pytest.raises(ValueError):
        parse_time(bad, NOW)


def test_escape_like():
    assert escape_like("test") == "test"
    assert escape_like("test%value") == "test\\%value"
    assert escape_like("test_value") == "test\\_value"
    assert escape_like("test\\value") == "test\\\\value"


def test_parse_size():
    assert parse_size("5G") == 5 * 1024**3
    assert parse_size("500M") == 500 * 1024**2
    assert parse_size("1T") == 1024**4
    assert parse_size("1024K") == 1024 * 1024
    assert parse_size("1024") == 1024
    assert parse_size("1.5G") == int(1.5 * 1024**3)
    for bad in ["abc", "G", "", "5g", "1_0G", "5 G", "0x10", "5GG", "e5", "."]:
        with pytest.raises(ValueError):
            parse_size(bad)
    assert (parse_size("-5G"), parse_size("nan"), parse_size("inf"), parse_size("1e3K"), parse_size("5.G"), parse_size(" +2K\n")) == (
        0, 0, 2**64 - 1, 1024_000, 5 * 1024**3, 2048)


def test_size_column_follows_the_parser(spark):
    texts = ["5G", "500M", "1.5G", "abc", "G", "", "5g", "1_0G", "5 G", "-5G", "nan", "inf", "-inf", "1e3K", "5.G", " +2K\n", "1e30T", ".5K", "0x10", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.size_bytes("t").alias("b")).collect()

    def want(t):
        try:
            return None if t is None else min(parse_size(t), 2**63 - 1)
        except ValueError:
            return None

    assert [r.b for r in rows] == [want(t) for t in texts]


def test_priority_labels_and_classes(spark):
    df = spark.createDataFrame([(p,) for p in [0, 3, 6, 7, 8, -1, None]], "p int")
    rows = df.select(C.priority_label("p").alias("l"), C.severity_class("p").alias("s")).collect()
    assert [r.l for r in rows] == ["Emergency", "Error", "Info", "Debug", "Unknown", "Unknown", "Unknown"]
    assert [r.s for r in rows][:5] == ["critical", "error", "", "", ""]


def test_minute_key(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 17, 14, 30, 45, 123456),)], "ts timestamp_ntz")
    assert df.select(C.minute_key("ts")).first()[0] == "2026-01-17T14:30:00+00:00"


def test_strict_int(spark):
    vals = ["6", " 6 ", "6.7", "+6", "-3", "invalid", "", "99999999999", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(C.strict_int("v")).collect()]
    assert got == [6, None, None, 6, -3, None, None, None, None]
    got_long = df.select(C.strict_int("v", "long")).collect()[7][0]
    assert got_long == 99999999999


def test_uid_and_cmdline(spark):
    df = spark.createDataFrame(
        [("Uid(1234)", ["/bin/sh", "-c", "x"]), ("root", []), (None, None)], "u string, cmd array<string>"
    )
    rows = df.select(C.uid_text("u").alias("u"), C.cmdline("cmd").alias("c")).collect()
    assert [(r.u, r.c) for r in rows] == [("1234", "/bin/sh -c x"), (None, None), (None, None)]


def test_fixed1_matches_exact_binary_rounding(spark):
    vals = [6.55, 0.25, 0.35, 12.35, 0.05, 1023.95, 2.5, 0.0, 1.0, 99.99, 0.001, 0.15, 1.05, 4.35, 123456.75]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(C.fixed1("v")).collect()]
    con = duckdb.connect()
    want = [con.sql(f"SELECT printf('%.1f', {v!r}::DOUBLE)").fetchall()[0][0] for v in vals]
    assert got == want


def test_human_bytes(spark):
    vals = [0, -5, 512, 1024, 1536, 1048576, 5 * 1024**3, 3 * 1024**5, 2048 * 1024**5]
    df = spark.createDataFrame([(float(v),) for v in vals], "b double")
    got = [r[0] for r in df.select(C.human_bytes("b")).collect()]
    assert got == ["-", "-", "512.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB", "3.0 PB", "2048.0 PB"]


def test_human_runtime(spark):
    vals = [0, 45, 60, 330, 3600, 8100, 86400, 302400]
    df = spark.createDataFrame([(v,) for v in vals], "s long")
    got = [r[0] for r in df.select(C.human_runtime("s")).collect()]
    assert got == ["0s", "45s", "1m", "5m 30s", "1h", "2h 15m", "1d", "3d 12h"]


def test_memory_percent_and_age(spark):
    df = spark.createDataFrame([(8 * 1024.0**3, datetime(2026, 1, 17, 14, 29, 45, 500000)), (0.0, NOW)],
                               "b double, ts timestamp_ntz")
    rows = df.select(C.memory_percent("b").alias("m"), C.age_seconds("ts", NOW).alias("a")).collect()
    assert rows[0].m == 50.0 and rows[1].m == 0.0
    assert rows[0].a == 59 and rows[1].a == 0


def test_fuzzy(spark):
    df = spark.createDataFrame([("1234 firefox 1000 2.5",), ("42 bash",), ("a.b",)], "t string")
    assert [r[0] for r in df.select(C.fuzzy(F.col("t"), "ffx")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(C.fuzzy(F.col("t"), ".")).collect()] == [True, False, True]
    assert [r[0] for r in df.select(C.fuzzy(F.col("t"), "")).collect()] == [True, True, True]


def test_size_bytes_column(spark):
    df = spark.createDataFrame([(s,) for s in ["5G", "500M", "1T", "1024K", "1024", "abc", "G", "1.5G", "500m"]], "s string")
    got = [r[0] for r in df.select(C.size_bytes("s")).collect()]
    assert got == [5 * 1024**3, 500 * 1024**2, 1024**4, 1024**2, 1024, None, None, int(1.5 * 1024**3), None]


@pytest.mark.parametrize("seed", [1, 2])
def test_fixed1_random_values_match_printf(spark, seed):
    import random

    rnd = random.Random(seed)
    vals = ([round(rnd.uniform(0, 100), 2) for _ in range(400)] + [rnd.uniform(0, 5000) for _ in range(400)]
            + [k / 20 for k in range(200)] + [rnd.randrange(0, 10**12) / 8 for _ in range(200)])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(C.fixed1("v")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    want = [r[0] for r in con.sql("SELECT printf('%.1f', v) FROM t ORDER BY i").fetchall()]
    assert got == want

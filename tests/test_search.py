"""Search: predicates, column choice, sort with NULLs last, paging, page state,
the empty-table shape, and plan properties (pushdown, top-k)."""

from datetime import datetime, timedelta

import pytest

from logtide.operators import search, stats
from logtide.operators.predicates import log_filter
from tests.helpers import typed

NOW = datetime(2026, 1, 17, 15, 0)


def _rows(spark):
    base = NOW - timedelta(minutes=50)
    data = []
    msgs = ["Disk 100% full", "disk_usage ok", "path\\to\\x", "it's fine", None, "DISK error", "other"]
    hosts = ["a", "b", None, "a", "c", "b", None]
    for i, (m, h) in enumerate(zip(msgs, hosts)):
        f = {"PRIORITY": str(i % 8) if i != 3 else "x", "_SYSTEMD_UNIT": f"u{i % 3}.service", "_PID": str(100 + i),
             "_COMM": f"c{i}", "__CURSOR": f"c-{i:03d}"}
        if m is not None:
            f["MESSAGE"] = m
        if h is not None:
            f["_HOSTNAME"] = h
        data.append((base + timedelta(minutes=5 * i), f))
    data.append((NOW - timedelta(hours=3), {"MESSAGE": "disk too old", "__CURSOR": "c-old"}))
    return typed(spark, data, now=NOW)


def _msgs(df):
    return [r["message"] for r in df.collect()]


def test_text_search_is_case_insensitive_and_literal(spark):
    df = _rows(spark)
    assert sorted(_msgs(search.search(df, NOW, q="DISK"))) == ["DISK error", "Disk 100% full", "disk_usage ok"]
    assert _msgs(search.search(df, NOW, q="100%")) == ["Disk 100% full"]
    assert _msgs(search.search(df, NOW, q="k_u")) == ["disk_usage ok"]
    assert _msgs(search.search(df, NOW, q="h\\t")) == ["path\\to\\x"]
    assert _msgs(search.search(df, NOW, q="it's")) == ["it's fine"]
    assert len(_msgs(search.search(df, NOW, q=""))) == 7  # empty text: no filter, NULL message kept


def test_time_range_is_half_open(spark):
    df = _rows(spark)
    start = NOW - timedelta(minutes=50)
    got = search.search(df, NOW, start=start, end=start + timedelta(minutes=5), columns="message").collect()
    assert [r.message for r in got] == ["Disk 100% full"]
    assert search.search(df, NOW, start="-4h").count() == 8


def test_host_unit_priority_filters(spark):
    df = _rows(spark)
    assert search.search(df, NOW, hostname="a,c").count() == 3
    assert search.search(df, NOW, hostname="a, c").count() == 2  # list values are not trimmed
    assert search.search(df, NOW, unit="u0.service").count() == 3
    pr = search.search(df, NOW, priority=2, columns="priority").collect()
    assert sorted(r.priority for r in pr) == [0, 1, 2]  # NULL priority excluded


def test_columns_validation(spark):
    df = _rows(spark)
    out = search.search(df, NOW)
    assert out.columns == ["timestamp", "hostname", "unit", "priority", "pid", "comm", "message"]
    assert dict(out.dtypes)["timestamp"] == "string" and dict(out.dtypes)["pid"] == "string"
    assert search.search(df, NOW, columns=" MESSAGE , bogus").columns == ["message"]
    with pytest.raises(ValueError):
        search.search(df, NOW, columns="bogus,nothing")
    rows, _ = search.search_page(df, NOW, columns="bogus")
    assert rows.columns == out.columns


def test_sort_nulls_last_both_ways(spark):
    df = _rows(spark)
    asc = [r.hostname for r in search.search(df, NOW, sort="host", sort_dir="asc").collect()]
    desc = [r.hostname for r in search.search(df, NOW, sort="hostname", sort_dir="DESC").collect()]
    assert asc == ["a", "a", "b", "b", "c", None, None]
    assert desc == ["c", "b", "b", "a", "a", None, None]
    # unknown sort -> timestamp, unknown direction -> desc
    ts = [r.timestamp for r in search.search(df, NOW, sort="nope", sort_dir="up").collect()]
    assert ts == sorted(ts, reverse=True)


def test_paging_and_deep_page_agree(spark):
    df = _rows(spark)
    order = search.sort_columns("timestamp", "asc")
    matched = log_filter(df, NOW, "-1h")
    full = [r["__CURSOR"] for r in matched.orderBy(*order).collect()]
    for off, lim in [(0, 3), (2, 3), (5, 10), (10, 3)]:
        top = [r["__CURSOR"] for r in search.page(matched, order, lim, off).collect()]
        deep = [r["__CURSOR"] for r in search._deep_page(matched, order, lim, off).collect()]
        assert top == deep == full[off:off + lim]


def test_limit_is_as_asked(spark):
    df = _rows(spark)
    plan = search.page(df, search.sort_columns(), limit=10**9, topk_max_rows=10**10)._jdf.queryExecution().optimizedPlan().toString()
    assert "1000000000" in plan


def test_rows_without_a_time_come_last_by_either_plan(spark):
    rows = [(datetime(2026, 1, 1, 0, 0, i % 3), f"c{i}") for i in range(6)] + [(None, "n1"), (None, "n2"), (None, "n0")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, __CURSOR string")
    for sort_dir in ("asc", "desc"):
        for offset, limit in ((0, 20), (0, 7), (4, 4), (6, 2), (7, 9), (9, 3)):
            small = [r["__CURSOR"] for r in search.sorted_page(df, "timestamp", sort_dir, limit, offset, topk_max_rows=100).collect()]
            large = [r["__CURSOR"] for r in search.sorted_page(df, "timestamp", sort_dir, limit, offset, topk_max_rows=0).collect()]
            assert small == large and len(small) == max(0, min(limit, 9 - offset))


def test_page_state(spark):
    df = _rows(spark)
    _, st = search.search_page(df, NOW, limit=3, offset=2)
    s = st.first()
    assert (s.total, s.offset, s.returned, s.next_offset, s.state) == (7, 2, 3, 5, "more")
    _, st = search.search_page(df, NOW, limit=10, offset=2)
    assert st.first().state == "end" and st.first().next_offset is None
    _, st = search.search_page(df, NOW, q="no such text")
    assert (st.first().total, st.first().state) == (0, "none")


def test_search_on_empty_table(spark):
    empty = _rows(spark).limit(0)
    rows, st = search.search_page(empty, NOW, q="x", hostname="a", unit="u", priority=3, limit=10)
    assert rows.count() == 0 and st.first().total == 0
    assert rows.columns == ["timestamp", "hostname", "unit", "priority", "pid", "comm", "message"]
    assert stats.buffer_stats(empty).first().oldest_minute is None


def test_search_total_counts_all_matches(spark):
    df = _rows(spark)
    assert search.search_total(df, NOW, q="disk", start="-4h").first().total == 4


def test_plan_pushes_filters_and_uses_topk(spark):
    from tests.conftest import SF001
    from logtide.sources import tables

    logs = tables.journal_logs(spark, SF001)
    df = search.search(logs, datetime(2024, 1, 31), start="-7d", hostname="host-1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    scan = df._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in scan

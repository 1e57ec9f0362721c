"""Process samples: typing, first-arrival de-duplication, latest snapshot,
process table paging and fuzzy search."""

from datetime import datetime

from logtide.operators import processes as P
from logtide.schemas import RAW_SAMPLE_SCHEMA

T1 = datetime(2026, 1, 17, 14, 0)
T2 = datetime(2026, 1, 17, 14, 0, 5)


def _samples(spark):
    rows = [
        (T1, 1, "init", 0.5, 1000, "Uid(0)", 100, ["/sbin/init"], 5000, "Sleep", None, 1),
        (T2, 1, "init", 0.25, 1000, "Uid(0)", 105, ["/sbin/init"], 5000, "Sleep", None, 2),
        (T2, 42, "firefox", 35.5, 2 * 1024**3, "Uid(1000)", 7300, ["/usr/bin/firefox", "-P"], 9 * 1024**3, "Run", 1, 3),
        (T2, 42, "dup-late", 1.0, 1, "Uid(1000)", 1, [], 1, "Run", 1, 9),
        (T2, 77, "bash", 35.5, 5 * 1024**2, "weird", 59, [], None, "Sleep", 42, 4),
    ]
    schema = RAW_SAMPLE_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ") + ", seq int"
    schema = schema.replace("array<string>", "array<string>")
    return spark.createDataFrame(rows, schema)


def test_typing_and_dedupe(spark):
    typed = P.to_process_metrics(_samples(spark))
    out = P.dedupe_samples(typed, "seq").orderBy("timestamp", "pid").collect()
    assert [(r.pid, r.name) for r in out] == [(1, "init"), (1, "init"), (42, "firefox"), (77, "bash")]
    ff = out[2]
    assert ff.user == "1000" and ff.cmdline == "/usr/bin/firefox -P" and ff.mem_usage == 2.0 * 1024**3
    assert out[3].user is None and out[3].cmdline is None


def test_latest_snapshot(spark):
    procs = P.dedupe_samples(P.to_process_metrics(_samples(spark)), "seq")
    latest = P.latest_processes(procs).collect()
    assert sorted(r.pid for r in latest) == [1, 42, 77] and {r.total for r in latest} == {3}


def test_process_table_order_and_text(spark):
    procs = P.dedupe_samples(P.to_process_metrics(_samples(spark)), "seq")
    rows = P.process_table(procs).collect()
    assert [r.pid for r in rows] == [42, 77, 1]  # cpu desc, pid breaks the tie
    ff = rows[0]
    assert (ff.mem_text, ff.runtime_text, ff.mem_percent) == ("2.0 GB", "2h 1m", 12.5)
    assert rows[1].virtual_memory == 0.0  # missing reads as 0


def test_process_table_limits_and_fuzzy(spark):
    procs = P.dedupe_samples(P.to_process_metrics(_samples(spark)), "seq")
    assert P.process_table(procs, limit=1).count() == 1  # as asked
    assert P.process_table(procs, offset=10).count() == 0
    assert [r.pid for r in P.process_table(procs, q="FFx").collect()] == [42]
    assert [r.pid for r in P.process_table(procs, q="35.5").collect()] == [42, 77]
    assert P.process_table(procs, q="   ").count() == 3


def test_process_table_deep_page_matches_top_k(spark, monkeypatch):
    from logtide.operators import ranking

    procs = P.dedupe_samples(P.to_process_metrics(_samples(spark)), "seq")
    top = [r.pid for r in P.process_table(procs, limit=10, offset=1).collect()]
    monkeypatch.setattr(ranking, "MERGE_BUDGET_ROWS", 0)  # force the distributed route
    deep = [r.pid for r in P.process_table(procs, limit=10, offset=1).collect()]
    assert top == deep == [77, 1]


def test_process_page_state_texts_and_sort(spark):
    procs = P.dedupe_samples(P.to_process_metrics(_samples(spark)), "seq")
    rows, state = P.process_page(procs, limit=2)
    assert [r.pid for r in rows.collect()] == [42, 77]
    s = state.first()
    assert (s.total, s.offset, s.returned, s.next_offset, s.state) == (3, 0, 2, 2, "more") and s.snapshot == procs.agg({"timestamp": "max"}).first()[0]
    rows, state = P.process_page(procs, limit=2, offset=2)
    last = rows.first()
    assert (state.first().state, state.first().next_offset) == ("end", None)
    assert last.cpu_text.endswith("%") and last.virtual_memory_text and last.parent_pid_text
    none = P.process_page(procs, q="no such thing")[1].first()
    assert (none.total, none.state) == (0, "none")
    assert P.process_page(procs.limit(0))[1].first().state == "none"
    assert [r.pid for r in P.process_table(procs, sort="pid", sort_dir="asc").collect()] == [1, 42, 77]
    assert [r.pid for r in P.process_table(procs, sort="nonsense").collect()] == [42, 77, 1]

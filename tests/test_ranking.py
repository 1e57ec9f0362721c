"""Rank windows (time order and low-cardinality key order) against sorting in
Python: ties on the boundary, NULL keys last, both directions, short tables."""

from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.operators.ranking import key_slice, locate_rank, rank_slice

T0 = datetime(2026, 1, 1)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, host string, cur string")


def _rows(offsets, hosts):
    return [(T0 + timedelta(microseconds=o), h, f"c{i:04d}") for i, (o, h) in enumerate(zip(offsets, hosts))]


def _expect_time(rows, start, stop, desc):
    s = sorted(rows, key=lambda r: (r[0], r[2]), reverse=desc)
    return [r[2] for r in s[start:stop]]


def _expect_key(rows, start, stop, desc):
    present = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2]), reverse=desc)
    nulls = sorted((r for r in rows if r[1] is None), key=lambda r: r[2], reverse=desc)
    return [r[2] for r in (present + nulls)[start:stop]]


# few distinct instants (many ties) spread over a few days
instants = st.sampled_from([0, 1, 999, 60_000_000, 86_400_000_000, 86_400_000_001, 2 * 86_400_000_000 + 5])
hosts = st.sampled_from(["a", "b", "c", None])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(instants, hosts), min_size=1, max_size=30), st.integers(0, 35), st.integers(0, 12),
       st.booleans())
def test_rank_and_key_slices_match_sorting(spark, data, start, size, desc):
    rows = _rows([d[0] for d in data], [d[1] for d in data])
    df = _frame(spark, rows)
    stop = start + size
    got_t = [r.cur for r in rank_slice(df, start, stop, desc, "timestamp", "cur", small=2).collect()]
    assert got_t == _expect_time(rows, start, stop, desc)
    got_k = [r.cur for r in key_slice(df, start, stop, "host", desc, "cur", small=2).collect()]
    assert got_k == _expect_key(rows, start, stop, desc)


def test_locate_rank_counts(spark):
    rows = _rows([5, 5, 5, 10, 20], ["a"] * 5)
    df = _frame(spark, rows)
    t, before, at = locate_rank(df, 2)
    assert (t, before, at) == (T0 + timedelta(microseconds=5), 0, 3)
    t, before, at = locate_rank(df, 2, descending=True)
    assert (t, before, at) == (T0 + timedelta(microseconds=10), 1, 1)
    assert locate_rank(df, 6) is None


def test_boundary_shared_by_many_rows_uses_distributed_page(spark):
    rows = _rows([7] * 1500 + [8] * 10, ["a"] * 1510)
    df = _frame(spark, rows)
    got = [r.cur for r in rank_slice(df, 1200, 1505, True, "timestamp", "cur", small=100).collect()]
    assert got == _expect_time(rows, 1200, 1505, True)


def test_descent_on_date_partitioned_table(spark, tmp_dir):
    from logtide.operators import maintenance as M
    from logtide.sources import tables

    logs = tables.journal_logs(spark, "/root/testdata/sf0.001")
    M.write_logs(logs, f"{tmp_dir}/logs")
    stored = tables.read_logs(spark, f"{tmp_dir}/logs")
    for k in (1, 37, 500, 1000):
        assert locate_rank(stored, k) == locate_rank(logs, k)
        assert locate_rank(stored, k, descending=True) == locate_rank(logs, k, descending=True)
    got = [r["__CURSOR"] for r in rank_slice(stored, 100, 400, True, "timestamp", "__CURSOR", small=10).collect()]
    want = [r["__CURSOR"] for r in logs.orderBy(logs.timestamp.desc(), logs.__CURSOR.desc()).collect()][100:400]
    assert got == want


keyed = st.tuples(st.sampled_from([None, "a", "b", "bb", "c"]), st.sampled_from([None, 0.0, 1.5, -2.0, float("nan")]), st.integers(0, 3))


@settings(max_examples=15, deadline=None)
@given(st.lists(keyed, max_size=60), st.integers(0, 70), st.integers(0, 25), st.booleans(), st.booleans())
def test_selection_matches_sorting(spark, data, start, size, by_name_desc, by_value_desc):
    from unittest.mock import patch

    from logtide.operators import ranking as R

    df = spark.createDataFrame(data, "name string, value double, rest int").repartition(3)
    keys = [("name", by_name_desc), ("value", by_value_desc)]

    def place(r):
        out = []
        for i, (x, desc) in enumerate(zip(r, (by_name_desc, by_value_desc))):
            # NaN is the greatest number; NULLs come last in either direction
            v = (0, 0.0) if x is None else ({"a": 1, "b": 2, "bb": 3, "c": 4}[x], 0.0) if i == 0 else (1, 0.0) if x != x else (0, x)
            out.append((x is None, *[-y for y in v]) if desc else (x is None, *v))
        return out

    want = sorted((r[:2] for r in data), key=place)[start : start + size]
    with patch.object(R, "SMALL_PART", 3), patch.object(R, "SPLITTERS", 3), patch.object(R, "SAMPLE", 8):
        page = R.select_window(df, start, start + size, keys)
        got = [tuple(r)[:2] for r in page.collect()]
        ranks = R.select_ranks(df, [0, len(data) - 1, len(data)], keys)
    assert repr(got) == repr(want)
    assert ranks[2] is None and (not data or ranks[0][1] == 0 and sum(ranks[1][1:]) == len(data))


def test_pages_by_selection_cover_every_row_once(spark):
    from unittest.mock import patch

    from logtide.operators import ranking as R

    # two rows in three share the key, many of them wholly
    df = spark.range(3000).selectExpr("if(id % 3 = 0, cast(id as string), 'same') as host", "cast(null as string) as cur", "id % 7 as n").repartition(4)
    with patch.object(R, "SMALL_PART", 50):
        pages = [R.key_slice(df, i, i + 500, "host", False, "cur", small=0).collect() for i in range(0, 3500, 500)]
    assert [len(p) for p in pages] == [500] * 6 + [0]
    seen = sorted(repr(tuple(r)) for p in pages for r in p)
    assert seen == sorted(repr(tuple(r)) for r in df.collect())
    hosts = [r.host for p in pages for r in p]
    assert hosts == sorted(hosts)


def test_selection_reads_only_key_columns_and_checkpoints_nothing(spark, tmp_dir):
    from logtide.operators import maintenance as M
    from logtide.operators import ranking as R
    from logtide.sources import tables

    M.write_logs(tables.journal_logs(spark, "/root/testdata/sf0.001"), f"{tmp_dir}/logs")
    logs = tables.read_logs(spark, f"{tmp_dir}/logs")
    page = R.select_window(logs, 300, 400, [("_HOSTNAME", False), ("__CURSOR", False)])
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "_HOSTNAME" in plan
    want = [r["__CURSOR"] for r in logs.orderBy(logs._HOSTNAME.asc_nulls_last(), logs.__CURSOR.asc_nulls_last()).collect()][300:400]
    assert [r["__CURSOR"] for r in page.collect()] == want
    at = R.select_ranks(logs, [300, 399], [("_HOSTNAME", False), ("__CURSOR", False)])
    assert all(n == 1 for _, _, n in at) and [r for _, r, _ in at] == [300, 399]

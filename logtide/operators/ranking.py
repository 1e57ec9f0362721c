"""Rank windows over the time order without a single-task merge.

A top-k (`TakeOrderedAndProject`) keeps k rows per task and merges P x k rows
in one task; fine for small k, not for the history cap (10,000) or deep pages
on thousands of partitions.  For time-ordered windows we instead locate the
boundary timestamps of the window by a bucket descent -- day -> minute ->
millisecond -> microsecond, each level one aggregate job for both boundaries,
with at most 1,440 / 60,000 / 1,000 buckets per parent inside a pushed-down
time range -- and then read exactly the rows
between the boundaries.  Rows that share a boundary timestamp are ordered by
the tie-breaker with an ordinary (small) page.

Windows of any other order, and of a timestamp that very many rows share, are found
by distributed selection on the compound sort key (`select_ranks`): sampled
splitters, exact counts between them, the part that holds the rank again.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import ts_literal_like

EPOCH = datetime(1970, 1, 1)
# Bucket widths in microseconds, coarse to fine: day, minute, millisecond, microsecond.
LEVELS = [86_400_000_000, 60_000_000, 1_000, 1]
# A top-k merges (input partitions x rows kept per task) rows in one task; above
# this many rows the window is cut out of the order instead.
MERGE_BUDGET_ROWS = 2_000_000
# Selection: keys sampled and splitters chosen a round, and rows whose keys are sorted on the driver's behalf at last.
SAMPLE, SPLITTERS, SMALL_PART = 2_000, 31, 4_096


def planned_partitions(df: DataFrame) -> int:
    """Partitions feeding the next operator, without running anything.

    After a shuffle the planned partitioning says it (asking the RDD there
    would make adaptive execution run the shuffle).  A plain scan pipeline
    reports its file splits after partition pruning, which the RDD gives from
    split planning alone.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()  # the initial plan; nothing is executed
    n = plan.outputPartitioning().numPartitions()
    if n > 0:
        return n
    if "Exchange" in plan.toString():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(df.rdd.getNumPartitions(), 1)


def topk_fits(df: DataFrame, rows: int) -> bool:
    """Size check for a single-task top-k merge."""
    return planned_partitions(df) * max(1, int(rows)) <= MERGE_BUDGET_ROWS


def from_micros(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


def _range(df: DataFrame, col: str, lo_us: int, hi_us: int) -> Column:
    """[lo, hi) on the time column, plus the implied date range on a date-partitioned
    table, so each descent level lists and reads only the dates it needs."""
    c = F.col(col)
    lo, hi = from_micros(lo_us), from_micros(hi_us)
    cond = (c >= ts_literal_like(df, col, lo)) & (c < ts_literal_like(df, col, hi))
    if "date" in df.columns:
        cond = cond & F.col("date").between(F.lit(lo.date().isoformat()).cast("date"),
                                            F.lit(hi.date().isoformat()).cast("date"))
    return cond


def _dated(df: DataFrame, col: str, cond: Column, test) -> Column:
    """A test of the time, and of the date it implies on a table partitioned by that date."""
    return cond & test(F.col("date")) if "date" in df.columns and col == "timestamp" else cond


def _at(df: DataFrame, col: str, t: datetime) -> Column:
    day = F.lit(t.date().isoformat()).cast("date")
    return _dated(df, col, F.col(col) == ts_literal_like(df, col, t), lambda d: d == day)


def _before(df: DataFrame, col: str, t: datetime) -> Column:
    day = F.lit(t.date().isoformat()).cast("date")
    return _dated(df, col, F.col(col) < ts_literal_like(df, col, t), lambda d: d <= day)


def _after(df: DataFrame, col: str, t: datetime) -> Column:
    day = F.lit(t.date().isoformat()).cast("date")
    return _dated(df, col, F.col(col) > ts_literal_like(df, col, t), lambda d: d >= day)


def locate_ranks(df: DataFrame, ks: list, descending: bool = False, col: str = "timestamp") -> list:
    """Where the k-th rows (1-based) of the time order fall, for several k at once.

    For each k returns (T, before, at): T the k-th row's timestamp, `before`
    the number of rows strictly ahead of T in the order, `at` the number of
    rows at T; None when the table has fewer than k rows (NULL times are not
    ranked).  One aggregate job per level serves every k: it counts rows per
    bucket inside the parent buckets still in play.  A k may be a function of
    the row count, which the first level yields for free (so "the n/10-th row"
    needs no separate count pass).
    """
    us = F.unix_micros(F.col(col).cast("timestamp"))
    live = df.filter(F.col(col).isNotNull())
    state = [{"k": k, "rem": None, "before": 0, "lo": None, "w": None, "n": 0} for k in ks]
    for width in LEVELS:
        active = [t for t in state if t is not None]
        if not active:
            break
        parents = sorted({(t["lo"], t["w"]) for t in active if t["lo"] is not None})
        by_date = width == LEVELS[0] and "date" in df.columns
        # A NULL time has a NULL date, so the date test alone excludes it.
        scope = df.filter(F.col("date").isNotNull()) if by_date else live
        if parents:
            cond = None
            for lo, w in parents:
                c = _range(df, col, lo, lo + w)
                cond = c if cond is None else (cond | c)
            scope = live.filter(cond)
        bucket = F.floor(us / F.lit(width)).cast("long")
        if by_date:
            # Day buckets of a date-partitioned table: the partition value is the
            # timestamp's date, so the first level reads no column data at all.
            bucket = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("long")
        rows = (
            scope.groupBy(bucket.alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()  # bounded: days in the table, then <= 1,440 / 60,000 / 1,000 buckets per parent
        )
        rows.sort(key=lambda r: r["b"], reverse=descending)
        for i, t in enumerate(state):
            if t is None:
                continue
            if t["rem"] is None:  # first level: resolve k, possibly from the total
                k = t["k"](sum(r["n"] for r in rows)) if callable(t["k"]) else t["k"]
                if k <= 0:
                    state[i] = None
                    continue
                t["rem"] = k
            inside = rows if t["lo"] is None else [
                r for r in rows if t["lo"] <= r["b"] * width < t["lo"] + t["w"]]
            chosen = None
            for r in inside:
                if r["n"] >= t["rem"]:
                    chosen = r
                    break
                t["rem"] -= r["n"]
                t["before"] += r["n"]
            if chosen is None:
                state[i] = None
                continue
            t["lo"], t["w"], t["n"] = chosen["b"] * width, width, chosen["n"]
    return [None if t is None else (from_micros(t["lo"]), t["before"], t["n"]) for t in state]


def locate_rank(df: DataFrame, k: int, descending: bool = False, col: str = "timestamp"):
    """Single-k form of `locate_ranks`."""
    return locate_ranks(df, [k], descending, col)[0]


def kth_timestamp(df: DataFrame, k: int, descending: bool = False, col: str = "timestamp") -> datetime | None:
    found = locate_rank(df, k, descending, col)
    return found[0] if found else None


def _order(col: str, descending: bool, tiebreak: str | None) -> list[Column]:
    c = F.col(col)
    keys = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    if tiebreak:
        t = F.col(tiebreak)
        keys.append(t.desc_nulls_last() if descending else t.asc_nulls_last())
    return keys


def _small_page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def _fits(df: DataFrame, stop: int, small: int | None) -> bool:
    return stop <= small if small is not None else topk_fits(df, stop)


def rank_slice(df: DataFrame, start: int, stop: int, descending: bool = True, col: str = "timestamp",
               tiebreak: str | None = None, small: int | None = None) -> DataFrame:
    """Rows ranked [start, stop) (0-based) by (col, tiebreak) in one direction.

    A top-k when its single-task merge fits the budget (or `stop <= small` when
    a fixed bound is given).  Otherwise: locate the first and last row's
    timestamps, take every row strictly between them (a pushed-down range),
    and slice the rows at the two boundary timestamps by the tie-breaker.
    Rows without a time come last, in either direction, as in a plain sort.
    """
    start, stop = max(0, int(start)), max(0, int(stop))
    order = _order(col, descending, tiebreak)
    live = df.filter(F.col(col).isNotNull())
    if stop <= start:
        return df.limit(0)
    if _fits(df, stop, small):
        return _small_page(df, order, start, stop - start)
    first, last = locate_ranks(live, [start + 1, stop], descending, col)
    tie = _order(tiebreak, descending, None) if tiebreak else []
    by = [(tiebreak, descending)]
    untimed = None
    if last is None:
        # the window reaches past the rows with a time
        n = live.count()
        untimed = _boundary(df.filter(F.col(col).isNull()), tie, max(0, start - n), stop - max(n, start), by)
    if first is None:
        return untimed
    t_first, before_first, at_first = first
    head_skip = start - before_first
    if last is None:
        # fewer than `stop` rows: everything from the first row on
        beyond = _before(df, col, t_first) if descending else _after(df, col, t_first)
        head = _boundary(live.filter(_at(df, col, t_first)), tie, head_skip, at_first - head_skip, by)
        return head.unionByName(live.filter(beyond)).unionByName(untimed).orderBy(*order)
    t_last, before_last, _ = last
    if t_first == t_last:
        return _boundary(live.filter(_at(df, col, t_first)), tie, head_skip, stop - start, by).orderBy(*order)
    lo_t, hi_t = (t_last, t_first) if descending else (t_first, t_last)
    inner = live.filter(_after(df, col, lo_t) & _before(df, col, hi_t))
    head = _boundary(live.filter(_at(df, col, t_first)), tie, head_skip, at_first - head_skip, by)
    tail = _boundary(live.filter(_at(df, col, t_last)), tie, 0, stop - before_last, by)
    return head.unionByName(inner).unionByName(tail).orderBy(*order)


def _boundary(rows: DataFrame, tie: list[Column], offset: int, limit: int, keys: list[tuple[str, bool]] | None = None) -> DataFrame:
    """Rows of one timestamp, sliced by the tie-breaker.  Usually a handful; a
    heavily shared timestamp is cut by selection on the tie-breaker."""
    if limit <= 0:
        return rows.limit(0)
    if not tie:
        return rows.limit(limit) if offset == 0 else rows.offset(offset).limit(limit)
    if topk_fits(rows, offset + limit):
        return _small_page(rows, tie, offset, limit)
    return select_window(rows, offset, offset + limit, keys)


# Selection on a compound key -------------------------------------------------------


def _literal(df: DataFrame, name: str, value) -> Column:
    return ts_literal_like(df, name, value) if isinstance(value, datetime) else F.lit(value)


def _same(df: DataFrame, keys: list[tuple[str, bool]], at: tuple) -> Column:
    """The row has the key `at`."""
    out = F.lit(True)
    for (name, _), value in zip(keys, at):
        out = out & F.col(name).eqNullSafe(_literal(df, name, value))
    return out


def _ahead(df: DataFrame, keys: list[tuple[str, bool]], at: tuple) -> Column:
    """The row comes before the key `at` in the order (NULLs last)."""
    out = F.lit(False)
    for (name, descending), value in reversed(list(zip(keys, at))):
        c = F.col(name)
        if value is None:
            out = c.isNotNull() | (c.isNull() & out)
        else:
            x = _literal(df, name, value)
            out = F.coalesce(c > x if descending else c < x, F.lit(False)) | (c.eqNullSafe(x) & out)
    return out


def _between(df: DataFrame, keys: list[tuple[str, bool]], low: tuple | None, high: tuple | None) -> DataFrame:
    """Rows strictly between two keys; the leading column's range reaches the scan."""
    name, descending = keys[0]
    for at, inside in ((low, lambda: ~_ahead(df, keys, low) & ~_same(df, keys, low)), (high, lambda: _ahead(df, keys, high))):
        if at is None:
            continue
        c, after = F.col(name), at is low
        if at[0] is None:
            if after:
                df = df.filter(c.isNull())
        elif not after:
            x = _literal(df, name, at[0])
            df = df.filter(c >= x if descending else c <= x)
        df = df.filter(inside())
    return df


def _bucket(df: DataFrame, keys: list[tuple[str, bool]], splitters: list[tuple], lo: int, hi: int) -> Column:
    """2i: before splitter i, 2i + 1: at it; a binary search as nested conditions."""
    if lo == hi:
        return F.lit(2 * lo)
    mid = (lo + hi) // 2
    at = splitters[mid]
    return (F.when(_same(df, keys, at), F.lit(2 * mid + 1)).when(_ahead(df, keys, at), _bucket(df, keys, splitters, lo, mid))
            .otherwise(_bucket(df, keys, splitters, mid + 1, hi)))


def select_ranks(df: DataFrame, ranks: list[int], keys: list[tuple[str, bool]]) -> list[tuple[tuple, int, int] | None]:
    """(key, rows before it, rows at it) of the rows of some ranks (from 0) in the order of `keys`, (column, descending)
    pairs, NULLs last; None beyond the last row.

    Splitters sampled between the bounds known so far, exact counts between and at them, and the same again in
    the part that holds the rank, until it is small; only the key columns are read, nothing is sorted but a few keys,
    and a key shared by any number of rows is met as a splitter."""
    narrow = df.select(*[name for name, _ in keys])
    order = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in keys]
    total = narrow.count()
    found: dict[int, tuple | None] = {}
    parts = [{"low": None, "high": None, "before": 0, "n": total, "ranks": sorted({r for r in ranks if 0 <= r < total})}]
    while parts:
        part = parts.pop()
        if not part["ranks"]:
            continue
        inside = _between(narrow, keys, part["low"], part["high"])
        if part["n"] <= SMALL_PART:
            rows = [tuple(r) for r in inside.orderBy(*order).limit(SMALL_PART).collect()]
            for r in part["ranks"]:
                key = rows[r - part["before"]]
                alike = [i for i, x in enumerate(rows) if _alike(x, key)]
                found[r] = (key, part["before"] + alike[0], len(alike))
            continue
        sample = [tuple(r) for r in inside.sample(min(1.0, SAMPLE / part["n"]), seed=len(found) + part["before"] % 1000).orderBy(*order).collect()]
        if not sample:
            sample = [tuple(inside.first())]
        step = max(1, len(sample) // SPLITTERS)
        splitters: list[tuple] = []
        for x in sample[step // 2 :: step][:SPLITTERS]:
            if not splitters or not _alike(splitters[-1], x):
                splitters.append(x)
        counts = {r["b"]: r["n"] for r in inside.groupBy(_bucket(narrow, keys, splitters, 0, len(splitters)).alias("b")).agg(F.count("*").alias("n")).collect()}
        before = part["before"]
        for b in range(2 * len(splitters) + 1):
            n = counts.get(b, 0)
            own = [r for r in part["ranks"] if before <= r < before + n]
            if b % 2:
                found |= {r: (splitters[b // 2], before, n) for r in own}
            elif own:
                parts.append({"low": splitters[b // 2 - 1] if b else part["low"], "high": splitters[b // 2] if b < 2 * len(splitters) else part["high"],
                              "before": before, "n": n, "ranks": own})
            before += n
    return [found.get(r) for r in ranks]


def _alike(a: tuple, b: tuple) -> bool:
    """Equal keys, as the order sees them (NaN equals NaN)."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def select_window(df: DataFrame, start: int, stop: int, keys: list[tuple[str, bool]]) -> DataFrame:
    """Rows [start, stop) in the order of `keys`, found by selection on the key columns alone.

    The rows themselves are read once, by a filter between the keys of the window's first and last row;
    those at the two keys are cut to the number that belongs to it (rows alike in all keys by the hash of all their columns)."""
    start, stop = max(0, int(start)), max(0, int(stop))
    order = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in keys]
    if stop <= start:
        return df.limit(0)
    first, last = select_ranks(df, [start, stop - 1], keys)
    if first is None:
        return df.limit(0)
    low, before_low, at_low = first
    high, before_high, at_high = last if last is not None else (None, 0, 0)
    if last is not None and _alike(low, high):
        return _alikes(df, keys, low, at_low, start - before_low, stop - start).orderBy(*order)
    pieces = [_alikes(df, keys, low, at_low, start - before_low, at_low), _between(df, keys, low, high)]
    if last is not None:
        pieces.append(_alikes(df, keys, high, at_high, 0, stop - before_high))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order)


def _alikes(df: DataFrame, keys: list[tuple[str, bool]], at: tuple, n: int, skip: int, take: int) -> DataFrame:
    """`take` of the n rows at one key, after `skip`, in the order of a hash of the whole row."""
    rows = df.filter(_same(df, keys, at))
    if skip <= 0 and take >= n:
        return rows
    hashed = rows.withColumn("_whole", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    if n <= SMALL_PART:
        return _small_page(hashed, [F.col("_whole").asc()], skip, min(take, n - skip)).drop("_whole")
    if [k for k, _ in keys] == ["_whole"]:  # whole rows alike: any of them
        return rows.limit(min(take, n - skip))
    return select_window(hashed, skip, min(n, skip + take), [("_whole", False)]).drop("_whole")


def key_slice(df: DataFrame, start: int, stop: int, key: str, descending: bool, tiebreak: str | None,
              small: int | None = None) -> DataFrame:
    """Rows ranked [start, stop) by (key, tiebreak), NULL keys last both ways: a top-k if its merge
    fits, else selection on the compound key, whatever the number of distinct values."""
    start, stop = max(0, int(start)), max(0, int(stop))
    if stop <= start:
        return df.limit(0)
    keys = [(key, descending)] + ([(tiebreak, descending)] if tiebreak and tiebreak != key else [])
    if _fits(df, stop, small):
        return _small_page(df, [c for k, d in keys for c in _order(k, d, None)], start, stop - start)
    return select_window(df, start, stop, keys)

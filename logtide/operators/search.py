"""Log search: column choice, allow-listed sort, paging.

Paging plan.  A page is a top-k (`TakeOrderedAndProject`) when its merge is
small: each task keeps offset+limit rows and one task merges them, so the
size check is input partitions x (offset+limit) against a fixed budget.  A
larger page would overload that single merge, so it is cut out of the order
instead (`ranking`): by time, the
window's boundary timestamps are located by a bounded bucket descent; by a
column (host, unit, priority, command), by selection on the compound key
(column, cursor): sampled splitters and exact counts between them.
Rows between the boundaries are read by a pushed-down filter; rows that share a
boundary timestamp are cut by selection on the cursor.  Nothing but key columns is
read before the page, and nothing is checkpointed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.operators.predicates import log_filter, minute_equals
from logtide.operators.ranking import key_slice, rank_slice, topk_fits
from logtide.schemas import DEFAULT_COLUMNS, DISPLAY_NAMES, column_for
from logtide.session import checkpoint_dir

DEFAULT_LIMIT = 1000
TOPK_MAX_ROWS = 1_000
TIEBREAK = "__CURSOR"

# --- fixed values: sort names accepted by the search -------------------------
SORT_COLUMNS = {
    "timestamp": "timestamp",
    "hostname": "_HOSTNAME",
    "host": "_HOSTNAME",
    "unit": "_SYSTEMD_UNIT",
    "priority": "priority",
    "pri": "priority",
    "comm": "_COMM",
}
# --- end fixed values --------------------------------------------------------


def resolve_columns(columns: str | list[str] | None, strict: bool = True) -> list[str]:
    """Requested names (comma list, trimmed) matched case-insensitively to the schema.

    Unknown names are dropped.  With none left: error when strict (search),
    else the default columns (page).
    """
    if isinstance(columns, str):
        requested = [c.strip() for c in columns.split(",")] if columns else []
    else:
        requested = list(columns or [])
    if not requested:
        requested = list(DEFAULT_COLUMNS)
    found = [c for c in (column_for(r) for r in requested) if c is not None]
    if not found:
        if strict:
            raise ValueError("none of the requested columns is a column of the log table")
        found = [column_for(c) for c in DEFAULT_COLUMNS]
    return found


def display_name(col: str) -> str:
    return DISPLAY_NAMES.get(col.lower(), col)


def display_projection(cols: list[str]) -> list[Column]:
    """Display casts (timestamp, pid as text) and display names."""
    out = []
    for c in cols:
        expr = F.col(c)
        if c.lower() in ("timestamp", "_pid"):
            expr = expr.cast("string")
        out.append(expr.alias(display_name(c)))
    return out


def sort_columns(sort: str = "timestamp", sort_dir: str = "desc", tiebreak: str | None = TIEBREAK) -> list[Column]:
    """Allow-listed sort with NULLs last both ways and a tie-breaker for a total order."""
    col = SORT_COLUMNS.get((sort or "").lower(), "timestamp")
    asc = (sort_dir or "").lower() == "asc"
    keys = [F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()]
    if tiebreak and tiebreak != col:
        keys.append(F.col(tiebreak).asc_nulls_last() if asc else F.col(tiebreak).desc_nulls_last())
    return keys


def page(df: DataFrame, order: list[Column], limit: int = DEFAULT_LIMIT, offset: int = 0,
         topk_max_rows: int = TOPK_MAX_ROWS) -> DataFrame:
    """Rows [offset, offset+limit) of df in the given total order (any order).

    A top-k within `topk_max_rows`, else the checkpointed global sort.
    """
    limit, offset = max(0, int(limit)), max(0, int(offset))
    if offset + limit <= topk_max_rows:
        ordered = df.orderBy(*order)
        if offset:
            ordered = ordered.offset(offset)
        return ordered.limit(limit)
    return _deep_page(df, order, limit, offset)


def sorted_page(df: DataFrame, sort: str = "timestamp", sort_dir: str = "desc", limit: int = DEFAULT_LIMIT,
                offset: int = 0, topk_max_rows: int | None = None) -> DataFrame:
    """F1 + F2: one page of the allow-listed sort.

    A page is a top-k when its single-task merge (input partitions x
    (offset+limit) rows) fits the merge budget, or within `topk_max_rows` when
    a fixed bound is given.  Otherwise it never merges offset+limit rows per
    task in one place: by time they locate the window's boundary timestamps
    (bucket descent), by another column selection finds the window's first and last key.
    """
    limit, offset = max(0, int(limit)), max(0, int(offset))
    col = SORT_COLUMNS.get((sort or "").lower(), "timestamp")
    asc = (sort_dir or "").lower() == "asc"
    fits = offset + limit <= topk_max_rows if topk_max_rows is not None else topk_fits(df, offset + limit)
    if fits:
        return page(df, sort_columns(sort, sort_dir), limit, offset, offset + limit)
    if col == "timestamp":
        return rank_slice(df, offset, offset + limit, descending=not asc, col=col, tiebreak=TIEBREAK,
                          small=topk_max_rows)
    return key_slice(df, offset, offset + limit, col, descending=not asc, tiebreak=TIEBREAK, small=topk_max_rows)


def _deep_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of any order at all, by a checkpointed sort; the allow-listed sorts do not need it."""
    checkpoint_dir(df.sparkSession)
    numbered = (
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
        .checkpoint(eager=True)
    )
    # One row per sorted partition: rows before it in the global order.
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
    ).fillna(0, subset=["_before"])
    rank = F.col("_before") + F.col("_pos")
    return (
        numbered.join(F.broadcast(before), "_part")
        .filter((rank >= offset) & (rank < offset + limit))
        .orderBy(*order)
        .drop("_part", "_pos", "_before")
    )


def search(
    df: DataFrame,
    now: datetime,
    start="-1h",
    end="now",
    q=None,
    hostname=None,
    unit=None,
    priority=None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    sort: str = "timestamp",
    sort_dir: str = "desc",
    columns=None,
    topk_max_rows: int | None = None,
) -> DataFrame:
    """Filter, sort, page, then project with display names."""
    cols = resolve_columns(columns, strict=True)
    matched = log_filter(df, now, start, end, q, hostname, unit, priority)
    rows = sorted_page(matched, sort, sort_dir, limit, offset, topk_max_rows)
    return rows.select(*display_projection(cols))


def search_total(df: DataFrame, now: datetime, start="-1h", end="now", q=None, hostname=None, unit=None, priority=None) -> DataFrame:
    """Number of matching rows (the full total, not the page length)."""
    return log_filter(df, now, start, end, q, hostname, unit, priority).agg(F.count(F.lit(1)).alias("total"))


def page_state(total: Column, offset: int, returned: Column) -> list[Column]:
    """next offset and `more` / `none` / `end`."""
    loaded_end = F.lit(int(offset)) + returned
    state = F.when(loaded_end < total, "more").when(total == 0, "none").otherwise("end")
    return [
        total.alias("total"),
        F.lit(int(offset)).cast("long").alias("offset"),
        returned.alias("returned"),
        F.when(loaded_end < total, loaded_end).alias("next_offset"),
        state.alias("state"),
    ]


def search_page(df: DataFrame, now: datetime, start="-1h", end="now", q=None, hostname=None, unit=None,
                priority=None, limit: int = DEFAULT_LIMIT, offset: int = 0, sort: str = "timestamp",
                sort_dir: str = "desc", columns=None) -> tuple[DataFrame, DataFrame]:
    """Page rows (unknown columns fall back to defaults) and a one-row page state.

    The state is computed from the total alone: the page length is
    min(limit, max(total - offset, 0)), so no second pass over the page is needed.
    """
    cols = resolve_columns(columns, strict=False)
    matched = log_filter(df, now, start, end, q, hostname, unit, priority)
    rows = sorted_page(matched, sort, sort_dir, limit, offset).select(*display_projection(cols))
    lim = max(0, int(limit))
    total = matched.agg(F.count(F.lit(1)).alias("total"))
    returned = F.least(F.lit(lim).cast("long"), F.greatest(F.col("total") - F.lit(int(offset)), F.lit(0)))
    state = total.select(*page_state(F.col("total"), offset, returned))
    return rows, state


def entries_for_minute(df: DataFrame, minute: datetime) -> DataFrame:
    """all entries of one minute in time order (cursor breaks ties)."""
    return df.filter(minute_equals(df, minute)).orderBy(F.col("timestamp").asc(), F.col(TIEBREAK).asc())

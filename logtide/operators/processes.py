"""Process samples: typing, de-duplication, latest snapshot, process table
(B7-B10, D9, D10, F4, G11, I6, I7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import (
    cmdline,
    fixed1,
    fuzzy,
    human_bytes,
    human_runtime,
    memory_percent,
    search_text,
    ts_literal_like,
    uid_text,
)
from logtide.operators.ranking import select_window, topk_fits
from logtide.schemas import PROCESS_SCHEMA
from logtide.sources.tables import listed_dates

DEFAULT_LIMIT = 100

# --- fixed values: sort names accepted by the process table -------------------
SORT_COLUMNS = {
    "pid": "pid",
    "ppid": "parent_pid",
    "name": "name",
    "status": "status",
    "cpu": "cpu_usage",
    "mem": "mem_usage",
    "virt": "virtual_memory",
    "user": "user",
    "runtime": "runtime",
    "cmdline": "cmdline",
}
# --- end fixed values ---------------------------------------------------------


def to_process_metrics(samples: DataFrame) -> DataFrame:
    """Raw sampler rows -> process_metrics columns (uid text, joined command)."""
    cols = {
        "timestamp": F.col("timestamp").cast("timestamp_ntz"),
        "pid": F.col("pid").cast("int"),
        "name": F.col("name"),
        "cpu_usage": F.col("cpu_percent").cast("double"),
        "mem_usage": F.col("memory_bytes").cast("double"),
        "user": uid_text("user_id"),
        "runtime": F.col("runtime_secs").cast("long"),
        "cmdline": cmdline("cmd"),
        "virtual_memory": F.col("virtual_memory_bytes").cast("double"),
        "status": F.col("status"),
        "parent_pid": F.col("parent_pid").cast("int"),
    }
    extra = [c for c in samples.columns if c == "seq"]
    return samples.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in PROCESS_SCHEMA.fields], *extra)


def dedupe_samples(df: DataFrame, order_col: str | None = "seq") -> DataFrame:
    """One row per (timestamp, pid), the first to arrive.

    With an arrival column the first row is picked by `min_by` in a hash
    aggregate (partial per task, so a hot key is combined before the shuffle);
    without one, `dropDuplicates` keeps an arbitrary row.
    """
    if order_col is None or order_col not in df.columns:
        return df.dropDuplicates(["timestamp", "pid"])
    rest = [c for c in df.columns if c not in ("timestamp", "pid", order_col)]
    picked = df.groupBy("timestamp", "pid").agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order_col)).alias("_r")
    )
    return picked.select("timestamp", "pid", *[F.col(f"_r.{c}").alias(c) for c in rest])


def one_per_key(df: DataFrame, order_col: str | None = "seq") -> DataFrame:
    """B10 by a fixed rule in either case: the first to arrive, or without an arrival column the
    least row of each (timestamp, pid).  The columns keep their order, the arrival column goes."""
    columns = [c for c in df.columns if c != order_col]
    if order_col in df.columns:
        return dedupe_samples(df, order_col).select(*columns)
    rest = [c for c in columns if c not in ("timestamp", "pid")]
    least = df.groupBy("timestamp", "pid").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_r"))
    return least.select("timestamp", "pid", "_r.*").select(*columns) if rest else df.distinct()


def latest_timestamp(procs: DataFrame):
    """Newest sample time, as a scalar.

    On a date-partitioned table the newest date comes from the file listing, so the
    timestamp maximum reads one date's timestamp column (or, behind a filter
    that the newest dates do not pass, a date after the other)."""
    dates = listed_dates(procs)
    # As a zone-less value, so the driver sees the UTC wall clock whatever its own zone.
    newest = lambda scope: scope.agg(F.max(F.col("timestamp").cast("timestamp_ntz"))).first()[0]
    if dates is None:
        return newest(procs)
    found = (newest(procs.filter(F.col("date") == F.lit(d.isoformat()).cast("date"))) for d in dates)
    return next((t for t in found if t is not None), None)


def snapshot(procs: DataFrame, ts) -> DataFrame:
    """Rows of one sample set; the time literal reaches the Parquet scan."""
    if ts is None:
        return procs.limit(0)
    cond = F.col("timestamp") == ts_literal_like(procs, "timestamp", ts)
    if "date" in procs.columns:
        cond = cond & (F.col("date") == F.lit(ts.date().isoformat()).cast("date"))
    return procs.filter(cond)


def latest_processes(procs: DataFrame) -> DataFrame:
    """Every row of the newest sample set, with the set's size.

    The newest time is found first (one column, one aggregate), then the set
    is a filtered scan: row groups and dates without that time are skipped.
    The total is a one-row aggregate of the same small set, broadcast back.
    """
    snap = snapshot(procs, latest_timestamp(procs))
    total = snap.agg(F.count(F.lit(1)).alias("total"))
    return snap.crossJoin(F.broadcast(total))


def _matching(procs: DataFrame, q: str | None) -> DataFrame:
    snap = snapshot(procs, latest_timestamp(procs))
    return snap.filter(fuzzy(search_text(), q.lower())) if q is not None and q.strip() else snap


def _process_keys(sort: str, sort_dir: str) -> list[tuple[str, bool]]:
    """Allow-listed sort by a shown column; the pid breaks ties, ascending."""
    col = SORT_COLUMNS.get((sort or "").lower(), "cpu_usage")
    keys = [(col, (sort_dir or "").lower() != "asc")]
    return keys if col == "pid" else [*keys, ("pid", False)]


def process_sort(sort: str = "cpu", sort_dir: str = "desc") -> list[Column]:
    """The same as sort columns, NULLs last."""
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in _process_keys(sort, sort_dir)]


def _page(rows: DataFrame, sort: str, sort_dir: str, limit: int, offset: int) -> DataFrame:
    limit, offset = max(0, int(limit)), max(0, int(offset))
    if not topk_fits(rows, offset + limit):
        return select_window(rows, offset, offset + limit, _process_keys(sort, sort_dir))
    rows = rows.orderBy(*process_sort(sort, sort_dir))
    return (rows.offset(offset) if offset else rows).limit(limit)


def process_table(procs: DataFrame, q: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
                  sort: str = "cpu", sort_dir: str = "desc") -> DataFrame:
    """Newest snapshot, fuzzy search, CPU order (pid breaks ties) or that of another
    shown column, one page, with the display texts (bytes, runtime, memory percent)."""
    return _page(_matching(procs, q), sort, sort_dir, limit, offset).select(
        "timestamp", "pid", "name", "cpu_usage", "mem_usage", "user", "runtime", "cmdline",
        F.coalesce(F.col("virtual_memory"), F.lit(0.0)).alias("virtual_memory"), "status", "parent_pid",
        human_bytes("mem_usage").alias("mem_text"),
        human_runtime("runtime").alias("runtime_text"),
        memory_percent("mem_usage").alias("mem_percent"),
    )


def process_page(procs: DataFrame, q: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
                 sort: str = "cpu", sort_dir: str = "desc") -> tuple[DataFrame, DataFrame]:
    """The page as it is shown (every column as text), and a one-row page state with
    the snapshot's time (total, next offset, `more` / `none` / `end`)."""
    from logtide.operators.search import page_state

    newest = latest_timestamp(procs)
    matched = snapshot(procs, newest)
    if q is not None and q.strip():
        matched = matched.filter(fuzzy(search_text(), q.lower()))
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"{c}_text")
    rows = _page(matched, sort, sort_dir, limit, offset).select(
        "timestamp", "pid", dash("parent_pid"), "name", dash("status"),
        F.concat(fixed1("cpu_usage"), F.lit("%")).alias("cpu_text"), human_bytes("mem_usage").alias("mem_text"),
        human_bytes(F.coalesce("virtual_memory", F.lit(0.0))).alias("virtual_memory_text"),
        dash("user"), human_runtime("runtime").alias("runtime_text"), dash("cmdline"))
    total = matched.agg(F.count(F.lit(1)).alias("total"))
    returned = F.least(F.lit(max(0, int(limit))).cast("long"), F.greatest(F.col("total") - F.lit(max(0, int(offset))), F.lit(0)))
    at = F.lit(None).cast("timestamp_ntz") if newest is None else F.lit(newest.isoformat(sep=" ")).cast("timestamp_ntz")
    return rows, total.select(at.alias("snapshot"), *page_state(F.col("total"), offset, returned))

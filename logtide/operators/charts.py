"""Timechart (G1, I3), its pivot (G12) and stacked series.

The chart is one hash aggregate with map-side partial counts; its output is
bounded by minutes x levels in the range, whatever the data volume, so the
post-processing (pivot, stacking) works on a small frame.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import PRIORITY_LABELS, UNKNOWN_LABEL, priority_label, truncate_like
from logtide.operators.predicates import log_filter

DEFAULT_LEVEL = 6  # a NULL priority is charted as Info


def timechart(df: DataFrame, now: datetime, start="-1h", end="now", q=None, hostname=None, unit=None,
              priority=None) -> DataFrame:
    """Counts per one-minute bin and priority, with the level name, ordered by both."""
    matched = log_filter(df, now, start, end, q, hostname, unit, priority)
    return (
        matched.groupBy(
            truncate_like(matched, "timestamp", "minute").alias("time_bin"),
            F.coalesce(F.col("priority"), F.lit(DEFAULT_LEVEL)).alias("priority"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("level", priority_label(F.col("priority")))
        .select("time_bin", "priority", "level", "count")
        .orderBy("time_bin", "priority")
    )


def timechart_pivot(chart: DataFrame) -> DataFrame:
    """One row per bin, one zero-filled count column per level; Unknown counts as Info."""
    level = F.when(F.col("level") == UNKNOWN_LABEL, F.lit("Info")).otherwise(F.col("level"))
    return (
        chart.withColumn("level", level)
        .groupBy("time_bin")
        .pivot("level", PRIORITY_LABELS)
        .agg(F.sum("count"))
        .fillna(0, subset=PRIORITY_LABELS)
        .select("time_bin", *[F.col(c).cast("long").alias(c) for c in PRIORITY_LABELS])
        .orderBy("time_bin")
    )


def timechart_stacked(pivot: DataFrame) -> DataFrame:
    """Long form with lower/upper stack bounds per level and the highest stack.

    Stacking is a running sum within each bin (levels in severity order), so the
    window partitions by bin; the overall maximum is a one-row aggregate joined
    back by broadcast.
    """
    pairs = ", ".join(f"{i}, '{name}', `{name}`" for i, name in enumerate(PRIORITY_LABELS))
    long = pivot.selectExpr("time_bin", f"stack({len(PRIORITY_LABELS)}, {pairs}) as (level_order, level, count)")
    w = Window.partitionBy("time_bin").orderBy("level_order").rowsBetween(Window.unboundedPreceding, 0)
    stacked = long.withColumn("upper", F.sum("count").over(w)).withColumn("lower", F.col("upper") - F.col("count"))
    top = pivot.select(sum(F.col(c) for c in PRIORITY_LABELS).alias("bin_total")).agg(
        F.coalesce(F.max("bin_total"), F.lit(0)).cast("long").alias("max_stack")
    )
    return stacked.crossJoin(F.broadcast(top)).select(
        "time_bin", "level_order", "level", "count", "lower", "upper", "max_stack"
    )

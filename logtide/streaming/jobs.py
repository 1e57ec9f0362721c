"""Structured Streaming forms of the live flows (K1-K4).

Micro-batches are appended by the same batch writers the table jobs use
(`foreachBatch`), not by the streaming file sink: a file sink keeps its own
metadata log, and readers of a path with that log ignore files written by batch
jobs (retention rewrites, compaction).  An epoch's files carry its name, and records
beside the table say how far it has come: staged whole, or in.  A replay goes on from
there, and it adds nothing once the epoch is in, also after its files were compacted,
cut by retention or deleted; a batch is in the table once, whole, however often it is tried.

K1  log ingest: text files -> fields map -> typed rows -> the stored table
    (stateless; the checkpoint replaces the journal cursor).
K2  sample ingest: one row per (timestamp, pid), compared with the stored dates
    the batch touches.  No watermark: a sample may come as late as it likes.
K3  live timechart: each batch appends its counts per minute and level; the
    chart adds them up, so open bins and late rows are in it; count files are merged level by level.  `live_timechart`
    is the windowed form (append mode) for sinks that want closed bins only.
K4  live ingest summary: the same with five-minute windows per source.

Checkpoints go beside the output, or where a location is given.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtide.functions.columns import priority_label
from logtide.operators.charts import DEFAULT_LEVEL
from logtide.operators.ingest import parse_entries
from logtide.operators.maintenance import absent_keys, write_logs, write_process_metrics
from logtide.operators.processes import one_per_key, to_process_metrics
from logtide.sources.files import TableFiles
from logtide.sources.journal import accepted_rows, line_report, rejected_lines
from logtide.sources.tables import read_process_metrics
from logtide.streaming.merging import FAN, merge_counts, read_counts


def _checkpoint(path: str, location: str | None) -> str:
    """A checkpoint of its own for every output path."""
    return location or f"{path.rstrip('/')}-checkpoint"


def typed_log_stream(entries: DataFrame, now: datetime | None = None) -> DataFrame:
    """K1 transform: stateless; entries without a clock get `now` (by default
    the micro-batch's current time)."""
    return parse_entries(entries, now).withColumn("date", F.to_date("timestamp"))


def _run_name(table: TableFiles, checkpoint: str) -> str:
    """Names a stream by the id in its checkpoint, so that a stream begun anew counts its epochs anew."""
    try:
        text = table.read_at(f"{checkpoint.rstrip('/')}/metadata")
    except Exception:  # a folder that cannot be read names itself
        text = None
    return hashlib.md5((text or checkpoint).encode()).hexdigest()[:12]


def _append_once(write, path: str, checkpoint: str, prepare=None):
    """foreachBatch body: the micro-batch's rows as this epoch's files.

    The rows are written beside the table first (`prepare` may compare them with the stored table) and
    recorded as staged, then moved in by renaming and recorded as in.  A replay writes only what
    was not staged, moves only what is still staged, and skips what is in."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        table = TableFiles(spark, path)
        run_name = _run_name(table, checkpoint)
        prefix, name = f"epoch-{run_name}-{epoch_id}-", f"{run_name}-{epoch_id}"
        state = table.epoch_state(run_name, epoch_id)
        if state == "skip":
            return
        if state == "write":
            table.delete(table.files(prefix))
            rows = prepare(batch) if prepare else batch
            write(rows, table.stage(name))
            table.epoch_staged(run_name, epoch_id)
        table.move_in(f"{table.path}/_stage-{name}", prefix)
        table.epoch_done(run_name, epoch_id)

    return run


def start_log_ingest(entries: DataFrame, now: datetime | None, path: str, checkpoint: str | None = None,
                     trigger: dict | None = None) -> StreamingQuery:
    """Append typed rows to the date-partitioned log table."""
    ckpt = _checkpoint(path, checkpoint)
    w = (
        typed_log_stream(entries, now).drop("date")
        .writeStream.foreachBatch(_append_once(write_logs, path, ckpt))
        .option("checkpointLocation", ckpt)
    )
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def _dated_parts(rows: DataFrame, stage: str) -> None:
    """Rows with their `date`, as they come."""
    rows.write.partitionBy("date").parquet(stage)


def ingest_lines(lines: DataFrame, now: datetime | None, path: str, rejects: str, checkpoint: str, epoch: int) -> None:
    """One batch of journal lines: accepted ones into the table, the others with their reason into
    `rejects`/lines, and lines, accepted, not_json and bad_clock into `rejects`/counts.

    The lines are parsed once, and once more only if some were rejected: how many were accepted is in the
    footers of the files just written, how many lines there are takes no parse.  Each output has records of
    its own, so a replay completes what is missing and repeats nothing."""
    spark = lines.sparkSession
    table = TableFiles(spark, path)
    run_name = _run_name(table, checkpoint)
    known = table.epoch_state(run_name, epoch) != "skip"
    _append_once(write_logs, path, checkpoint, lambda b: accepted_rows(b, now))(lines, epoch)
    day = F.current_date() if now is None else F.lit(now.date().isoformat()).cast("date")

    def counted(batch: DataFrame) -> DataFrame:
        files = table.files(f"epoch-{run_name}-{epoch}-")
        if known:
            accepted = spark.read.schema("timestamp timestamp_ntz").parquet(*files).count() if files else 0
            n = batch.count()
        else:  # the table had the epoch already, perhaps in other files by now
            n, _, accepted, _ = line_report(batch, now).first()
        reasons = {}
        if n != accepted:
            _append_once(_dated_parts, f"{rejects}/lines", checkpoint, lambda b: rejected_lines(b, now).withColumn("date", day))(batch, epoch)
            side = TableFiles(spark, f"{rejects}/lines").files(f"epoch-{run_name}-{epoch}-")
            reasons = {r["reason"]: r["count"] for r in spark.read.schema("reason string").parquet(*side).groupBy("reason").count().collect()}
        row = [(epoch, n, accepted, reasons.get("not_json", 0), reasons.get("bad_clock", 0))]
        return spark.createDataFrame(row, "epoch long, lines long, accepted long, not_json long, bad_clock long").coalesce(1).withColumn("date", day)

    _append_once(_dated_parts, f"{rejects}/counts", checkpoint, counted)(lines, epoch)


def start_journal_ingest(lines: DataFrame, now: datetime | None, path: str, rejects: str, checkpoint: str | None = None,
                         trigger: dict | None = None) -> StreamingQuery:
    """K1 / C3 over raw lines (`value`), with what is not accepted kept and counted (`ingest_lines`)."""
    ckpt = _checkpoint(path, checkpoint)
    w = lines.writeStream.foreachBatch(lambda batch, epoch: ingest_lines(batch, now, path, rejects, ckpt, epoch)).option("checkpointLocation", ckpt)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_rejects(spark, rejects: str) -> DataFrame:
    """(reason, line, date) of everything rejected."""
    return spark.read.schema("reason string, line string, date date").parquet(f"{rejects}/lines")


def read_ingest_counts(spark, rejects: str) -> DataFrame:
    """(epoch, lines, accepted, not_json, bad_clock, date), a row a batch; accepted + not_json + bad_clock = lines."""
    return spark.read.schema("epoch long, lines long, accepted long, not_json long, bad_clock long, date date").parquet(f"{rejects}/counts")


def new_samples(batch: DataFrame, path: str) -> DataFrame:
    """Typed samples of a batch that the stored table lacks, one per (timestamp, pid).

    Of equal keys in a batch the least row stays (a fixed rule: files of a batch have
    no order).  Only the stored dates between the batch's first and last are read,
    and of those only keys that a Bloom filter of the batch's keys lets through."""
    own = one_per_key(to_process_metrics(batch), None)
    spark = batch.sparkSession
    if not TableFiles(spark, path).files():
        return own
    first, last = own.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()
    if first is None:
        return own
    days = [F.lit(d.isoformat()).cast("date") for d in (first, last)]
    stored = read_process_metrics(spark, path).where(F.col("date").between(*days))
    return absent_keys(own, stored, ["timestamp", "pid"])


def start_sample_ingest(samples: DataFrame, path: str, checkpoint: str | None = None,
                        watermark: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append the samples that the date-partitioned table lacks.

    `watermark` is accepted for callers of the windowed form and has no effect:
    no sample is too late."""
    ckpt = _checkpoint(path, checkpoint)
    w = (
        samples.writeStream.foreachBatch(_append_once(write_process_metrics, path, ckpt, lambda b: new_samples(b, path)))
        .outputMode("append")
        .option("checkpointLocation", ckpt)
    )
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def _start_counts(rows: DataFrame, count, keys: tuple[str, ...], path: str, checkpoint: str | None, trigger: dict | None) -> StreamingQuery:
    """Append each batch's counts; no state is kept, counts of later batches add up on reading.

    Every `FAN`-th batch merges the count files of the dates (`merging`), so their number stays small."""
    def write(batch: DataFrame, stage: str) -> None:
        count(batch).withColumn("date", F.to_date(F.col("bin"))).repartitionByRange("date").write.partitionBy("date").parquet(stage)

    ckpt = _checkpoint(path, checkpoint)
    append = _append_once(write, path, ckpt)

    def run(batch: DataFrame, epoch: int) -> None:
        append(batch, epoch)
        if epoch % FAN == FAN - 1:
            merge_counts(batch.sparkSession, path, keys)

    w = rows.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def start_live_timechart(logs: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """K3: counts per minute and level of every batch, kept under `path`."""
    def count(batch: DataFrame) -> DataFrame:
        minute = F.date_trunc("minute", F.col("timestamp")).cast("timestamp_ntz")
        return batch.groupBy(minute.alias("bin"), F.coalesce("priority", F.lit(DEFAULT_LEVEL)).alias("priority")).agg(F.count("*").alias("n"))

    return _start_counts(logs, count, ("bin", "priority"), path, checkpoint, trigger)


def read_live_timechart(spark, path: str) -> DataFrame:
    """The chart of everything ingested so far, open bins included."""
    parts = read_counts(spark, path, "bin timestamp_ntz, priority int, n long, date date")
    sums = parts.groupBy("bin", "priority").agg(F.sum("n").alias("count"))
    return sums.select(F.col("bin").alias("time_bin"), "priority", priority_label(F.col("priority")).alias("level"), "count")


def start_live_summary(rows: DataFrame, source: str, path: str, checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """K4: rows per source and five minutes of every batch, kept under `path`."""
    def count(batch: DataFrame) -> DataFrame:
        window = F.window(F.col("timestamp").cast("timestamp"), "5 minutes")
        return batch.groupBy(window.start.cast("timestamp_ntz").alias("bin")).agg(F.count("*").alias("n")).withColumn("source", F.lit(source))

    return _start_counts(rows, count, ("bin", "source"), path, checkpoint, trigger)


def read_live_summary(spark, path: str) -> DataFrame:
    parts = read_counts(spark, path, "bin timestamp_ntz, n long, source string, date date")
    sums = parts.groupBy("bin", "source").agg(F.sum("n").alias("rows"))
    return sums.select(F.col("bin").alias("window_start"), (F.col("bin") + F.expr("INTERVAL 5 MINUTES")).alias("window_end"), "source", "rows")


def live_timechart(logs: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """K3: one-minute bins x level over a typed log stream (append mode)."""
    t = F.col("timestamp").cast("timestamp")
    return (
        logs.withColumn("_event_time", t)
        .withWatermark("_event_time", watermark)
        .groupBy(
            F.window("_event_time", "1 minute").alias("w"),
            F.coalesce(F.col("priority"), F.lit(DEFAULT_LEVEL)).alias("priority"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("time_bin"),
            "priority",
            priority_label(F.col("priority")).alias("level"),
            "count",
        )
    )


def live_ingest_summary(df: DataFrame, source: str, watermark: str = "10 minutes") -> DataFrame:
    """K4: rows per source in five-minute event-time windows."""
    return (
        df.withColumn("_event_time", F.col("timestamp").cast("timestamp"))
        .withWatermark("_event_time", watermark)
        .groupBy(F.window("_event_time", "5 minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            F.lit(source).alias("source"),
            "rows",
        )
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Drive a stream over everything available into a Parquet table (append
    mode, exactly-once file sink); results stay on the shared file system,
    never in driver memory."""
    q = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q

"""Table scans of the supplied parquet tables and of stored logs / metrics (A10)."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from logtide.schemas import EVENTS_SCHEMA, JOURNAL_SCHEMA, PROCESS_SCHEMA
from logtide.session import ensure_utc
from logtide.sources.derived import (
    journal_logs_from_events,
    process_metrics_from_events,
    raw_journal_lines_from_events,
    raw_samples_from_events,
)


def _with_date(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("date", T.DateType(), True)])


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer splits than the cluster has cores.

    A single small file (one row group) is read by one task; the row-wise work
    after it (JSON, typing, formatting) would then run serially.  Large inputs
    already have many splits, so for them this adds nothing and no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:  # a bare scan: plans the file splits, runs nothing
        return df.repartition(cores)
    return df


def listed_dates(df: DataFrame) -> list[Date] | None:
    """Dates of the files behind a date-partitioned frame, newest first, from the listing Spark
    already holds; None for any other frame.  No file is opened."""
    if "date" not in df.columns:
        return None
    names = {p.rsplit("/", 2)[1] for p in df.inputFiles()}
    if not names or not all(n.startswith("date=") for n in names):
        return None
    days = [n.split("=", 1)[1] for n in names]
    return sorted((Date.fromisoformat(d) for d in days if d[:1].isdigit()), reverse=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with its declared schema (no footer inference pass)."""
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Stored journal logs (date-partitioned parquet) with the declared schema."""
    ensure_utc(spark)
    return spark.read.schema(_with_date(JOURNAL_SCHEMA)).parquet(path)


def read_logs_with_text(spark: SparkSession, path: str, q: str | None) -> DataFrame:
    """D3 on a stored table: the rows of files whose messages may hold `q`; the search itself still decides.

    Files are left out by their trigram signatures (measured once for each file); a text of less than
    three bytes reads everything."""
    from logtide.sources.ledger import Trigrams

    files = Trigrams(spark, path).files_with(q) if q else None
    if files is None:
        return read_logs(spark, path)
    ensure_utc(spark)
    reader = spark.read.schema(_with_date(JOURNAL_SCHEMA)).option("basePath", path)
    return reader.parquet(*files) if files else read_logs(spark, path).limit(0)


def read_process_metrics(spark: SparkSession, path: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.schema(_with_date(PROCESS_SCHEMA)).parquet(path)


# Fixture tables derived from `events` ------------------------------------------


def journal_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return journal_logs_from_events(read_events(spark, sf_dir))


def process_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return process_metrics_from_events(read_events(spark, sf_dir))


def raw_journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    # JSON building and parsing are row-wise CPU work: spread a single-split scan.
    return raw_journal_lines_from_events(spread(read_events(spark, sf_dir)))


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return raw_samples_from_events(read_events(spark, sf_dir))

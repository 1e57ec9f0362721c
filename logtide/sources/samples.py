"""Process sample source (A9), re-aimed at sample files written by any sampler.

Samples are JSON lines (or Parquet) with an explicit schema: no inference pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.schemas import RAW_SAMPLE_SCHEMA
from logtide.session import ensure_utc


def read_process_samples(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    ensure_utc(spark)
    return spark.read.schema(RAW_SAMPLE_SCHEMA).format(fmt).load(path)


def stream_process_samples(spark: SparkSession, path: str, fmt: str = "json",
                           max_files_per_trigger: int | None = None) -> DataFrame:
    ensure_utc(spark)
    reader = spark.readStream.schema(RAW_SAMPLE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)

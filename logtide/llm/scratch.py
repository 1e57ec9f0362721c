"""Written intermediate tables: lineage is cut by Parquet in the shared folder
named by spark.checkpoint.dir, never by a machine-local copy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logtide.session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (the path only; nothing is made)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` computed once, written as Parquet in the shared folder and read back.

    Later uses read the table: a lost executor costs a re-read, not the lineage."""
    path = new_folder(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)

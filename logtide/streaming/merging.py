"""Merging of the count files that live charts and summaries append, level by level.

Every micro-batch adds a file of counts a date.  `FAN` files of one level of a date are added up
into one of the next level, so a date has at most (FAN - 1) files a level, and as many
levels as the logarithm of its batches: what a chart reads no longer grows with the number of batches.

A merge is visible at once or not at all.  Its record names what it replaces; until the record
is ended, readers leave the new files out, from then on the old ones.  The old files stay for a
lease after that, for readers that listed them before.  A merge that died is ended as void by the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.sources.files import TableFiles, date_of

FAN = 8
IN, VOID = "in", "void"


def _records(table: TableFiles) -> list[tuple[str, dict, str | None]]:
    """(merge, what it replaces, how it ended) of all merges."""
    out = []
    for name in table._names("_merged"):
        if not name.endswith(".end"):
            text = table.read(f"_merged/{name}")
            if text is not None:
                out.append((name, json.loads(text), table.read(f"_merged/{name}.end")))
    return out


def _level(file: str) -> int:
    name = file.rsplit("/", 1)[1]
    return int(name[1:].split("-", 1)[0]) if name.startswith("m") and name[1:2].isdigit() else 0


def _key(file: str) -> str:
    return "/".join(file.rsplit("/", 2)[1:])


def live_files(table: TableFiles, dates: list[str] | None = None) -> list[str]:
    """Files whose counts add up to the truth: of a merge either what it replaced or what it made.

    Records are read before the listing: a merge that is in had all its files there by then."""
    records = _records(table)
    gone = {k for _, noted, end in records if end == IN for k in noted["old"]}
    hidden = [f"-{name}-" for name, _, end in records if end != IN]
    return [p for p in table.files(dates=dates) if _key(p) not in gone and not any(h in p for h in hidden)]


def read_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The counts of all batches, each once."""
    files = live_files(TableFiles(spark, path))
    reader = spark.read.schema(schema)
    return reader.option("basePath", path).parquet(*files) if files else spark.createDataFrame([], schema)


def _tidy(table: TableFiles) -> None:
    """Files of void merges go at once, those that a merge has replaced after a lease, then its record."""
    for name, noted, end in _records(table):
        if end == VOID:
            table.delete([p for p in table.files() if f"-{name}-" in p])
            table.drop(f"_stage-{name}")
        elif end is None or table.age(f"_merged/{name}.end") <= table.lease:
            continue
        else:
            table.delete([f"{table.path}/{k}" for k in noted["old"]])
        table.delete([f"{table.path}/_merged/{name}", f"{table.path}/_merged/{name}.end"])


def merge_counts(spark: SparkSession, path: str, keys: Sequence[str], dates: list[str] | None = None, fan: int = FAN, table: TableFiles | None = None) -> int:
    """Add up `fan` or more files of a level, date by date, until no level has so many; returns the number of merges.

    keys: the columns beside `n` and `date`.  Dates that another job holds are left to it."""
    table = table or TableFiles(spark, path)
    done = 0
    _tidy(table)
    while True:
        groups: dict[tuple[str, int], list[str]] = {}
        for p in live_files(table, dates):
            groups.setdefault((date_of(p), _level(p)), []).append(p)
        full = {k: v for k, v in groups.items() if len(v) >= fan}
        if not full:
            return done
        # the lowest full level of every date, all in one job
        lowest = {d: min(level for day, level in full if day == d) for d, _ in full}
        job = uuid.uuid4().hex[:12]
        if not table.claim(job, sorted(lowest)):
            table.call_off(None)
            return done
        for name, _, end in _records(table):  # whoever held these dates before has either ended or died
            if end is None and set(json.loads(table.read(f"_merged/{name}") or '{"dates": []}')["dates"]) & set(lowest):
                table.publish(f"_merged/{name}.end", VOID)
        live = set(live_files(table, sorted(lowest)))
        old = [p for d, level in lowest.items() for p in full[d, level] if p in live]
        if old:
            level = max(lowest.values()) + 1
            table.publish(f"_merged/{job}", json.dumps({"dates": sorted(lowest), "old": [_key(p) for p in old]}))
            rows = spark.read.option("basePath", path).parquet(*old)
            sums = rows.groupBy("date", *keys).agg(F.sum("n").alias("n"))
            stage = table.stage(job)
            sums.repartition("date").write.partitionBy("date").parquet(stage)
            table.move_in(stage, f"m{level}-{job}-")
            table._mark_epochs(old)
            done += table.publish(f"_merged/{job}.end", IN)
        table.call_off(None)  # the claims
        _tidy(table)

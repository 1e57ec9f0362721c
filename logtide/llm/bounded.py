"""Joins of documents with a side whose size is counted first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a narrow side (a key and a few numbers or short lists) that are broadcast at most.
MOST_ROWS = 400_000
#: Bytes of a side of long lists that are broadcast at most; the driver holds them some three times.
MOST_BYTES = 32 << 20


def join_counted(docs: DataFrame, side: DataFrame, on: list[str], how: str, most: int = MOST_ROWS, *, most_bytes: int | None = None) -> DataFrame:
    """docs joined with a written `side`: broadcast if it has at most `most` rows, else shuffled.

    Either way the rows are the same; a small side spares the texts a shuffle.
    most_bytes: for "inner" and "left" and keys that are never null, a side of as few rows
    but more bytes isn't broadcast: its keys are, and only documents that have one are shuffled."""
    if side.limit(most + 1).count() > most:
        return docs.join(side, on, how)
    if most_bytes is None or (side.agg(F.sum(row_bytes(side))).first()[0] or 0) <= most_bytes:
        return docs.join(F.broadcast(side), on, how)
    keys = F.broadcast(side.select(*on))
    # hinted: by the size of its files, Spark may take a side of long lists for a small one
    found = docs.join(keys, on, "left_semi").join(side.hint("merge"), on)
    if how == "inner":
        return found
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields if f.name not in on]
    return found.unionByName(docs.join(keys, on, "left_anti").select("*", *none))


def row_bytes(side: DataFrame) -> Column:
    """About the bytes of a row in a broadcast table: its numbers, its lists of numbers or of structs of them."""
    total = F.lit(64 + 16 * len(side.columns)).cast("long")
    for f in side.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            kind = f.dataType.elementType
            total += (16 + 8 * len(kind.fields) if isinstance(kind, T.StructType) else 8) * F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0))
    return total


def most_frequent(counts: DataFrame, n: str, most: int, *ties: str) -> DataFrame:
    """The `most` rows of the highest `n` (ties by the columns given), highest first.

    A top-k merges `most` rows of every partition in one task.  Here the sizes of the
    powers of two of `n` (64 rows at most) first show from which one on there are enough
    rows; those below it are left out before the sort."""
    sizes = counts.groupBy(F.floor(F.log2(F.col(n))).cast("int").alias("power")).agg(F.count("*").alias("rows")).collect()
    found, least = 0, 1
    for r in sorted(sizes, key=lambda r: -r["power"]):
        found, least = found + r["rows"], 2 ** r["power"]
        if found >= most:
            break
    return counts.where(F.col(n) >= least).orderBy(F.desc(n), *ties).limit(most)

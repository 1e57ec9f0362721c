"""Each document beside the next one in descending order of id, streamed by ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm.fingerprints import likeness, sketch_texts, text_of
from logtide.llm.textops import blocks

PARTS_A_TASK = 4


def _part(x: Column, bounds: list[int]) -> Column:
    """Number of bounds above x, by binary search (bounds ascend); null goes last."""
    if not bounds:
        return F.when(x.isNull(), 1).otherwise(0)
    values = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.try_element_at(values, at + s) <= x), at + s).otherwise(at))
    return F.when(x.isNull(), len(bounds) + 1).otherwise(len(bounds) - below)


def beside_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guest, doc_id, text), sorted in each part as read, a part whole in one partition.

    Parts are ranges of doc_id, descending.  The first row of a part is also sent, as a guest,
    to the end of the part before (the very first row to the last part), so that each row meets
    its successor in its own partition: the texts are shuffled once, the guests are one per part."""
    bounds = sorted({int(b) for b in docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    rows = docs.select(_part(F.col("doc_id"), bounds).alias("part"), F.lit(0).alias("guest"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("part")  # one row a part
    heads = heads.select("part", "head", F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    guests = rows.join(F.broadcast(heads), (rows["part"] == heads["part"]) & rows["doc_id"].eqNullSafe(heads["head"])).select(
        F.col("to").alias("part"), F.lit(1).alias("guest"), "doc_id", "text")
    return rows.unionByName(guests).repartition("part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of each text, of its edit by its successor, and how alike they are."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*[batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")])
        if len(held) > 1:
            yield from _compared(held)
            held = held[-1:]


def _compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a, b in blocks([r[3] for r in rows], most=2048):
        some = rows[a : b + 1]  # with the row after the block
        if len(some) < 2:
            return
        sketches = sketch_texts([r[3].encode() for r in some])
        out, edits = [], []
        for i, ((part, guest, doc_id, text), after) in enumerate(zip(some, some[1:])):
            if not guest and after[0] == part:
                n = len(text)
                out.append((i, doc_id, n))
                edits.append((text[: n - n // 2] + after[3][: n // 2]).encode())
        changed = sketch_texts(edits)
        cols = [
            pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
            pa.array([text_of(sketches[o[0]]) for o in out], pa.string()), pa.array([text_of(c) for c in changed], pa.string()),
            pa.array([likeness(sketches[o[0]], c) for o, c in zip(out, changed)], pa.float64()),
            pa.array([likeness(sketches[o[0]], sketches[o[0] + 1]) for o in out], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])


def compared(docs: DataFrame) -> DataFrame:
    parts = PARTS_A_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return beside_next(docs, parts).mapInArrow(edited_likeness, RESULT)

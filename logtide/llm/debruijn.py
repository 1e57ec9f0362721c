"""Removal of passages that an earlier document already has, by compacted de Bruijn paths.

Every `window` consecutive words are an edge of the de Bruijn graph of the corpus
(between its first and last window - 1 words).  The edges of a document are cut into
paths by their minimiser: the least hashed gram inside the window, equal for equal
windows.  A path is kept as one row: its minimiser, the hash of its words, its place.
Minimisers that occur once prove all their edges unique.  The others' paths are
compacted by joins: paths with equal words fall together, with the smallest doc_id
that has them.  Where all paths of a minimiser fall together there is no branch, and
the compacted path stands for all its edges; where they differ the graph branches,
and the distinct paths are expanded into edges, which fall together in turn.  Source
coordinates lead back: a path is removed from documents above its smallest one, and
from that one the edges that a branch has in an earlier document.

Hashes are 64 bits each of the minimiser and of the path (or edge) beside its place
about the minimiser; both must agree.  No step sees a group whole: paths are summed by
partial aggregation, and rows of a frequent minimiser are joined by splittable joins.

Defined results: a null text has no words; a document without doc_id counts as later
than every other, and not as earlier than its like; rows that repeat a doc_id do not
count against each other; columns named like one of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.bounded import MOST_BYTES, join_counted
from logtide.llm.scratch import written
from logtide.llm.textops import PrefixHash, Words, blocks, mix, odd, signed, slices, texts_of, window_runs

WINDOW, GRAM = 50, 12
RESULT = ("n_words", "n_removed", "kept")
GRAM_BASE, PATH_BASE = odd(31), odd(32)
_LAST = 2**63 - 1


def _paths(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, copy, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts_of(batch.column(2))
            for a, b in blocks(texts):
                w = Words(texts[a:b])
                start, count, at, anchor = window_runs(w.hashes, w.first, window, gram, GRAM_BASE)
                path = mix(PrefixHash(w.hashes, PATH_BASE).value(start, start + count + window - 1))
                doc = w.doc[start]
                shape = ((at - start) << 32) | count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (signed(anchor), signed(path), shape, ids[a:b][doc], copy[a:b][doc], start - w.first[:-1][doc])],
                    names=["anchor", "path", "shape", "id", "copy", "place"])

    return run


PATHS = "anchor long, path long, shape long, id long, copy long, place long"


def _edges(window: int):
    """The edges of some paths of each document: (anchor, at, edge, first, path, shape)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, lists = texts_of(batch.column(0)), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                w = Words(texts[a:b])
                own = [(w.first[i] + p["place"], p["shape"] & 0xFFFFFFFF, p["shape"] >> 32, p["anchor"], p["path"], p["shape"], p["id"])
                       for i, ps in enumerate(lists[a:b]) for p in ps]
                start, count, at, anchor, path, shape, first = (np.array(x, dtype=np.int64) for x in zip(*own))
                row = np.repeat(np.arange(len(own)), count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                s = start[row] + step
                edge = mix(PrefixHash(w.hashes, PATH_BASE).value(s, s + window))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (anchor[row], at[row] - step, signed(edge), first[row], path[row], shape[row], step)],
                    names=["anchor", "at", "edge", "first", "path", "shape", "step"])

    return run


EDGES = "anchor long, at long, edge long, first long, path long, shape long, step long"


def _without(window: int, n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, lists = texts_of(batch.column(n_keep)), batch.column(n_keep + 1)
            begin, count = (lists.flatten().field(c).to_numpy() for c in ("place", "count"))
            end = begin + count + window - 1
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            n_words, n_removed, kept = [], [], []
            for text, a, b in zip(texts, at[:-1], at[1:]):
                words = text.split()
                n_words.append(len(words))
                if a < b:
                    gone = np.bincount(begin[a:b], minlength=len(words) + 1) - np.bincount(end[a:b], minlength=len(words) + 1)
                    stay = np.cumsum(gone)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(stay)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keep], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[:n_keep], *RESULT])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, copy, spans array<place, count>): runs of windows that an earlier document has.

    docs: (id long not null, copy long, text)."""
    paths = written(docs.select("id", "copy", "text").mapInArrow(_paths(window, gram), PATHS), "paths")
    # written: a join of two plain tables can split the rows of a frequent minimiser, one with an aggregate can't
    shared = written(paths.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    live = written(paths.join(shared, "anchor", "left_semi"), "paths-shared")
    compact = written(live.groupBy("anchor", "path", "shape").agg(F.min("id").alias("first"), F.max("id").alias("last")), "paths-compact")
    # below: the documents above the smallest one lose the whole path
    firsts = compact.withColumnRenamed("first", "least")
    later = live.join(firsts.where("last > least").drop("last"), ["anchor", "path", "shape"]).where("id > least").select(
        "id", "copy", "place", F.col("shape").bitwiseAND(0xFFFFFFFF).alias("count"))
    # branches: minimisers with several distinct paths, each read once, in its smallest document
    branching = compact.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("lo"), F.max("first").alias("hi")).where("n > 1 and lo < hi").select("anchor")
    branches = compact.join(branching, "anchor", "left_semi").select("anchor", "path", "shape", F.col("first").alias("id"))
    sources = live.join(branches, ["anchor", "path", "shape", "id"]).groupBy("anchor", "path", "shape", "id").agg(F.min(F.struct("copy", "place")).alias("x"))
    wanted = written(sources.select("id", F.col("x.copy").alias("copy"), F.struct("anchor", "path", "shape", "id", F.col("x.place").alias("place")).alias("p"))
                     .groupBy("id", "copy").agg(F.collect_list("p").alias("ps")), "branches")
    edges = written(join_counted(docs, wanted, ["id", "copy"], "inner", most_bytes=MOST_BYTES).select("text", "ps").mapInArrow(_edges(window), EDGES), "edges")
    least = edges.groupBy("anchor", "at", "edge").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
    earlier = edges.join(least, ["anchor", "at", "edge"]).where("first > least").select("anchor", "path", "shape", F.col("first").alias("id"), "step")
    again = live.join(earlier, ["anchor", "path", "shape", "id"]).select("id", "copy", (F.col("place") + F.col("step")).alias("place"), F.lit(1).cast("long").alias("count"))
    return later.unionByName(again).groupBy("id", "copy").agg(F.collect_list(F.struct("place", "count")).alias("spans"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`, by default all) with n_words, n_removed and kept: the words left, joined by blanks."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], body.alias("__text"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("__id"),
                       F.xxhash64(F.col(f"`{key}`"), body).alias("__copy"))
    named = rows.select(F.col("__id").alias("id"), F.col("__copy").alias("copy"), F.coalesce("__text", F.lit("")).alias("text"))
    spans = written(repeated_spans(named, window, gram), "spans").withColumnsRenamed({"id": "__id", "copy": "__copy"})
    joined = join_counted(rows, spans, ["__id", "__copy"], "left", most_bytes=MOST_BYTES).select(*[F.col(f"`{c}`") for c in keep], "__text", "spans")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in keep], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_without(window, len(keep)), schema)

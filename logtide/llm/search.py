"""Exact top-k inner products by pivot-table elimination.

Vectors are integers (floor(scale * x)).  For every vector the distances to some
pivots are known; the triangle inequality then bounds its distance to a query
from below by the largest difference of the two rows of the table, and so its
inner product (|q|^2 + |x|^2 - distance^2) / 2 from above.  A block of candidates
is gone through in the order of these bounds, and left when the next bound is
under the k-th best score: what is left cannot enter the result.  The k best
scores among the pivots start each query's threshold.

Queries and candidates are cut into blocks of bounded size; each pair of blocks
is one row of an equi-join on the candidate block, and each returns at most k
rows a query, which Spark merges.  Pivots are a bounded sample: they only steer
the pruning, results are exact for any pivots.

Defined results: rows whose id or vector is null, or whose vector holds a null or
non-finite component, take no part, neither do empty vectors; a shorter vector
counts as padded by zeros; wholly repeated rows count once (an id names a vector, so
a row stored twice is one candidate and one query, not a rank of its own twice over); scores are
exact while they, and the squared lengths, stay below 2^53; ties go to the smaller
id, further ties (an id with several vectors) to all of them in order of score;
a query never meets candidates of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.scratch import written

PIVOTS = 48
BLOCK_ROWS = 4096
QUERY_ROWS = 512
RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256) -> DataFrame:
    """(vec_id, v array<long>): the rows that take part, floor(scale * x) with x as double."""
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)
        .select("vec_id", F.transform("x", lambda c: F.floor(scale * c)).alias("v"))
        .distinct()
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows padded by zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - ends[:-1][row]] = flat
    return out


def _packed(width: int, pivots: np.ndarray, size: int):
    """Blocks of `size` rows: ids, vectors and the pivot table as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                m = _matrix(part.column(1), width)
                norm = (m * m).sum(1)
                gap = np.maximum(0, norm[:, None] + (pivots * pivots).sum(1) - 2 * m @ pivots.T)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in (part.column(0).to_numpy().tobytes(), m.tobytes(), np.sqrt(gap).astype(np.float32).tobytes())],
                    names=["ids", "vectors", "table"])

    return run


def _best(q_ids, q, q_table, ids, m, table, start, k) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of the block: id, and the candidates that may be among its k best."""
    norm = (m * m).sum(1)
    slack = 4e-7 * float(table.max())
    for i in range(len(q_ids)):
        low = np.abs(table - q_table[i]).max(1)
        # the table is rounded to 24 bits: a little slack keeps the bound a bound
        low = np.maximum(0, low.astype(np.float64) - slack - 4e-7 * q_table[i].max())
        bound = (norm + (q[i] * q[i]).sum() - low * low) / 2 + 1e-3
        bound[ids == q_ids[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        least, at, step = start[i], 0, 4 * k
        found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.float64)
        while at < len(order) and bound[order[at]] >= least and bound[order[at]] > -np.inf:
            some = order[at : at + step]
            some = some[bound[some] > -np.inf]
            found_ids, found = np.concatenate([found_ids, ids[some]]), np.concatenate([found, m[some] @ q[i]])
            if len(found) > k:
                best = np.lexsort((found_ids, -found))[:k]
                found_ids, found = found_ids[best], found[best]
            if len(found) == k:
                least = max(least, found.min())
            at, step = at + step, min(4 * step, 2048)
        keep = found >= start[i]
        yield int(q_ids[i]), found_ids[keep], found[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each of `queries` (both as `quantised`)."""
    spark = vectors.sparkSession
    seen = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    width, count = seen[0] or 0, seen[1]
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a bounded sample, repeatable: the vectors of the smallest hashes
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n_pivots).toArrow().combine_chunks()
    pivot_ids = sample.column(0).to_numpy()
    pivots = _matrix(sample.column(1).combine_chunks(), width)

    def blocks(df: DataFrame, rows: int) -> DataFrame:
        n = max(1, -(-(count if df is vectors else df.count()) // rows))
        dealt = df.select("vec_id", "v").repartition(n, F.xxhash64("vec_id"))
        return dealt.mapInArrow(_packed(width, pivots, rows), "ids binary, vectors binary, table binary")

    own = blocks(vectors, block_rows).select(F.monotonically_increasing_id().alias("at"), "*")
    own = written(own, "topk-blocks")
    asked = blocks(queries, query_rows).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.col("table").alias("q_table"))
    # each query block once for every candidate block, by key: no pair of rows is ever a row
    keys = own.agg(F.collect_list("at").alias("ats"))
    pairs = asked.join(F.broadcast(keys)).withColumn("at", F.explode("ats")).drop("ats").join(own, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = lambda x, t: np.frombuffer(x.as_py(), dtype=t)
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for r in range(batch.num_rows):
                q_ids, ids = get(cols["q_ids"][r], np.int64), get(cols["ids"][r], np.int64)
                shape = lambda c, n, t=np.float64: get(cols[c][r], t).reshape(n, -1)  # noqa: E731,B023
                q, m = shape("q", len(q_ids)), shape("vectors", len(ids))
                scores = q @ pivots.T
                scores[q_ids[:, None] == pivot_ids] = -np.inf
                start = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q_ids), -np.inf)
                out = list(_best(q_ids, q, shape("q_table", len(q_ids), np.float32), ids, m, shape("table", len(ids), np.float32), start, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64), pa.int64()),
                     pa.array(np.concatenate([x[1] for x in out]).astype(np.int64), pa.int64()),
                     pa.array(np.concatenate([x[2] for x in out]).astype(np.int64), pa.int64())],
                    names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, RESULT)
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    best = found.groupBy("query_id").agg(ordered.alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))

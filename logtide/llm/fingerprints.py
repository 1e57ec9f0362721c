"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's word shingles.  The k
smallest of two sketches together are the sketch of the union, so sketches of the
parts of a document (or a corpus) merge, and the share of those k that both hold
estimates the resemblance (Jaccard) of the shingle sets without bias; with fewer
than k shingles it is exact.  The k-th smallest hash estimates how many there are.

Defined results: a null or empty text, or one without words, has no shingles and an
empty sketch; two empty sketches have resemblance 1, an empty and another one 0; a
text of fewer words than a shingle is one shingle; equal texts have equal sketches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logtide.llm.textops import Words, blocks, shingles, texts_of

K, SHINGLE = 128, 5
BITS = 32
MOST_TEXTS = 4096


def sketch_texts(texts: list[bytes], k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """Ascending 32-bit hashes of each text's sketch."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts, most=MOST_TEXTS):
        doc, h = shingles(Words(texts[a:b]), size)
        # one sort for the block: the text's place above the leading bits of the hash
        key = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
        ends = np.searchsorted(key, np.arange(1, b - a + 1, dtype=np.uint64) << np.uint64(48))
        low = ((key >> np.uint64(48 - BITS)) & np.uint64(2**BITS - 1)).astype(np.int64)
        start = 0
        for end in ends:
            out.append(_distinct_first(low[start : min(end, start + 2 * k)], k))
            start = end
    return out


def _distinct_first(sorted_values: np.ndarray, k: int) -> np.ndarray:
    if len(sorted_values) < 2:
        return sorted_values[:k]
    return sorted_values[np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])][:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance of two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~same])]
    n = len(union) if max(len(a), len(b)) < k else min(k, len(union))  # two whole sets: all of their union
    return float((same & (both[1:] <= union[n - 1])).sum() / n)


def text_of(sketch: np.ndarray) -> str:
    """A sketch as hexadecimal text, eight digits a hash."""
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """(key, sketch array<long>) of every row."""
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sketch_texts(texts_of(batch.column(1)), k, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in got], pa.list_(pa.int64()))], names=[key, "sketch"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("sketch", T.ArrayType(T.LongType()))]))


def merged(sketches: DataFrame, by: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(by, sketch): the sketch of everything with the same `by`.

    The k smallest are kept in each task before the shuffle, so a hot key costs k rows a task."""
    h = sketches.select(F.col(f"`{by}`"), F.explode(f"`{sketch}`").alias("h"))
    first = Window.partitionBy(f"`{by}`").orderBy("h")
    best = h.withColumn("at", F.dense_rank().over(first)).where(F.col("at") <= k).groupBy(f"`{by}`").agg(F.array_sort(F.collect_set("h")).alias(sketch))
    return sketches.select(F.col(f"`{by}`").alias("__by")).distinct().join(best, F.col("__by").eqNullSafe(F.col(f"`{by}`")), "left").select(
        F.col("__by").alias(by), F.coalesce(F.col(sketch), F.array().cast("array<bigint>")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    whole = F.array_sort(F.array_union(a, b))
    union = F.when(F.greatest(F.size(a), F.size(b)) < k, whole).otherwise(F.slice(whole, 1, k))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(
        F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) over the k-th smallest hash as a fraction of all."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(2**BITS) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds, from resemblance and counts."""
    r, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (n + m) / n))

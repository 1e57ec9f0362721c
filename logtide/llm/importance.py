"""Importance resampling towards a target distribution over hashed n-grams.

Texts are handled as UTF-8 bytes: a table of 256 bytes lower-cases A-Z and blanks
every separator, `bytes.split` yields the words, and the crc32 of an n-gram is
chained from that of the n-gram one word shorter, so no n-gram is ever built.
Counters reduce the features of a batch before anything is looked up.

A feature's bucket is its crc32 modulo `buckets`.  Each task sums its counts per
bucket and hands on at most `buckets` rows; the driver gets two rows of counts a
bucket, whatever the size of the corpus.  A bucket's gain is the floored log ratio of its smoothed
shares in target and corpus, a document's weight the sum of gains over its features;
Gumbel noise from a hash of the id turns the weights into scores whose highest are a
sample without replacement.  The highest scores are numbered by a range-partitioned
sort of narrow rows: a row's rank is its place in its partition plus the sizes of
the partitions before it (one row a partition).

Defined results: a null text has no words, so no features, and weight 0; a null id is hashed like an empty
one, and comes after all others of its score; rows that are wholly alike are scored
alike and ranked one after the other; an empty corpus gives an empty result, an
empty target leaves every count of the target 0; a column of the input that is named like one of the
result is replaced; scores are whole numbers of 64 bits.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.scratch import written
from logtide.llm.textops import texts_of

BUCKETS = 10_000
RESULT = ("n_words", "n_features", "weight", "score", "rank")

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a longer UTF-8 sequence, blanks the rest.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, about a megabyte of it at a time."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + PIECE)
        part = text[at:end].translate(TABLE)
        step = 4096
        while end < n and part[-1] != 0x20:  # to the end of the word
            more = text[end : end + step].translate(TABLE)
            cut = more.find(b" ")
            part += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else cut + 1
            step *= 2
        yield part.split()
        at = end


def hashes(text: bytes, n: int) -> tuple[int, Counter]:
    """(number of words, how often each n-gram hash of 1 to n words occurs)."""
    found: Counter = Counter()
    words, open_grams = 0, []
    for part in _pieces(text):
        words += len(part)
        if n == 1:
            found.update(map(zlib.crc32, part))
            continue
        for word in part:
            later = b" " + word
            # seeds: hashes of the grams that end before this word, longest last
            open_grams = [zlib.crc32(word), *[zlib.crc32(later, seed) for seed in open_grams[: n - 1]]]
            found.update(open_grams)
    return words, found


def _in_buckets(found: Counter, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter(found.keys(), dtype=np.int64, count=len(found)) % buckets
    return keys, np.fromiter(found.values(), dtype=np.int64, count=len(found))


def bucket_counts(texts: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: at most `buckets` numbers, summed by tasks, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                found: Counter = Counter()
                for t in texts_of(batch.column(0).slice(i, 256)):
                    found.update(hashes(t, n)[1])
                    if len(found) > 1 << 18:  # so many counters at a time
                        np.add.at(total, *_in_buckets(found, buckets))
                        found = Counter()
                np.add.at(total, *_in_buckets(found, buckets))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of add-one shares) of every bucket, in doubles."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(corpus.astype(float), target.astype(float)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text", n: int = 1) -> DataFrame:
    """`docs` with n_words, n_features and weight."""
    docs = docs.drop(*[c for c in RESULT if c in docs.columns])
    names = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in RESULT[:3]])
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(0, batch.num_rows, 256):
                for t in texts_of(batch.column(0).slice(i, 256)):
                    words, found = hashes(t, n)
                    keys, counts = _in_buckets(found, buckets)
                    rows.append((words, int(counts.sum()), int((gain[keys] * counts).sum())))
            more = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i + 1) for i in range(len(names))], *more], names=[*names, *RESULT[:3]])

    return docs.select(F.col(f"`{text}`").cast("string").alias(text), *[f"`{c}`" for c in names]).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024,
             key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Every row of `docs` without its text, with n_words, n_features, weight, score and rank.

    Of the N rows with at least `least_words` words the floor(percent * N / 100) highest
    scores are drawn and have a rank from 1, ties to the smaller key; the others' rank is null."""
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = written(weights(docs, gain, text, n).withColumn("score", F.col("weight") + gumbel), "scores")
    enough = F.col("n_words") >= least_words
    # the last column parts rows that are alike; the id of a row is its partition and its place there
    order = [F.desc("score"), F.asc_nulls_last(f"`{key}`"), F.asc("__tie")]
    rows = scored.where(enough).withColumn("__tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    placed = written(rows, "ranks")
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"])
    drawn, before, starts = percent * sum(r["n"] for r in sizes) // 100, 0, []
    for r in sizes:  # a row a partition
        starts.append((r["part"], before))
        before += r["n"]
    starts = docs.sparkSession.createDataFrame(starts, "__part long, __before long")
    rank = F.col("__before") + place + 1
    ranked = placed.withColumn("__part", part).join(F.broadcast(starts), "__part", "left").withColumn("rank", F.when(rank <= drawn, rank))
    return ranked.select(*[f"`{c}`" for c in scored.columns], "rank").union(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))

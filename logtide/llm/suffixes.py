"""Removal of byte strings that start in two places, by distributed prefix doubling.

Positions are ranked by longer and longer prefixes: equal rank means equal prefix, and
the ranks of a position and of the one `h` bytes on give its rank by 2h bytes.  A
position drops out when its rank is unique; past `length` bytes those left are the
starts of repeated strings.

Ranking every byte of the corpus would sort it whole, round after round.  Two facts
that a document yields by itself decide most positions beforehand.  Runs of
neighbouring strings share an anchor (their least hashed gram, equal in equal strings):
 - an anchor that occurs once proves its run unique;
 - runs with equal anchor and equal bytes are repeated, all of them.
Where one anchor has runs of different bytes, its distinct runs are cut, at equal
distances from the anchor, into groups of starts.  The bytes that all strings of a group
share decide against it if unique, the bytes that any of them covers decide for it if
equal; groups left open are cut finer (`groups`).  What is still open then, the strings
about an actual end of a match, enters the doubling, by `seed` bytes first.

Anchors, runs, groups and seeds are compared by hashes, two independent ones of 64 bits
together (four seeds for each string).  No step sees a group whole: counts are partial
aggregates, ranks come back by splittable joins.  What a document is asked or told travels
as plain longs, a place and a count in one, and tasks take a few texts at a time.

Defined results: a null text is empty; bytes may be cut inside a character, so what is
kept is binary; repeated rows are repeats of each other; columns named like one of the
result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.bounded import join_counted
from logtide.llm.scratch import written
from logtide.llm.textops import PrefixHash, blocks, byte_table, mix, odd, signed, slices, texts_of, window_runs

LENGTH, GRAM, GROUPS_OF, SEED = 400, 128, (16, 4), 100
RESULT = ("n_bytes", "n_removed", "n_spans", "kept")
BLOCK = 1 << 17
VALUES = byte_table(41)
GRAM_BASE, PATH_BASE, SEED_BASE = odd(42), odd(43), odd(44)
_LAST = 2**63 - 1


def _values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the bytes of some texts end to end, and where each begins."""
    first = np.cumsum([0] + [len(t) for t in texts])
    return VALUES[np.frombuffer(b"".join(texts), dtype=np.uint8)], first


def _longs(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[n.split()[0] for n in names.split(", ")])


def _packed(place, count) -> F.Column:
    """A run of starts as one long; a text has fewer than 2**31 bytes."""
    return F.shiftleft(place, 32).bitwiseOR(count)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of longs end to end, and where each begins and the last one ends; null is empty."""
    n = np.fromiter((x or 0 for x in pc.list_value_length(column).to_pylist()), dtype=np.int64, count=len(column))
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])


RUNS = "anchor long, path long, shape long, id long, copy long, place long"


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, copy, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts_of(batch.column(2))
            for a, b in blocks(texts, BLOCK):
                h, first = _values(texts[a:b])
                start, count, at, anchor = window_runs(h, first, length, gram, GRAM_BASE, BLOCK)
                path = mix(PrefixHash(h, PATH_BASE).value(start, start + count + length - 1))
                doc = np.searchsorted(first, start, side="right") - 1
                yield _longs(RUNS, signed(anchor), signed(path), ((at - start) << 32) | count, ids[a:b][doc], copy[a:b][doc], start - first[doc])

    return run


GROUPS = "anchor long, part long, inner long, outer long, shape long, id long, copy long, place long, weight long"


def _groups(length: int, group: int):
    """Groups of starts at equal distances before the anchor, of listed runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, copy, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts_of(batch.column(2))
            listed, at = _lists(batch.column(3))
            for a, b in blocks(texts, BLOCK):
                h, first = _values(texts[a:b])
                anchor, shape, place, n = listed[at[a] : at[b]].reshape(-1, 4).T
                doc = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]) // 4)
                start, count, before = first[doc] + place, shape & 0xFFFFFFFF, shape >> 32
                # distances before the anchor run from `before` down to before - count + 1
                high, low = before // group, (before - count + 1) // group
                parts = high - low + 1
                row = np.repeat(np.arange(len(doc)), parts)
                part = high[row] - (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
                anchor_at = start[row] + before[row]
                lo = np.maximum(start[row], anchor_at - (part * group + group - 1))
                hi = np.minimum(start[row] + count[row] - 1, anchor_at - part * group)
                sums = PrefixHash(h, PATH_BASE)
                # every string of the part contains the bytes from its last start to its first end
                inner = sums.value(anchor_at - part * group, anchor_at - (part * group + group - 1) + length)
                outer = sums.value(lo, hi + length)
                yield _longs(GROUPS, anchor[row], part, signed(mix(inner)), signed(mix(outer)), ((anchor_at - lo) << 32) | (hi - lo + 1),
                             ids[a:b][doc[row]], copy[a:b][doc[row]], lo - first[doc[row]], n[row])

    return run


POSITIONS = "id long, copy long, place long, rank long"


def _seeds(length: int, seed: int):
    """Hash of the `seed` bytes at every place that the doubling of listed starts needs."""
    steps = _offsets(length, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, copy, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts_of(batch.column(2))
            listed, at = _lists(batch.column(3))
            for a, b in blocks(texts, BLOCK):
                h, first = _values(texts[a:b])
                own = listed[at[a] : at[b]]
                doc, place, count = np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), own >> 32, own & 0xFFFFFFFF
                row = np.repeat(np.arange(len(own)), count)
                start = first[doc[row]] + place[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                needed = np.unique((start[:, None] + steps).ravel())
                doc = np.searchsorted(first, needed, side="right") - 1
                rank = mix(PrefixHash(h, SEED_BASE).value(needed, needed + seed))
                yield _longs(POSITIONS, ids[a:b][doc], copy[a:b][doc], needed - first[doc], signed(rank))

    return run


def _rounds(length: int, seed: int) -> list[tuple[int, int]]:
    """(bytes ranked so far, offset to the second half): seed, then doubled; the last halves may overlap."""
    out, h = [], seed
    while h < length:
        step = min(h, length - h)
        out.append((h, step))
        h += step
    return out


def _offsets(length: int, seed: int) -> np.ndarray:
    at = {0}
    for _, step in reversed(_rounds(length, seed)):
        at |= {x + step for x in at}
    return np.array(sorted(at), dtype=np.int64)


def doubled(positions: DataFrame, starts: DataFrame, length: int, seed: int) -> DataFrame:
    """The rows (id, copy, place) of `starts` whose `length` bytes have an equal start elsewhere.

    positions: rank by `seed` bytes of every place needed.  Each round keeps the places whose
    rank occurs twice, pairs the rank with that of the place `step` bytes on, and ranks the
    pairs: a pair's rank is the least place (as a number) that has it."""
    where = ["id", "copy", "place"]
    ranked = positions
    for i, (_, step) in enumerate(_rounds(length, seed)):
        twice = ranked.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
        left = ranked.join(twice, "rank", "left_semi")
        on = left.select("id", "copy", (F.col("place") - step).alias("place"), F.col("rank").alias("next"))
        pairs = left.join(on, where).select(*where, "rank", "next")
        if i == 0:
            pairs = written(pairs, "pairs")
        names = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min(F.struct(*where)).alias("least")).where("n > 1")
        named = names.select("rank", "next", F.xxhash64("least").alias("name"))
        ranked = written(pairs.join(named, ["rank", "next"]).select(*where, F.col("name").alias("rank")), "ranks")
    twice = ranked.join(starts, where, "left_semi")
    again = twice.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
    return twice.join(again, "rank", "left_semi").select(*where)


def _narrowed(docs: DataFrame, asked: DataFrame, length: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(covered, open): of listed runs, cut into groups of starts, the spans found repeated and the groups still open.

    asked and open: (id, copy, p struct<anchor, shape, place, n>), n > 1 for what is known to be
    repeated and only stands as what others may be equal to."""
    count = F.col("shape").bitwiseAND(0xFFFFFFFF).alias("count")
    four = F.array("p.anchor", "p.shape", "p.place", "p.n")
    listed = written(asked.groupBy("id", "copy").agg(F.flatten(F.collect_list(four)).alias("ps")), "groups-asked")
    parts = written(join_counted(docs, listed, ["id", "copy"], "inner").select("id", "copy", "text", "ps").mapInArrow(_groups(length, group), GROUPS), "groups")
    # inner bytes that occur once: every string of the part is unique
    inside = ["anchor", "part", "inner"]
    kept = parts.groupBy(*inside).agg(F.count("*").alias("n"), F.min("weight").alias("least")).where("n > 1 and least = 1").select(*inside)
    maybe = written(parts.join(kept, inside, "left_semi"), "groups-shared")
    whole = [*inside, "outer", "shape"]
    distinct = written(maybe.groupBy(*whole).agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.min(F.struct("id", "copy", "place")).alias("x")), "groups-distinct")
    covered = maybe.where("weight = 1").join(distinct.where("n > 1").select(*whole), whole).select("id", "copy", "place", count)
    # what is left, and the distinct groups it may be equal to
    n = F.greatest("n", "weight")
    open_parts = distinct.groupBy(*inside).agg(F.count("*").alias("m"), F.min(n).alias("least")).where("m > 1 and least = 1").select(*inside)
    left = distinct.join(open_parts, inside, "left_semi").select("x.id", "x.copy", F.struct("anchor", "shape", "x.place", n.alias("n")).alias("p"))
    return covered, left


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, groups: tuple[int, ...] = GROUPS_OF, seed: int = SEED) -> DataFrame:
    """(id, copy, spans array<long>): runs of starts of repeated strings, place and count in one (`_packed`).

    docs: (id long not null, copy long, text)."""
    runs = written(docs.select("id", "copy", "text").mapInArrow(_runs(length, gram), RUNS), "runs")
    # written: a join of two plain tables can split the rows of a frequent anchor, one with an aggregate can't
    shared = written(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    live = written(runs.join(shared, "anchor", "left_semi"), "runs-shared")
    same = ["anchor", "path", "shape"]
    distinct = written(live.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("id", "copy", "place")).alias("x")), "runs-distinct")
    count = F.col("shape").bitwiseAND(0xFFFFFFFF).alias("count")
    equal = live.join(distinct.where("n > 1").select(*same), same).select("id", "copy", "place", count)

    open_anchors = distinct.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("anchor")
    asked = distinct.join(open_anchors, "anchor", "left_semi").select("x.id", "x.copy", F.struct("anchor", "shape", "x.place", "n").alias("p"))
    spans = [equal]
    for group in groups:
        covered, asked = _narrowed(docs, asked, length, group)
        spans.append(covered)
    last = written(asked.groupBy("id", "copy").agg(F.collect_list(_packed(F.col("p.place"), F.col("p.shape").bitwiseAND(0xFFFFFFFF))).alias("ps")), "starts-open")
    positions = written(join_counted(docs, last, ["id", "copy"], "inner").select("id", "copy", "text", "ps").mapInArrow(_seeds(length, seed), POSITIONS).distinct(), "positions")
    starts = last.select("id", "copy", F.explode("ps").alias("p")).select(
        "id", "copy", F.explode(F.sequence(F.shiftright("p", 32), F.shiftright("p", 32) + F.col("p").bitwiseAND(0xFFFFFFFF) - 1)).alias("place")).distinct()
    found = doubled(positions, starts, length, seed).withColumn("count", F.lit(1).cast("long"))
    for more in spans:
        found = found.unionByName(more)
    return found.groupBy("id", "copy").agg(F.collect_list(_packed(F.col("place"), F.col("count"))).alias("spans"))


def _without(length: int, n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, (listed, first) = texts_of(batch.column(n_keep)), _lists(batch.column(n_keep + 1))
            removed, spans, kept = [], [], []
            for i, text in enumerate(texts):
                # the spans' ends in order give what stays between them
                parts, at, gone, n = [], 0, 0, 0
                for span in np.sort(listed[first[i] : first[i + 1]]).tolist():
                    place, count = span >> 32, span & 0xFFFFFFFF
                    end = place + count + length - 1
                    if not n or place > at:
                        parts.append(text[at:place])
                        n += 1
                        gone += end - place
                    else:
                        gone += max(0, end - at)
                    at = max(at, end)
                parts.append(text[at:])
                removed.append(gone)
                spans.append(n)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keep], pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=[*batch.schema.names[:n_keep], *RESULT])

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, groups: tuple[int, ...] = GROUPS_OF,
                    seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`, by default all) with n_bytes, n_removed, n_spans and kept (binary)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], body.alias("__text"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("__id"),
                       F.xxhash64(F.col(f"`{key}`"), body).alias("__copy"))
    named = rows.select(F.col("__id").alias("id"), F.col("__copy").alias("copy"), F.coalesce("__text", F.lit("")).alias("text"))
    spans = written(repeated_spans(named, length, gram, groups, seed), "byte-spans").withColumnsRenamed({"id": "__id", "copy": "__copy"})
    joined = join_counted(rows, spans, ["__id", "__copy"], "left").select(*[F.col(f"`{c}`") for c in keep], "__text", "spans")
    long = [T.StructField(n, T.LongType()) for n in RESULT[:3]]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in keep], *long, T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(_without(length, len(keep)), schema)

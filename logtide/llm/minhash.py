"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is a weighted set of word shingles.  Darts are thrown at the plane of weight
and rank by hashes of the shingle alone: cell by cell, cells doubling along both axes,
a Poisson number of darts in each.  A dart counts if it lands under the shingle's
weight; its hash names a coordinate of the signature, and each coordinate keeps its
earliest dart.  Equal coordinates have the probability of the weighted Jaccard
similarity, and a text needs about k ln k darts, however many shingles it has.

Bands of `rows` coordinates put texts into buckets: a pair of similarity s shares one
of `bands` buckets with probability 1 - (1 - s^rows)^bands, 0.99999 at 0.8.  Every
bucket ties its texts to its least one; what is tied together is a family, and all
links of a family are found exactly: families are cut into blocks of bounded size,
each pair of blocks is one task's matrix product of shingle sets, and only links that
join what the task has not joined yet leave it.  Classes are the components of the
links: similarity at least `least` of the sets (or multisets) of shingles.

Buckets and families are never collected; no pair of texts is ever a row, except a link.

Defined results: equal texts are one class, those without a word included; a null text
is empty; a class is named by its least id (null if it has none); texts are told apart
by a 64-bit hash, shingles by 64 bits in signatures and 32 in the exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.bounded import join_counted
from logtide.llm.components import components
from logtide.llm.scratch import written
from logtide.llm.textops import Words, blocks, mix, odd, shingles, signed, texts_of

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 64, 8
BLOCK_TEXTS = 128
MOST_TEXTS, BLOCK_BYTES = 1024, 1 << 19
_U = np.uint64
_FIRST_RANK = 2.0**-6  # width of the first cell along the rank axis; each next one is as wide as all before
_NONE = _U(2**64 - 1)
_LAST = 2**63 - 1


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h + _U(odd(1000 + salt)))


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Quantiles of the Poisson distribution."""
    top = int(mean + 12 * mean**0.5 + 12)
    k = np.arange(top + 1)
    log_p = k * np.log(mean) - mean - np.cumsum(np.log(np.maximum(k, 1)))
    return np.searchsorted(np.cumsum(np.exp(log_p)), u, side="left").clip(0, top)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k earliest darts (rank above, identity below); rows of texts without shingles stay empty."""
    out = np.full(n_docs * k, _NONE, dtype=np.uint64)
    waiting = np.bincount(doc, minlength=n_docs) > 0
    for cell in range(50):
        live = waiting[doc]
        if not live.any():
            break
        doc, h, weight = doc[live], h[live], weight[live]
        width = _FIRST_RANK * 2.0 ** max(0, cell - 1)
        for up in range(int(np.floor(np.log2(weight.max() + 1))) + 1):
            low, span = 2.0**up - 1, 2.0**up  # weights from low to low + span
            some = np.flatnonzero(weight > low)
            own = _salted(h[some], cell * 64 + up)
            n = _poisson((own >> _U(11)).astype(np.float64) / 2.0**53, width * span)
            row = np.repeat(some, n)
            dart = mix(np.repeat(own, n) + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            if span > 1 or (weight < 1).any():
                height = low + span * ((mix(dart + _U(5)) >> _U(11)).astype(np.float64) / 2.0**53)
                hit = height < weight[row]
                row, dart = row[hit], dart[hit]
            coordinate = (dart % _U(k)).astype(np.int64)
            # cells come in order of rank; inside one, the leading bits of a second hash are the rank
            value = (_U(cell) << _U(58)) | (mix(dart + _U(9)) >> _U(6))
            np.minimum.at(out, doc[row] * k + coordinate, value)
        waiting &= (out.reshape(n_docs, k) == _NONE).any(1)
    return out.reshape(n_docs, k)


def weighted_shingles(texts: list[bytes], size: int, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles; the weight is 1, or how often it occurs."""
    doc, h = shingles(Words(texts), size)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(doc))).astype(np.float64) if counts else np.ones(len(at))
    return doc[at], h[at], weight


def _bands(size: int, bands: int, rows: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = odd(55)
        for batch in batches:
            nodes, texts = batch.column(0), texts_of(batch.column(1))
            for a, b in blocks(texts, BLOCK_BYTES, MOST_TEXTS):
                doc, h, w = weighted_shingles(texts[a:b], size, counts)
                sig = signatures(doc, h, w, b - a, bands * rows).reshape(b - a, bands, rows)
                key = np.zeros((b - a, bands), dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = mix(key * _U(base) + sig[:, :, r])
                some = np.bincount(doc, minlength=b - a) > 0
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32)), pa.array(signed(key.ravel()), pa.int64()))
                yield pa.RecordBatch.from_arrays([nodes.slice(a, b - a), keys], names=["node", "bands"]).filter(pa.array(some))

    return run


def _sets(size: int, counts: bool):
    """The shingles of a text as sorted 32-bit numbers (a shingle's occurrences numbered, if they count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in blocks(texts, BLOCK_BYTES, MOST_TEXTS):
                doc, h, w = weighted_shingles(texts[a:b], size, counts)
                if counts:
                    n = w.astype(np.int64)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    doc, h = np.repeat(doc, n), mix(np.repeat(h, n) + nth.astype(np.uint64))
                own = np.split((h >> _U(32)).astype("<u4"), np.searchsorted(doc, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.unique(x).tobytes() for x in own], pa.binary())], names=["node", "shingles"])

    return run


def _links(least: float):
    """Links among the texts of one or two blocks: a spanning forest of the similar pairs."""
    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        sets = [np.frombuffer(x, dtype="<u4") for x in group.column("shingles").to_pylist()]
        side = group.column("side").to_numpy()
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, token, often = np.unique(np.concatenate(sets) if sets else np.zeros(0, "<u4"), return_inverse=True, return_counts=True)
        shared = often[token] > 1
        row, token = row[shared], np.unique(token[shared], return_inverse=True)[1]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for a in range(0, int(token.max()) + 1 if len(token) else 0, 4096):
            lo, hi = np.searchsorted(token, [a, a + 4096])
            x = np.zeros((len(sets), 4096), dtype=np.float32)
            x[row[lo:hi], token[lo:hi] - a] = 1
            both += x @ x.T
        # both / (union) >= least, in whole numbers up to rounding
        like = both + 1e-9 >= least * (sizes[:, None] + sizes[None, :] - both)
        like &= (side[:, None] <= side[None, :]) & (nodes[:, None] != nodes[None, :])
        if side.max(initial=0) > 0:
            like &= side[:, None] != side[None, :]
        root = list(range(len(sets)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for i, j in np.argwhere(like):
            a, b = find(int(i)), find(int(j))
            if a != b:
                root[a] = b
                out.append((int(nodes[i]), int(nodes[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def links(docs: DataFrame, least: float = LEAST, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, counts: bool = False,
          block: int = BLOCK_TEXTS) -> DataFrame:
    """(a, b): links that join exactly the similar texts of docs (node long, text)."""
    keyed = written(docs.select("node", "text").mapInArrow(_bands(size, bands, rows, counts), "node long, bands array<long>"), "bands")
    each = keyed.select("node", F.explode("bands").alias("band"))
    hubs = each.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other").select("band", "hub")
    tied = written(each.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "tied")
    family = written(components(tied), "families")
    # each text of a family once, with its shingles
    wanted = docs.select("node", "text")
    texts = join_counted(wanted, family.select("node"), ["node"], "left_semi")
    sets = texts.mapInArrow(_sets(size, counts), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sizes = family.groupBy("component").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    members = family.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    members = written(members.join(sets, "node"), "family-sets")
    # a block meets itself and every other block of its family: (i, j), i <= j
    pairs = members.select("component", "node", "shingles", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    pairs = pairs.select("component", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"),
                         (F.col("part") > F.col("with")).cast("int").alias("side"), "node", "shingles")
    return pairs.groupBy("component", "i", "j").applyInArrow(_links(least), "a long, b long")


def _classes(docs: DataFrame, key: str, text: str, least: float, options: dict) -> DataFrame:
    """(id, node, n, class_id, class_size, leader): a row for each id and text; n rows have them."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    linked = links(docs.select(F.xxhash64(body).alias("node"), body.alias("text")), least, **options)
    classes = written(components(linked), "classes")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(body).alias("node"))
    named = written(rows.groupBy("id", "node").agg(F.count("*").alias("n")).join(classes, "node", "left")
                    .select("id", "node", "n", F.coalesce("component", "node").alias("class")), "class-rows")
    # a null id comes last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    heads = named.groupBy("class").agg(first.alias("x"), F.sum("n").alias("class_size"))
    # written: a join of two plain tables can split the rows of a large class, one with an aggregate can't
    heads = written(heads.select("class", F.col("x.id").alias("class_id"), F.col("x.node").alias("head"), "class_size"), "class-heads")
    leader = F.col("class_id").eqNullSafe(F.col("id")) & (F.col("head") == F.col("node"))
    return written(named.join(heads, "class").select("id", "node", "n", "class_id", "class_size", leader.alias("leader")), "class-members")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, keep: list[str] | None = None, **options) -> DataFrame:
    """`docs` (its columns `keep`, by default all) with class_id, class_size and leader.

    The leader of a class is the row of its least id; among rows of equal id, or none,
    that of the least text hash (all of them, if equal rows repeat)."""
    result = ("class_id", "class_size", "leader")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in result]
    of = _classes(docs, key, text, least, options).select(F.col("id").alias("__id2"), F.col("node").alias("__node2"), *result)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{key}`").cast("long").alias("__id"), F.xxhash64(body).alias("__node"))
    out = rows.join(of, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__node") == F.col("__node2")))
    return out.select(*[F.col(f"`{c}`") for c in keep], *result)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, **options) -> DataFrame:
    """`docs` with one row of each class: its leader, and one only where equal rows repeat.

    Only ids and hashes of the rows that go are joined, so the texts stay in place while
    these are few."""
    of = _classes(docs, key, text, least, options).select(F.coalesce("id", F.lit(_LAST)).alias("__id"), F.col("node").alias("__node"), "leader", "n")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select("*", F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("__id"), F.xxhash64(body).alias("__node"))
    on, repeated = ["__id", "__node"], of.where("leader and n > 1").select("__id", "__node")
    single = join_counted(rows, of.where("not leader or n > 1").select(*on), on, "left_anti")
    again = join_counted(rows, repeated, on, "left_semi").dropDuplicates(on)
    return single.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Mixing sources to target weights by a hypergeometric splitting tree (DataFrame functions only).

Documents are dealt into `blocks` blocks of their source by a hash of key, text and source.
A source's target becomes whole passes over its blocks and, for what is left, the
first blocks of one more permuted pass; a gap that the next block would overfill
is closed by later blocks that fit (a few rounds).  The blocks to take are the exact quotas of the sources.  A binary tree splits them
among the output shards: a node's left child takes half of its blocks, so many of
each source as a random half would hold (multivariate hypergeometric, drawn source
by source).  The leaves therefore have the composition of a random permutation
cut into equal parts, without permuting anything globally.  Each shard then draws
its own, disjoint range of every source's permuted blocks, and shuffles locally.

All draws are hashes of keys and `seed`: reruns and recomputed tasks agree.
Aggregates hold at most `blocks` rows a source; sizes are summed before any
shuffle, and the hot source is spread over its blocks.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; keys may be null or repeated, documents alike in key, text and source share a block; with no words at all
every target is 0; columns of the input named like one of the result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logtide.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS, SHARDS, CAP = 4096, 64, 3
FILL_ROUNDS = 4
RESULT = ("size", "source_size", "target", "copies", "placed")


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*keys: Column | int) -> Column:
    """A repeatable number in [0, 1) for the keys."""
    h = F.xxhash64(*[F.lit(k) if isinstance(k, int) else k for k in keys])
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def _let(body, **values: Column) -> Column:
    """body of named values, each computed once and not repeated in the expression."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _ln_factorial(x: Column) -> Column:
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(x < 16, F.element_at(small, (x + 1).cast("int"))).otherwise(series)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Quantile u of the number of good ones among `draws` of `total` without replacement.

    The distribution function is summed over nine standard deviations about the mean;
    what lies beyond is below the resolution of u."""
    one = F.lit(1.0)

    def spread(v: Column) -> Column:
        mean = v["draws"] * v["good"] / F.greatest(v["total"], one)
        left = (1 - v["good"] / F.greatest(v["total"], one)) * (v["total"] - v["draws"]) / F.greatest(v["total"] - 1, one)
        return _let(lambda m: bounds(v, m), mean=mean, sd=F.sqrt(F.greatest(F.lit(0.0), mean * left)))

    def bounds(v: Column, m: Column) -> Column:
        low = F.greatest(F.lit(0.0), v["draws"] + v["good"] - v["total"], F.floor(m["mean"] - 9 * m["sd"]) - 2)
        high = F.least(v["good"], v["draws"], F.ceil(m["mean"] + 9 * m["sd"]) + 2)
        return _let(lambda r: summed(v, r), low=low, high=high)

    def summed(v: Column, r: Column) -> Column:
        good, bad, draws, low = v["good"], v["total"] - v["good"], v["draws"], r["low"]
        # choose(good, low) * choose(bad, draws - low) / choose(total, draws)
        parts = F.array(good, bad, draws, v["total"] - draws, v["total"], low, good - low, draws - low, bad - draws + low)
        signs = F.array(*[F.lit(x) for x in (1.0, 1.0, 1.0, 1.0, -1.0, -1.0, -1.0, -1.0, -1.0)])
        first = F.exp(F.aggregate(F.zip_with(F.transform(parts, _ln_factorial), signs, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))

        def walk(s: Column, x: Column) -> Column:
            ratio = (good - x) * (draws - x) / F.greatest((x + 1) * (bad - draws + x + 1), one)
            on = F.struct((s["p"] * ratio).alias("p"), (s["cum"] + s["p"]).alias("cum"), x.alias("k"))
            return F.when(s["cum"] > v["u"], s).otherwise(on)

        start = F.struct(first.alias("p"), F.lit(0.0).alias("cum"), low.cast("long").alias("k"))
        return F.aggregate(F.sequence(low.cast("long"), r["high"].cast("long")), start, walk, lambda s: s["k"])

    return _let(spread, total=total.cast("double"), good=good.cast("double"), draws=draws.cast("double"), u=u)


def _split(node: Column, quotas: Column, draws: Column, seed: int) -> Column:
    """Quotas of the left child: a multivariate hypergeometric draw, source by source."""
    def one(s: Column, q: Column) -> Column:
        k = hypergeometric(s["left"], q["n"], s["draws"], _uniform(seed, node, q["at"]))
        return F.transform(F.array(k), lambda v: F.struct(
            (s["left"] - q["n"]).alias("left"), (s["draws"] - v).alias("draws"),
            F.concat(s["out"], F.array(F.struct(q["at"].alias("at"), v.alias("n")))).alias("out")))[0]

    start = F.struct(
        F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q["n"]).alias("left"), draws.cast("long").alias("draws"),
        F.array().cast("array<struct<at:int,n:bigint>>").alias("out"))
    return F.aggregate(quotas, start, one, lambda s: s["out"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(at, shard, n): blocks of each source for each shard, exact in every row and column sum.

    quotas: (at int, n long), a row for each source.  shards: a power of two."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("q")).select(F.lit(1).cast("long").alias("node"), "q")
    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    while shards > 1:
        half = F.floor(total(F.col("q")) / 2)
        parts = node.select("node", "q", F.explode(F.array(_split(F.col("node"), F.col("q"), half, seed))).alias("left"))
        rest = F.zip_with("q", "left", lambda q, x: F.struct(q["at"].alias("at"), (q["n"] - x["n"]).alias("n")))
        node = parts.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("q")))).alias("x")).select("x.node", "x.q")
        shards //= 2
    leaf = node.withColumn("first", F.expr("bigint(pow(2, floor(log2(node) + 1e-9)))"))
    return leaf.select((F.col("node") - F.col("first")).cast("int").alias("shard"), F.explode("q").alias("x")).select("x.at", "shard", "x.n")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, share: float = 1.0) -> DataFrame:
    """(source, source_size, at, target): share of all sizes by weight, at most `cap` times a source.

    sizes: (source, source_size).  The level at which the excess has been reshared is the largest
    of (what is left) / (weights left), sources ordered by cap over weight.  One row a source."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("at"), F.lit(len(weights))) + 1)
    rows = sizes.withColumn("at", (F.row_number().over(order) - 1).cast("int")).withColumn("w", w).withColumn("most", cap * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("most") / F.col("w"), "at")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(everything) - before) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max("level").over(everything)
    return rows.select("source", "source_size", "at", F.least(F.col("w") * level, F.col("most")).alias("target"))


def allot(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
          cap: int = CAP, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """`docs` with size, source_size, target, copies, and placed: array of (pass, shard) of its copies."""
    docs = docs.drop(*[c for c in RESULT if c in docs.columns])
    own = docs.select(
        "*", words_in(F.col(f"`{text}`")).alias("size"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("__source"),
        F.col(f"`{source}`").isNull().alias("__none"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"), F.col(f"`{source}`")), F.lit(blocks)).cast("int").alias("__block"))
    sized = written(own.groupBy("__source", "__none", "__block").agg(F.sum("size").alias("words")), "mix-blocks")
    name = F.when(~F.col("__none"), F.col("__source"))
    by_source = sized.groupBy("__source", "__none").agg(F.sum("words").alias("source_size"), F.count("*").alias("n_blocks"))
    goal = targets(by_source.select(name.alias("source"), "source_size"), weights, cap).select(
        F.coalesce("source", F.lit("")).alias("__source"), F.col("source").isNull().alias("__none"), "source_size", "at", "target")
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))

    # every pass over a source has its own permutation; the last one stops at the target
    one_pass = Window.partitionBy("__source", "__none", "pass").orderBy(F.xxhash64(F.lit(seed + 1), "__source", "__none", "pass", "__block"), "__block")
    drawn = sized.join(goal, ["__source", "__none"]).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    drawn = drawn.withColumn("place", F.row_number().over(one_pass) - 1)
    upto, whole = one_pass.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("__source", "__none", "pass")
    drawn = drawn.withColumn("gap", F.col("rest")).withColumn("taken", F.lit(False))
    for _ in range(FILL_ROUNDS):
        fits = ~F.col("taken") & (F.col("words") > 0) & (F.col("words") <= F.col("gap"))
        drawn = drawn.withColumn("fits", fits & (F.sum(F.when(fits, F.col("words"))).over(upto) <= F.col("gap")))
        drawn = drawn.withColumn("gap", F.col("gap") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("words"))).over(whole), F.lit(0)))
        drawn = drawn.withColumn("taken", F.col("taken") | F.col("fits"))
    drawn = drawn.where((F.col("pass") < F.col("passes")) | F.col("taken"))
    drawn = written(drawn.select("__source", "__none", "__block", "at", "pass", "place"), "mix-drawn")

    tree = splitting_tree(drawn.groupBy("at").agg(F.count("*").alias("n")), shards, seed + 2)
    ends = Window.partitionBy("at").orderBy("shard")
    ends = tree.withColumn("end", F.sum("n").over(ends)).groupBy("at").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    passes = drawn.groupBy("at", "pass").agg(F.count("*").alias("n"))
    offset = passes.withColumn("offset", F.sum("n").over(Window.partitionBy("at").orderBy("pass")) - F.col("n")).drop("n")
    rank = F.col("offset") + F.col("place")
    placed = drawn.join(offset, ["at", "pass"]).join(ends, "at").withColumn(
        "shard", F.least(F.aggregate("ends", F.lit(0), lambda s, e: s + F.when(e <= rank, 1).otherwise(0)), F.lit(shards - 1)))
    placed = placed.groupBy("__source", "__none", "__block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("placed"))

    out = own.join(placed, ["__source", "__none", "__block"], "left").join(goal.select("__source", "__none", "source_size", "target"), ["__source", "__none"], "left")
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField("pass", T.LongType()), T.StructField("shard", T.IntegerType())])))
    return out.select(*[f"`{c}`" for c in docs.columns], "size", "source_size", "target",
                      F.when(F.col("placed").isNull(), 0).otherwise(F.size("placed")).alias("copies"),
                      F.coalesce("placed", empty).alias("placed"))


def mix(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = 7, **options) -> DataFrame:
    """The mixed documents themselves: each copy a row, dealt to its shard, shuffled there."""
    copies = allot(docs, key=key, shards=shards, seed=seed, **options).withColumn("__copy", F.explode("placed"))
    order = F.xxhash64(F.lit(seed + 3), F.col("__copy.shard"), F.col("__copy.pass"), F.col(f"`{key}`"))
    # a shard is one logical unit of the output; its rows are spread by the order they get anyway
    rows = copies.withColumn("__shard", F.col("__copy.shard")).withColumn("__order", order)
    return rows.repartitionByRange("__shard", "__order").sortWithinPartitions("__shard", "__order").select(*[f"`{c}`" for c in docs.columns])

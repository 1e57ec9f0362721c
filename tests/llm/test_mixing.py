from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from logtide.llm import mixing, registry
from tests.llm import cases


def _targets(sizes):
    """Sources in code-point order, null last; clip and reshare until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, w[s] * level) for s in names}
        capped |= {s: 3 * sizes[s] for s in over}


def test_query_on_awkward_documents(spark, tmp_dir):
    docs = cases.documents(spark)
    folder = cases.save(docs, tmp_dir)
    out = registry.QUERIES["op5_mixing"](spark, folder)
    rows = out.collect()
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and len(rows) == docs.count()
    source = {(r.doc_id, len(cases.words(r.text))): r.source for r in docs.collect()}
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(cases.words(r.text))
    want = _targets(dict(sizes))
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in rows:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.05 * t, largest[s])
    again = registry.QUERIES["op5_mixing"](spark, folder).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_targets_are_reshared(spark):
    sizes = {"a": 10, "b": 100, "c": 10_000, "d": 3, None: 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    for s, t in _targets(sizes).items():
        assert abs(got[s] - t) < 1e-6


def test_hypergeometric_draws(spark):
    u = (F.col("id") + 0.5) / 4000
    k = [r.k for r in spark.range(4000).select(mixing.hypergeometric(F.lit(60), F.lit(25), F.lit(20), u).alias("k")).collect()]
    from math import comb

    p = [comb(25, i) * comb(35, 20 - i) / comb(60, 20) for i in range(21)]
    got = np.bincount(k, minlength=21) / 4000
    assert np.abs(got - p).max() < 1e-3
    edge = spark.range(1).select(*[mixing.hypergeometric(F.lit(t), F.lit(g), F.lit(d), F.lit(x)).alias(f"c{i}") for i, (t, g, d, x) in
                                   enumerate([(0, 0, 0, 0.3), (5, 5, 2, 0.9), (5, 0, 2, 0.9), (7, 3, 7, 0.1), (10**7, 10**6, 5 * 10**6, 0.5)])]).first()
    assert list(edge)[:4] == [0, 2, 0, 3] and abs(edge[4] - 500_000) < 5


def test_splitting_tree_keeps_every_sum(spark):
    quotas = {0: 100, 1: 57, 2: 0, 3: 999}
    tree = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "at int, n long"), 8, 5).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in tree:
        assert r.n >= 0
        by_source[r.at] += r.n
        by_shard[r.shard] += r.n
    assert dict(by_source) == quotas and max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 8


def test_mix_returns_the_copies(spark):
    docs = cases.documents(spark).where("doc_id is not null")
    plan = mixing.allot(docs, shards=4)
    mixed = mixing.mix(docs, shards=4)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.n for r in plan.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {d: n for d, n in want.items() if n}
    assert mixing.mix(cases.empty(spark)).count() == 0
    assert mixing.allot(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("target"), F.sum("size")).first()[:] == (0.0, 0)


def test_no_python_on_the_way(spark):
    plan = mixing.mix(cases.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_and_repeated_keys_come_near_their_targets(spark):
    rng = __import__("random").Random(6)
    for key in (None, 7):
        rows = [(key, cases.sentence(rng, 80), "a") for _ in range(300)] + [(i, cases.sentence(rng, 200), "b") for i in range(30)]
        out = mixing.allot(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect():
            assert abs(r.taken - r.target) <= 0.05 * r.target

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from logtide.llm import importance, registry
from tests.llm import cases

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def _brute(rows, target, n=1, buckets=10_000, percent=10, least=20):
    """(id, n_features, weight, score, rank) of every row, in plain Python."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, _grams(text, n)[1]))
    for text in target:
        t.update(map(bucket, _grams(text, n)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * float(s_all + buckets) / ((s[b] + 1.0) * float(t_all + buckets))))
    out = []
    for key, text in rows:
        words, grams = _grams(text, n)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams)
        out.append([key, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), words])
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(enough) // 100
    ranks = {}
    for i, r in enumerate(enough):
        ranks.setdefault(id(r), i + 1 if i < drawn else None)
    return [(*r[:4], ranks.get(id(r))) for r in out]


def _same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


def _benchmark(spark, docs):
    texts = [r.text for r in docs.where("doc_id in (3, 5, 9, 108)").collect()] + [None, ""]
    return texts, spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "item_id long, text string")


def test_query_equals_brute_force(spark, tmp_dir):
    docs = cases.documents(spark)
    texts, bench = _benchmark(spark, docs)
    folder = cases.save(docs, tmp_dir)
    cases.save(bench, tmp_dir, "benchmark")
    out = registry.QUERIES["op13_importance"](spark, folder)
    assert out.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    want = _brute([(r.doc_id, r.text) for r in docs.collect()], texts)
    assert any(r[4] for r in want) and any(r[4] is None for r in want)
    _same([tuple(r) for r in out.collect()], want)


def test_longer_grams_and_other_parameters(spark):
    docs = cases.documents(spark).select("doc_id", "text")
    texts, bench = _benchmark(spark, docs)
    out = importance.resample(docs, bench, percent=50, least_words=3, n=3, buckets=97)
    want = _brute([(r.doc_id, r.text) for r in docs.collect()], texts, n=3, buckets=97, percent=50, least=3)
    _same([tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()], want)


def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 16)
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice(["a", "B", "é", "日", " ", "-", "9", "long" * 40]) for _ in range(rng.randint(0, 60)))
        for n in (1, 2):
            words, grams = _grams(text, n)
            got = importance.hashes(text.encode(), n)
            assert got == (words, Counter(zlib.crc32(g.encode()) for g in grams))


def test_empty_tables_repeated_rows_and_other_columns(spark):
    empty = cases.empty(spark)
    assert importance.resample(empty, empty).count() == 0
    docs = cases.documents(spark).withColumn("rank", F.lit("mine")).withColumn("weight", F.lit("mine"))
    out = importance.resample(docs, empty)
    assert out.columns == [c for c in docs.columns if c not in ("text", "rank", "weight", "score")] + ["n_words", "n_features", "weight", "score", "rank"]
    assert out.count() == docs.count()
    # one row a thousand times: alike but in rank, and no partition holds them all
    text = cases.sentence(random.Random(1), 30)
    same = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(6)
    rows = importance.resample(same, same.limit(1), percent=100).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 1001)) and len({(r.weight, r.score) for r in rows}) == 1

import hashlib

import numpy as np
from pyspark.sql import functions as F

from logtide.llm import fingerprints, registry
from tests.llm import cases


def _jaccard(a, b):
    a, b = cases.shingle_set(a), cases.shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark, tmp_dir):
    docs = cases.documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    out = registry.QUERIES["op6_fingerprints"](spark, cases.save(docs, tmp_dir))
    assert out.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    seen = {}
    for i, (d, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = got[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        exact = max(len(cases.shingle_set(text)), len(cases.shingle_set(edited))) < fingerprints.K
        assert abs(r.near_edited - _jaccard(text, edited)) < (1e-9 if exact else 0.2)
        assert abs(r.near_next - _jaccard(text, after)) < 0.2
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.near_edited == 1.0) if edited == text else True


def test_null_ids_one_document_and_none(spark, tmp_dir):
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (3, "x"), (3, "y")], "doc_id long, text string")
    assert registry.QUERIES["op6_fingerprints"](spark, cases.save(docs, f"{tmp_dir}/a")).count() == 4
    one = registry.QUERIES["op6_fingerprints"](spark, cases.save(docs.where("doc_id = 3").limit(1), f"{tmp_dir}/b")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert registry.QUERIES["op6_fingerprints"](spark, cases.save(docs.limit(0), f"{tmp_dir}/c")).count() == 0


def test_estimates_and_merging(spark):
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(4000)]
    a = " ".join(rng.choice(pool, 1500))
    b = a[: len(a) // 2] + " " + " ".join(rng.choice(pool, 700))
    docs = spark.createDataFrame([(1, a), (2, b), (3, ""), (4, None)], "doc_id long, text string")
    s = fingerprints.fingerprints(docs)
    pair = s.where("doc_id = 1").select(F.col("sketch").alias("a")).crossJoin(s.where("doc_id = 2").select(F.col("sketch").alias("b")))
    r = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
                    fingerprints.distinct_shingles(F.col("a")).alias("n")).first()
    sa, sb = cases.shingle_set(a), cases.shingle_set(b)
    assert abs(r.r - len(sa & sb) / len(sa | sb)) < 0.15 and abs(r.c - len(sa & sb) / len(sa)) < 0.2 and abs(r.n / len(sa) - 1) < 0.35
    # sketches of parts merge into the sketch of the union of their shingles
    parts = s.withColumn("all", F.lit("all"))
    whole = fingerprints.merged(parts, "all").first().sketch
    both = sorted(set(s.where("doc_id = 1").first().sketch) | set(s.where("doc_id = 2").first().sketch))[: fingerprints.K]
    assert whole == both
    assert fingerprints.merged(s, "doc_id").where("size(sketch) = 0").count() == 2
    assert fingerprints.fingerprints(cases.empty(spark)).count() == 0

from collections import Counter

import numpy as np
import pytest

from logtide.llm import components, minhash, registry
from tests.llm import cases


def _classes(rows, least=0.8):
    """Class of each row by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [cases.shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or (sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = Counter()
    for ids in groups.values():
        known = [x for x in ids if x is not None]
        for d in ids:
            out[(d, min(known) if known else None, len(ids))] += 1
    return out


@pytest.mark.parametrize("block", [128, 3])
def test_classes_against_all_pairs(spark, tmp_dir, block, monkeypatch):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    out = minhash.near_duplicates(docs, keep=["doc_id"], block=block).select("doc_id", "class_id", "class_size")
    assert Counter(map(tuple, out.collect())) == _classes(rows)


def test_query_and_one_of_each(spark, tmp_dir):
    docs = cases.documents(spark)
    out = registry.QUERIES["op9_minhash"](spark, cases.save(docs, tmp_dir))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = _classes(rows)
    assert Counter(map(tuple, out.collect())) == want
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    left = Counter(r.doc_id for r in kept.collect())
    # one row of each class: that of the least id
    assert left[5] == 1 and left[111] == left[112] == 0 and left[100] + left[101] == 1
    n = sum(1 / size * k for (_, _, size), k in want.items())
    assert sum(left.values()) == round(n)
    assert minhash.one_of_each(cases.empty(spark)).count() == 0 == minhash.near_duplicates(cases.empty(spark)).count()


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(30):
        h = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = rng.integers(1, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float)
        s = minhash.signatures(np.repeat([0, 1], 60), np.concatenate([h, h]), np.concatenate([a, b]), 2, 512)
        assert (s != 2**64 - 1).all()
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.04


def test_counted_shingles(spark):
    docs = spark.createDataFrame([(1, "a b c d e " * 20), (2, "a b c d e " * 10), (3, "a b c d e " * 19)], "doc_id long, text string")
    sets = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    counted = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, counts=True).collect()}
    assert sets == {1: 1, 2: 1, 3: 1} and counted == {1: 1, 2: 2, 3: 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (300, 100), (500, 400)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[300] and got[400] == got[500] and len(set(got.values())) == 3
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

import hashlib
import random
from collections import Counter

import pytest

from logtide.llm import debruijn, registry
from tests.llm import cases


def _brute(rows, window):
    """rows: (id, text); null ids are later than all others and not earlier than each other."""
    order = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        w = t.encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, float("inf")), order(d))
    out = Counter()
    for d, t in rows:
        w = t.encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(d):
                gone[i : i + window] = b"\1" * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(d, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_query_against_brute_force(spark, tmp_dir):
    docs = cases.documents(spark)
    out = registry.QUERIES["op10_debruijn"](spark, cases.save(docs, tmp_dir))
    assert out.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, out.collect())) == _brute([(r.doc_id, r.text or "") for r in docs.collect()], 50)


@pytest.mark.parametrize("window,gram", [(6, 2), (5, 5), (9, 1)])
def test_branching_graphs(spark, window, gram):
    rng = random.Random(window)
    base = [[f"w{rng.randrange(12)}" for _ in range(80)] for _ in range(3)]
    rows = []
    for i in rng.sample(range(1000), 70):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(80)] = f"x{rng.randrange(5)}"
        a = rng.randrange(40)
        rows.append((i, " ".join(w[a : a + rng.randint(0, 60)])))
    rows += [(rows[0][0], rows[1][1]), (None, rows[2][1]), (None, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    from pyspark.sql import functions as F

    got = debruijn.without_repeats(df, window=window, gram=gram).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == _brute(rows, window)


def test_both_joins_agree(spark, monkeypatch):
    from logtide.llm import bounded

    docs = cases.documents(spark)
    a = sorted(debruijn.without_repeats(docs).select("n_words", "n_removed", "kept").collect())
    monkeypatch.setattr(bounded.join_counted, "__defaults__", (0,))
    b = sorted(debruijn.without_repeats(docs).select("n_words", "n_removed", "kept").collect())
    assert a == b
    assert debruijn.without_repeats(cases.empty(spark)).count() == 0


def test_long_lists_travel_by_key(spark, monkeypatch):
    docs = cases.documents(spark).select("doc_id", "text")
    monkeypatch.setattr(debruijn, "MOST_BYTES", 0)
    got = debruijn.without_repeats(docs, window=8, gram=3)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "kept"]
    rows = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()]
    assert Counter(rows) == _brute([(r.doc_id, r.text or "") for r in docs.collect()], 8)

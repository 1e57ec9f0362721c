import hashlib
import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logtide.llm import registry, suffixes
from tests.llm import cases


def _brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _same(rows, texts, want):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == Counter((d, *w) for (d, _), w in zip(texts, want))


def test_query_against_brute_force(spark, tmp_dir):
    docs = cases.documents(spark)
    out = registry.QUERIES["op8_suffixes"](spark, cases.save(docs, tmp_dir))
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    # the very long text has no repeat with others beyond what shorter ones show; brute force takes all of them
    _same(out.collect(), texts, _brute([t for _, t in texts], 400))


@pytest.mark.parametrize("length,gram,groups,seed", [(20, 6, (4, 2), 5), (20, 6, (), 7), (23, 22, (5,), 3), (7, 2, (3, 1), 4)])
def test_other_lengths_with_many_match_ends(spark, length, gram, groups, seed):
    import random

    rng = random.Random(length)
    base = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(4)]
    texts = []
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice("abcdxyz")
        a = rng.randint(0, 100)
        texts.append((i, "".join(t[a : a + rng.randint(0, 250)]).encode()))
    texts += [(100, b"a" * 90), (101, b"ab" * 40), (102, b"")]
    df = spark.createDataFrame([(d, t.decode()) for d, t in texts], "doc_id long, text string").repartition(3)
    out = suffixes.without_repeats(df, length=length, gram=gram, groups=groups, seed=seed)
    from pyspark.sql import functions as F

    rows = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).collect()
    _same(rows, texts, _brute([t for _, t in texts], length))


def test_empty_and_columns(spark):
    assert suffixes.without_repeats(cases.empty(spark)).count() == 0
    out = suffixes.without_repeats(cases.documents(spark))
    assert out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "binary"


def test_rounds():
    assert suffixes._rounds(400, 100) == [(100, 100), (200, 200)]
    assert suffixes._rounds(23, 5) == [(5, 5), (10, 10), (20, 3)]
    assert list(suffixes._offsets(400, 100)) == [0, 100, 200, 300]


def test_tasks_take_a_few_texts_at_a_time_and_spans_as_longs():
    texts = [b"x" * (i % 50) for i in range(2000)]
    spans = pa.array([None if i % 3 == 0 else [] if i % 3 == 1 else [(2 << 32) | 4, (30 << 32) | 1] for i in range(2000)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), spans], names=["doc_id", "text", "spans"])
    taken = []
    out = list(suffixes._without(10, 1)(taken.append(b.num_rows) or b for b in [batch]))
    assert taken == [2000] and max(b.num_rows for b in out) <= 512
    got = list(itertools.chain.from_iterable(zip(*[c.to_pylist() for c in b.columns]) for b in out))
    for i, text in enumerate(texts):
        gone = np.zeros(100, dtype=bool)
        if i % 3 == 2:
            gone[2:15], gone[30:40] = True, True
        if len(text) >= 40 or i % 3 < 2:  # else the spans end beyond the text
            kept = bytes(b for b, g in zip(text, gone) if not g)
            assert got[i] == (i, len(text), len(text) - len(kept), 2 if i % 3 == 2 else 0, kept)
    listed, at = suffixes._lists(spans.slice(1, 5))
    assert at.tolist() == [0, 0, 2, 2, 2, 4] and listed.tolist() == [(2 << 32) | 4, (30 << 32) | 1] * 2

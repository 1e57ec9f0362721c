import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from logtide.llm import packing, registry
from tests.llm import cases


def _check(rows, want, window):
    """Exact round trip: every id in one piece, sequences gapless and within the window."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for d, texts in want.items():
        own = sorted(pieces[d], key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(len(t) for t in texts)
        if len(texts) == 1:
            at = 0
            for r in own:
                assert r.start == at and r.doc_tokens == len(texts[0])
                assert r.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + r.length], dtype="<u4").tobytes())
                at += r.length
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sequences


def test_round_trip_and_padding(spark, tmp_dir):
    docs = cases.documents(spark)
    out = registry.QUERIES["op4_packing"](spark, cases.save(docs, tmp_dir))
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    t = Tokenizer.from_file(registry.tokenizer_path())
    t.encode_special_tokens = True
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*t.encode(r.text or "", add_special_tokens=False).ids, 1])
    sequences = _check(out.collect(), want, 2048)
    sizes = [sum(r.length for r in s) for s in sequences.values()]
    assert sum(2048 - n for n in sizes) < 0.15 * sum(sizes)  # five small partitions


def test_many_small_partitions_are_merged(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(400)], "doc_id long, text string").repartition(40)
    rows = packing.pack(docs, registry.tokenizer_path(), open_windows=4).collect()
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert len(sizes) <= sum(sizes.values()) / 2048 + 8  # one open window for each group of partitions, at most
    assert packing.pack(cases.empty(spark), registry.tokenizer_path()).count() == 0


def test_special_tokens_in_a_text_and_odd_characters(spark):
    encoder = packing.Encoder(registry.tokenizer_path())
    plain = Tokenizer.from_file(registry.tokenizer_path())
    plain.encode_special_tokens = True
    for text in ("<|endoftext|>", "a\x1cb", "日本語 word", "don't  stop\n\n 12é", "", "   x", "İ ſ K²½"):
        assert encoder.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("window", [8, 64])
def test_packer_bounds(window):
    rng = np.random.default_rng(0)
    count = iter(range(10**9))
    p = packing.Packer(window, 3, 2, lambda: next(count))
    sizes = rng.integers(1, 3 * window, 300).tolist()
    for i, n in enumerate(sizes):
        p.add(i, n)
        assert len(p.open) <= 3
    got = [0] * len(sizes)
    for w in p.closed + p.open:
        assert sum(x[2] for x in w[2]) == window - w[0] <= window
        for doc, start, n, _ in w[2]:
            got[doc] += n
    assert got == sizes and all(w[0] < 2 + 2 for w in p.closed)


def test_merge_is_best_fit_decreasing():
    at = packing.merge_windows([5, 7, 3, 1, 10], 10)
    assert at[4] == (0, 0) and at[1] == (1, 0) and at[2] == (1, 7)
    assert len({w for w, _ in at}) == 3

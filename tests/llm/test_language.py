import zlib

import numpy as np

from logtide.llm import language, registry
from tests.llm import cases


def _ppm(texts, order):
    """Context counts as plain dictionaries."""
    tree = {}
    for t in texts:
        padded = b"\x00" * order + t
        for i, byte in enumerate(t):
            for k in range(order + 1):
                ctx = padded[i + order - k : i + order]
                tree.setdefault(ctx, {}).setdefault(byte, 0)
                tree[ctx][byte] += 1
    return tree


def _probabilities(tree, ctx, order):
    """Distribution over 256 bytes after ctx, by escapes with exclusion."""
    p = np.full(256, 1 / 256)
    for k in range(order + 1):
        seen = tree.get(ctx[len(ctx) - k :])
        if not seen:
            continue
        n, d = sum(seen.values()), len(seen)
        rest = p.copy()
        rest[list(seen)] = 0
        left = rest.sum()
        p = rest / left * (d / (n + d)) if left > 0 else np.zeros(256)
        for b, c in seen.items():
            p[b] = c / (n + (d if left > 0 else 0))
    return p


def test_code_lengths_are_those_of_plain_ppm(spark):
    train = ["abracadabra abra", "cabra é b"], ["der die das", "ddr"]
    df = spark.createDataFrame([(t, lang) for lang, ts in zip(("x", "y"), train) for t in ts], "text string, lang string")
    model = language.train(df)
    assert model.languages == ["x", "y"]
    texts = ["abra der", "zzz q", "é", "", "abc" * 30]
    got = model.code_lengths([t.encode() for t in texts])
    for j, ts in enumerate(train):
        tree = _ppm([t.encode() for t in ts], 3)
        for i, t in enumerate(texts):
            raw = b"\x00" * 3 + t.encode()
            bits = -sum(np.log2(_probabilities(tree, raw[k : k + 3], 3)[raw[k + 3]]) for k in range(len(raw) - 3))
            assert abs(got[i, j] - bits) < 1e-3 * max(1, bits)


def test_held_out_accuracy_and_awkward_texts(spark, tmp_dir):
    docs = cases.documents(spark)
    out = registry.QUERIES["op1_language"](spark, cases.save(docs, tmp_dir))
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            text = lang[r.doc_id][1]
            if text is None or not any(c.isalpha() for c in text):
                assert r.lang_pred == "und"
            elif r.doc_id < 60 or r.doc_id >= 200:
                assert r.lang_pred == lang[r.doc_id][0]


def test_nothing_learned(spark):
    docs = cases.documents(spark)
    model = language.train(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in language.identify(docs, model).select("lang_pred").collect()} == {"und"}
    assert language.identify(cases.empty(spark), model).count() == 0


def test_table_is_bounded(spark):
    docs = cases.documents(spark)
    model = language.train(docs, max_cells=4000)
    assert model.bits.size <= 4000 + model.bits.shape[1] * model.bits.shape[2]
    assert np.allclose(np.exp2(-model.bits.astype(float)).clip(0, 1).sum(1) + 0, np.exp2(-model.bits.astype(float)).sum(1))


def test_code_lengths_do_not_depend_on_the_room_of_the_table(spark):
    """Contexts outside the table count as those inside, for a language with few texts too."""
    common = ["the cat sat on the mat and the dog ran " * 20, "a quick brown fox jumps over the lazy dog " * 20] * 10
    df = spark.createDataFrame([(t, "x") for t in common] + [("žluťoučký kůň pěl", "y")], "text string, lang string")
    texts = [b"the dog sat", "kůň pěl ó".encode(), b"zzq\x00a", b""]
    want = language.train(df).code_lengths(texts)
    for cells in (1, 400, 2000, 6000):
        model = language.train(df, max_cells=cells)
        assert model.languages == ["x", "y"] and model.sparse
        assert np.allclose(model.code_lengths(texts), want, rtol=1e-4, atol=1e-3), cells

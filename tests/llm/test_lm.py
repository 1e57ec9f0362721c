import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from logtide.llm import lm, registry
from tests.conftest import SF001
from tests.llm import cases


def test_counts_base_and_gain(spark, tmp_dir):
    docs = cases.documents(spark)
    out = registry.QUERIES["op2_lm"](spark, cases.save(docs, tmp_dir))
    assert out.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    c = Counter()
    for d, t in texts:
        if not held(d):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in texts:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[(d, held(d), len(w), sum(x in c for x in w), n, round(base, 5))] += 1
    rows = out.collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score < 0 for r in rows) and sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)


def test_model_beats_frequencies_on_held_out_text(spark):
    by = {r.held_out: r for r in registry.QUERIES["op2_lm"](spark, SF001).groupBy("held_out").sum("score", "base_score").collect()}
    for r in by.values():
        assert r["sum(score)"] > r["sum(base_score)"]


def test_classes_are_normalised():
    totals = np.arange(1, lm.OWN_CLASSES + lm.SHARED_CLASSES + 1)
    p = lm.start(totals)
    f = lm.frequencies(totals)
    assert np.allclose(np.exp(p.log_probabilities(np.arange(50), np.arange(50, 100), f)).sum(1), 1, atol=1e-4)
    # before training every context gives about the classes' frequencies
    assert np.abs(np.exp(p.log_probabilities(np.array([3]), np.array([4]), f)[0]) - f).max() < 0.01


def test_training_learns_a_pattern():
    n = lm.OWN_CLASSES + lm.SHARED_CLASSES
    two, one = np.meshgrid(np.arange(8), np.arange(8))
    goal = (one + 1) % 8
    triple = ((two * n + one) * n + goal).ravel()
    totals = np.zeros(n, dtype=np.int64)
    totals[:8] = 100
    p = lm.nce(lm.start(totals), triple, np.full(len(triple), 10), totals, 1)
    hit = p.log_probabilities(two.ravel(), one.ravel(), lm.frequencies(totals))[np.arange(64), goal.ravel()]
    assert np.exp(hit).mean() > 0.5


def test_rare_words_are_looked_up_alike(spark, monkeypatch):
    docs = cases.documents(spark, 30)
    whole = lm.score(docs, docs, ["doc_id"]).groupBy().sum("n_known", "base_score").first()
    monkeypatch.setattr(lm.vocabulary, "__defaults__", ("text", 200))
    few = lm.score(docs, docs, ["doc_id"]).groupBy().sum("n_known", "base_score").first()
    assert whole[0] == few[0] and abs(whole[1] - few[1]) < 1e-6 * abs(whole[1])


def test_empty(spark):
    docs = cases.documents(spark, 12)
    rows = lm.score(docs, cases.empty(spark), ["doc_id"]).collect()
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert lm.score(cases.empty(spark), docs, ["doc_id"]).count() == 0


def _vocabulary(words):
    """Of `words` by frequency, the most frequent first."""
    n = np.arange(len(words), 0, -1) + 100
    cls = np.array([i if i < lm.OWN_CLASSES else lm.shared_class(w) for i, w in enumerate(words)])
    size = lm.OWN_CLASSES + lm.SHARED_CLASSES
    return lm.Vocabulary({w: i for i, w in enumerate(words)}, cls, n, np.bincount(cls, n, size).astype(np.int64), np.bincount(cls, minlength=size), int(n.sum()), len(words))


def test_items_are_normalised_over_all_classes():
    vocab = _vocabulary([b"%dx%03d" % (i, i % 7) for i in range(2000)])
    tree = lm.Tree(vocab)
    p, items = lm.start(vocab.class_total), lm.start_items(tree)
    rng = np.random.default_rng(1)
    for x in vars(items).values():
        x += 0.3 * rng.standard_normal(x.shape).astype(np.float32)
    goal = np.arange(len(tree.item_class))
    # classes 0 to OWN_CLASSES have one item each; a shared class without words has its rest
    assert set(tree.item_class) == set(range(lm.OWN_CLASSES + lm.SHARED_CLASSES))
    for two, one in ((3, 1500), (1999, 140)):
        got = lm.log_probabilities(p, items, tree, np.full(len(goal), two), np.full(len(goal), one), goal, lm.frequencies(vocab.class_total))
        assert abs(np.exp(got).sum() - 1) < 1e-4


def test_words_of_one_class_are_told_apart(spark):
    """Beyond the OWN_CLASSES most frequent words, all of one class: only their own vectors know which follows which."""
    rng = np.random.default_rng(2)
    common = [f"w{i}" for i in range(lm.OWN_CLASSES)]
    pairs = [(f"a{i}same", f"b{i}same") for i in range(20)]
    texts = []
    for i in range(400):
        words = [w for j in rng.integers(0, len(pairs), 60) for w in pairs[j]]
        texts.append((i, " ".join([*words, *common * 4])))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    c = Counter(w for _, t in texts for w in t.split())
    assert max(c[w] for pair in pairs for w in pair) > 0 and {lm.shared_class(w.encode()) for pair in pairs for w in pair} == {lm.shared_class(b"same")}
    vocab, _ = lm.vocabulary(docs)
    # the words in question are not frequent enough for a class of their own
    beyond = [w for pair in pairs for w in pair if vocab.head_class[vocab.head[w.encode()]] >= lm.OWN_CLASSES]
    p, items = lm.train(docs, vocab)
    tree = lm.Tree(vocab)
    item = lambda w: tree.of_head[vocab.head[w.encode()]]
    some = [(a, b) for a, b in pairs if a in beyond and b in beyond]
    assert len(some) >= 10
    one, goal, other = (np.array([item(x) for x in xs]) for xs in ([a for a, _ in some], [b for _, b in some], [b for _, b in some[1:] + some[:1]]))
    f = lm.frequencies(vocab.class_total)
    two = np.full(len(one), item(some[0][1]))
    right, wrong = (lm.log_probabilities(p, items, tree, two, one, g, f) for g in (goal, other))
    assert (right - wrong).mean() > 1


def test_draws_follow_tokens(monkeypatch):
    steps = []
    monkeypatch.setattr(lm.Trainer, "step", lambda self, two, one, goal: steps.append(len(goal)))
    totals = np.ones(lm.OWN_CLASSES + lm.SHARED_CLASSES, dtype=np.int64)
    lm.nce(lm.start(totals), np.arange(5), np.full(5, 200_000), totals, 1)
    assert sum(steps) == lm.EPOCHS * 1_000_000


def test_scoring_holds_little_beside_its_tokens():
    """Contexts met again are not held again: vectors of all tokens would take 38 MB a copy here."""
    vocab = _vocabulary([b"%dx%03d" % (i, i % 7) for i in range(2000)])
    tree = lm.Tree(vocab)
    p, items, rng = lm.start(vocab.class_total), lm.start_items(tree), np.random.default_rng(4)
    two, one, goal = rng.integers(0, len(tree.item_class), (3, 100))[:, rng.integers(0, 100, 400_000)]
    tracemalloc.start()
    out = lm.log_probabilities(p, items, tree, two, one, goal, lm.frequencies(vocab.class_total))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 400_000 and peak < 60 << 20
    few = lm.log_probabilities(p, items, tree, two[:50], one[:50], goal[:50], lm.frequencies(vocab.class_total))
    assert np.allclose(out[:50], few, atol=1e-5)


def test_great_logits_stay_finite():
    s = np.array([[500.0, 499, -500], [-500, -501, -700], [0, 1, 2]], dtype=np.float32)
    want = np.exp(s.astype(float) - s.max(1, keepdims=True))
    e = lm._exp(s.copy())
    assert np.allclose(e / e.sum(1, keepdims=True), want / want.sum(1, keepdims=True), atol=1e-6)

import math
import random

import numpy as np
import pytest

from logtide.llm import registry, whitening
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def _frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], schema).repartition(4)


def _brute(rows, k=8):
    """{id: [(deviation, whitened)]}, explained, n: whole numbers, exact sums, numpy's own eigenvectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    z = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in good], deviation, z @ u / np.sqrt(e), e / np.trace(v), n


def _vectors(n=400, d=20, seed=2):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 0.2 + rng.standard_normal(d)
    return [(i, [float(c) for c in row]) for i, row in enumerate(m)]


def test_query_equals_brute_force(spark, tmp_dir):
    rows = _vectors()
    rows[7] = (None, rows[7][1])
    rows += [(rows[3][0], rows[3][1]), (900, None), (901, []), (902, [None] * 20), (903, [float("nan")] * 20), (904, [float("inf")] + [0.0] * 19), (905, [1.0, 2.0]), (906, [1e38] * 20)]
    folder = cases.save(_frame(spark, rows), tmp_dir, "embeddings")
    out = registry.QUERIES["op11_whitening"](spark, folder)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    ids, deviation, white, explained, n = _brute([r for r in rows if r[0] not in (905, 906)])
    got = out.collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    key = lambda i, d: (i is None, i or 0, d)
    for c in range(8):
        own = sorted((key(r.vec_id, r.deviation), r.whitened, r.explained) for r in got if r.component == c + 1)
        want = sorted((key(i, d), w) for i, d, w in zip(ids, deviation, white[:, c]))
        assert [o[0] for o in own] == [w[0] for w in want]
        a, b = np.array([o[1] for o in own]), np.array([w[1] for w in want])
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-9
        assert abs(own[0][2] / explained[c] - 1) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_leading_pairs_of_awkward_matrices(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    spectra = [np.arange(1, n + 1), np.ones(n), np.repeat([5.0, 5.0 + 1e-13, 1.0], n)[:n], 10.0 ** -np.arange(n), np.where(np.arange(n) < 2, 1.0, 0.0), np.linspace(1, 1 + 1e-9, n)]
    for values in spectra:
        for m in ((q * values) @ q.T * 1e4, np.diag(values.astype(float)) * 1e4):
            m = (m + m.T) / 2
            e, v = whitening.leading(m, 8)
            want = np.linalg.eigvalsh(m)[::-1][: len(e)]
            assert len(e) >= min(8, n, int((values > 1e-12 * values.max()).sum()))
            assert np.abs(e - want).max() < 1e-13 * want[0] * n
            assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-11
            assert np.abs(m @ v - v * e).max() < 1e-12 * want[0] * n


def test_sturm_counts():
    rng = random.Random(3)
    d, off = np.array([rng.gauss(0, 1) for _ in range(12)]), np.array([rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(11)])
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(off, 1) + np.diag(off, -1))
    at = np.concatenate([values - 1e-9, values + 1e-9])
    assert list(whitening.below(d, off, at)) == [int((values < x).sum()) for x in at]


def test_equal_few_and_no_vectors(spark):
    def run(rows):
        return whitening.whiten(_frame(spark, rows), ["vec_id", "label"]).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [0.5, 1.0])]) == [] and run([(i, [0.5, 1.0]) for i in range(20)]) == []
    line = run([(i, [float(i), 2.0 * i, 0.0]) for i in range(30)])  # one direction only
    assert len(line) == 30 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9
    # lengths that tie: the shorter
    assert {r.vec_id for r in run([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0, 3.0]), (3, [3.0, 2.0, 1.0])])} == {0, 1}


def test_large_deviations_are_exact_or_null(spark):
    rows = [(i, [float(2**k) for k in range(8, 26)]) for i in range(40)] + [(100, [float(2**29)] * 18), (101, [0.0] * 18)]
    ids, deviation, *_ = _brute(rows)
    got = {r.vec_id: r.deviation for r in whitening.whiten(_frame(spark, rows), ["vec_id"]).collect()}
    assert got == {i: (d if d < 2**62.9 else None) for i, d in zip(ids, deviation)} and None in got.values()

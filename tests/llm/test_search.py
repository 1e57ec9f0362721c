import duckdb
import numpy as np

from logtide.llm import registry, search
from tests.llm import cases


def _vectors(spark, n=700, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(dim)], 0) for i in range(n)]
    rows += [(10_000 + i, rows[50][1], 1) for i in range(300)]  # one common vector
    rows += [(10_000, rows[50][1], 1), (None, rows[0][1], 0), (20_000, None, 0), (20_050, [1.0, None] + [0.0] * (dim - 2), 0),
             (20_100, [float("nan")] * dim, 0), (20_150, [float("inf")] + [0.0] * (dim - 1), 0), (20_200, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def _brute(rows, k):
    use = {(r.vec_id, tuple(np.floor(256 * np.array(r.embedding, dtype=float)))) for r in rows
           if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)}
    out = []
    for q, v in use:
        if q % 50 == 0:
            best = sorted((-int(np.dot(v, x)), i) for i, x in use if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_query_equals_brute_force_and_sql(spark, tmp_dir):
    df = _vectors(spark)
    out = registry.QUERIES["op3_topk"](spark, cases.save(df, tmp_dir, "embeddings"))
    got = sorted(map(tuple, out.collect()))
    assert got == _brute(df.collect(), 5)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_dir}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.sql(registry.ORACLE["op3_topk"]).fetchall())


def test_small_blocks_and_few_pivots_give_the_same(spark):
    v = search.quantised(_vectors(spark, 150))
    asked = v.where("vec_id % 50 = 0")
    a = sorted(map(tuple, search.top_k(v, asked).collect()))
    b = sorted(map(tuple, search.top_k(v, asked, n_pivots=2, block_rows=32, query_rows=2).collect()))
    assert a == b


def test_fewer_than_k_shorter_vectors_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    v = search.quantised(df)
    got = sorted(map(tuple, search.top_k(v, v.where("vec_id % 50 = 0")).collect()))
    assert got == [(0, 1, 7, 512 * 256), (0, 2, 50, 256 * 256), (50, 1, 0, 256 * 256), (50, 2, 7, 0)]
    none = v.where("vec_id < 0")
    assert search.top_k(none, none).count() == 0
    assert search.top_k(v, none).count() == 0


def test_pruning_skips_most_of_clustered_candidates():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16)) * 50
    m = np.floor(np.repeat(centres, 100, 0) + rng.standard_normal((2000, 16)))
    m = np.floor(256 * m / np.linalg.norm(m, axis=1, keepdims=True))
    pivots = m[::100]
    gap = lambda x: np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T)).astype(np.float32)
    ids = np.arange(2000)
    counted = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype != bool:
                counted.append(len(at))
            return super().__getitem__(at).view(np.ndarray)

    out = list(search._best(ids[:40], m[:40], gap(m[:40]), ids, m.view(Counted), gap(m), np.full(40, -np.inf), 5))
    assert len(out) == 40 and sum(counted) < 0.5 * 40 * 2000
    for i, got, score in out:
        own = m @ m[i]
        own[i] = -np.inf
        assert (got == np.lexsort((ids, -own))[:5]).all()

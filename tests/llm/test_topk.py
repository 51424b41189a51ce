import numpy as np
import pytest

from tracklake.llm import topk


def brute(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[i] = np.floor(64 * np.array(v, np.float64)).astype(np.int64)
    width = max((len(v) for v in vectors.values()), default=0)
    ids = np.array(sorted(vectors))
    x = np.array([np.pad(vectors[i], (0, width - len(vectors[i]))) for i in ids]).reshape(len(ids), width)
    out = []
    for q in ids[ids % every == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(int(q), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
    return out


@pytest.mark.parametrize("block", [64, 8192])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=20) * rng.choice([0.1, 1, 5])).tolist()) for i in range(500)]
    same = rng.normal(size=20).tolist()
    rows += [(1000 + i, same) for i in range(200)]  # one vector for a large share of the rows
    rows += [(2000, None), (2001, [None] * 20), (2020, [float("nan")] * 20), (2040, [float("inf")] * 20), (None, same), (2060, [0.0] * 20), (2080, [1.0, 2.0]), (2100, []), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(map(tuple, topk.top_k(df, every=20, block=block, head=block).collect()))
    assert got == sorted(brute(rows, 20, 20))


def test_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 0.25]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(few).orderBy("query_id", "rank").collect()]
    assert got == brute([(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 0.25]), (20, [0.5, 0.5])], 20, 20)


def test_blocks_of_queries_and_clashing_names(spark):
    from pyspark.sql import functions as F

    # queries that reach all bands and queries that reach the longest ones only, over many blocks
    rng = np.random.default_rng(7)
    long = [(i, (rng.normal(size=6) * 40).tolist()) for i in range(0, 60)]
    rows = long + [(100 + i, (rng.normal(size=6) * 10.0 ** rng.integers(-2, 2)).tolist()) for i in range(1500)] + [(5000 + 4 * i, [0.0] * 6) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "length", "q", "band", "part", "score", "group", "need", "q_block", "rank")})
    got = sorted(map(tuple, topk.top_k(df, k=5, every=4, block=16, head=32).collect()))
    assert got == sorted(brute(rows, 5, 4))


def test_too_long_and_repeated_ids(spark):
    huge = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(huge)
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(twice).orderBy("query_id", "rank").collect()]
    assert [r[3] for r in got] == sorted((r[3] for r in got), reverse=True) and got[0][2:] == (2, 64 * 3 * 64)


def test_search_prunes_exactly():
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(size=(3000, 32)) * np.linspace(3, 0.01, 32)).astype(np.int64)
    q, ids = x[:40], np.arange(3000)
    rotation = np.linalg.svd(x.astype(float), full_matrices=True)[2].T
    best = topk.search(ids[:40], q, np.full(40, -np.inf), ids, x, rotation, 5, piece=128)
    scores = q @ x.T
    for n in range(40):
        order = [j for j in np.lexsort((ids, -scores[n])) if j != n][:5]
        mine = best.query == n
        assert best.id[mine].tolist() == order and best.score[mine].tolist() == scores[n][order].tolist()

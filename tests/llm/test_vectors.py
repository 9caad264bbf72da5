"""Exact and approximate search against brute force."""

import math
import pathlib

import numpy as np
from pyspark.sql import functions as F

from adjudica.llm.common import shared_dir
from adjudica.llm.permutation import nearest
from adjudica.llm.topk import HELD_BYTES, cells_of, top_k
from adjudica.llm.vectors import MOST_CELLS, grid


def fixture(spark, n=300, dim=8, integral=False):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(n, dim)).astype(np.float32)
    if integral:  # many ties
        v = np.round(v)
    v[10:90] = v[9]  # equal vectors
    rows = [(i * 5, x.tolist(), "x", 1) for i, x in enumerate(v)]
    rows += [(2000 * 50, None, "x", 1), (None, v[0].tolist(), "x", 1), (50 * 3001, [None] * dim, "x", 1), (50 * 3002, [float("nan")] * dim, "x", 1), (50 * 3003, [float("inf")] + [0.0] * (dim - 1), "x", 1), (50 * 3004, [], "x", 1), (50 * 3005, [1.0, 2.0], "x", 1), (50 * 3006, [2.0, 1.0], "x", 1), (50 * 3007, [0.0] * dim, "x", 1), (0, v[0].tolist(), "x", 1), (-50, v[3].tolist(), "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, dim int")
    good = [(i, [float(np.float32(x)) for x in e]) for i, e, *_ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    return df, good


def brute(good, k, every, score):
    out = []
    queries = {}
    for i, v in sorted(good):
        if i % every == 0:
            queries.setdefault(i, v)
    for q, v in queries.items():
        ranked = sorted((-score(v, c), i) for i, c in good if i != q and len(c) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked[:k])]
    return sorted(out)


def test_exact(spark):
    for integral in (False, True):
        df, good = fixture(spark, integral=integral)
        score = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
        for k, size in ((5, 4096), (3, 7)):
            found = top_k(df.repartition(3), k=k, size=size)
            assert found.columns == ["query_id", "rank", "vec_id", "score"]
            assert sorted(map(tuple, found.collect())) == brute(good, k, 50, score)
    assert top_k(df.limit(0)).count() == 0


def test_exact_search_moves_small_rows(spark):
    # Arrow batches are counted in rows: rows of megabytes took an executor's memory on larger tables
    draw = np.random.default_rng(5)
    v = np.round(draw.normal(size=(9000, 32)), 1)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>").coalesce(1)
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("adjudica-candidates-*"))
    found = sorted(map(tuple, top_k(df, every=100).collect()))
    (made,) = set(folder.glob("adjudica-candidates-*")) - before
    assert spark.read.parquet(str(made)).agg(F.max(F.octet_length("data"))).first()[0] <= 8192
    w = np.floor(256 * v.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 9000, 100):
        s = w @ w[q]
        order = [i for i in np.lexsort((np.arange(9000), -s)).tolist() if i != q][:5]
        assert found[q // 20 : q // 20 + 5] == [(q, r + 1, i, int(s[i])) for r, i in enumerate(order)]


def test_cells_of():
    for candidates, queries, dim in [(1, 1, 8), (51_000, 1000, 64), (615_000, 12_300, 64), (10**7, 2 * 10**5, 768), (10, 900, 3)]:
        rows, columns = cells_of(candidates, queries, dim, 6)
        assert 1 <= rows <= candidates and columns >= 1 and -(-queries // columns) * dim * 8 <= HELD_BYTES + 8 * dim
        assert rows * queries <= max(12 * queries, columns * candidates)  # queries aren't copied more often than candidates


def test_exact_beyond_doubles(spark):
    rows = [(0, [3.0e6, 1.0e6]), (1, [2.9e6, 5.0]), (2, [2.9e6, 6.0]), (3, [-3.0e6, 0.5])]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(i, s) for s, i in sorted(((sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(rows[0][1], v)), i) for i, v in rows[1:]), reverse=True)]


def test_index_is_exact_where_it_ranks_all_anew(spark):
    df, good = fixture(spark)
    good = [(i, v) for i, v in good if any(v)]
    found = nearest(df.repartition(3), k=6, every=50, pivots=16, length=4, share=1.0)
    expected = brute(good, 6, 50, lambda a, b: float(np.dot(np.array(a), np.array(b))))
    got = sorted(map(tuple, found.collect()))
    assert [x[:3] for x in got] == [x[:3] for x in expected]
    assert np.allclose([x[3] for x in got], [x[3] for x in expected], rtol=1e-12)
    assert nearest(df.limit(0)).count() == 0


def test_grid():
    for candidates, queries in [(1, 1), (13, 3), (500, 10), (10**6, 40_000), (3, 900)]:
        rows, columns = grid(candidates, queries, 6)
        assert 1 <= rows <= candidates and 1 <= columns <= queries and rows * columns <= 2 * MOST_CELLS
    rows, columns = grid(10**6, 40_000, 6)
    assert columns * 10**6 + rows * 40_000 < 30 * 10**6  # copies of blocks, where a column of groups alone would make 160 million


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = {}
    for r in nearest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(best & found[int(ids[q])]), total + 20
    assert hits / total >= 0.9


def test_recall_in_a_full_segment_with_near_copies_and_uneven_norms(spark):
    draw, n = np.random.default_rng(7), 16384
    v = draw.normal(size=(n, 32)) + draw.normal(size=(64, 32))[draw.integers(0, 64, n)] / 2
    near = draw.random(n) < 1 / 3
    v[near] = v[0] + 0.1 * draw.normal(size=(int(near.sum()), 32))
    for w in (v, v * np.exp(0.7 * draw.normal(size=(n, 1)))):
        df = spark.createDataFrame(list(enumerate(w.tolist())), "vec_id long, embedding array<double>")
        found = {}
        for r in nearest(df.coalesce(1), every=100).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        recall = []
        for q in found:
            s = w @ w[q]
            s[q] = -np.inf
            recall.append(len(set(np.argsort(-s, kind="stable")[:20].tolist()) & found[q]) / 20)
        assert len(recall) == 164 and np.mean(recall) >= 0.9, np.mean(recall)

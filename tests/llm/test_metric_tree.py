"""The M-tree search against all pairs."""

import numpy as np
import pytest

from siltwork.llm import metric_tree
from siltwork.llm.metric_tree import Best, MetricTree, exact_top_k

NAN, INF = float("nan"), float("inf")


def brute(rows, queries, k, scale=64):
    def whole(v):
        if v is None or any(x is None or not np.isfinite(x) or not np.isfinite(scale * x) for x in v):
            return None
        return [int(np.floor(scale * float(x))) for x in v]

    usable = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    for q, v in queries:
        w = whole(v)
        if q is None or w is None:
            continue
        scores = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(w, x)))), i) for i, x in usable if i != q and len(x) == len(w))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "k", 1.5) for i, v in rows], "vec_id long, embedding array<float>, id int, vector string, score double")


def clustered(seed, n, size, scale=0.3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, size))
    return (base[r.integers(12, size=n)] + r.normal(scale=scale, size=(n, size))).astype(np.float32)


@pytest.mark.parametrize("page,fanout,seed", [(4, 2, 0), (16, 4, 1), (8, 16, 2)])
def test_tree_is_exact(page, fanout, seed):
    x = np.floor(64 * clustered(seed, 700, 6).astype(np.float64))
    x[100:200] = x[100]
    x[300] = 0
    ids = np.random.default_rng(seed).permutation(5000)[:700].astype(np.int64)
    tree, best = MetricTree(ids, x, page=page, fanout=fanout), Best(ids[:300], 10)
    tree.search(x[:300], best)
    for q in range(300):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        assert best.scores[q].tolist() == s[order].tolist() and best.found[q].tolist() == ids[order].tolist()


def test_bounds_save_work():
    """On vectors of low dimension most objects are never compared."""
    x = np.floor(64 * clustered(3, 8000, 3, 0.05).astype(np.float64))
    ids = np.arange(8000)
    tree, best = MetricTree(ids, x, page=64), Best(ids[:500], 5)
    tree.search(x[:500], best)
    assert tree.computed < tree.met and tree.computed < 0.5 * 500 * 8000
    s = x[:500] @ x.T
    s[np.arange(500), np.arange(500)] = -INF
    assert (best.scores == -np.sort(-s, axis=1)[:, :5]).all()


@pytest.mark.parametrize("shard,piece,group,block,page", [(16_384, 64, 65_536, 2048, 256), (40, 2, 7, 3, 8)])
def test_search(spark, monkeypatch, shard, piece, group, block, page):
    for name, value in (("SHARD_ROWS", shard), ("PIECE_SHARDS", piece), ("GROUP_QUERIES", group), ("BLOCK_QUERIES", block)):
        monkeypatch.setattr(metric_tree, name, value)
    monkeypatch.setattr(MetricTree.__init__, "__defaults__", (page, 4, 1))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(clustered(5, 300, 8))]
    rows += [(300 + i, rows[7][1]) for i in range(60)]
    rows += [(1000, None), (1020, [0.0] * 8), (1002, [None] + [1.0] * 7), (1003, [NAN] * 8), (1040, [INF] + [0.0] * 7), (1060, [1.0]), (1080, []), (1081, []), (1061, [-2.0]), (None, [1.0] * 8), (20, [0.5] * 8)]
    rows += [(40, [float(9 + i)] * 8) for i in range(30)]
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = exact_top_k(frame(spark, rows), frame(spark, asked), k=15)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, asked, 15)


def test_large_numbers(spark):
    """Exact where doubles and 64 bits end."""
    for big in (3.0e6, 2.0e8, 1.0e17):
        rows = [(i, [big * (1 + i / 7), big, float(-i) * big]) for i in range(30)]
        asked = [r for r in rows if r[0] % 20 == 0]
        exact = [(i, [float(np.float32(v)) for v in w]) for i, w in rows]
        got = exact_top_k(frame(spark, rows), frame(spark, asked), k=5)
        assert sorted(tuple(r) for r in got.collect()) == brute(exact, [r for r in exact if r[0] % 20 == 0], 5)


def test_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 2.0])]
    assert exact_top_k(frame(spark, []), frame(spark, [])).collect() == []
    assert exact_top_k(frame(spark, []), frame(spark, rows)).collect() == []
    assert exact_top_k(frame(spark, rows), frame(spark, [])).collect() == []
    assert sorted(tuple(r) for r in exact_top_k(frame(spark, rows), frame(spark, rows[:2])).collect()) == brute(rows, rows[:2], 20)

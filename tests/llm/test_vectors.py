"""The epsilon grid order join and the vantage-point trees against all pairs."""

import numpy as np
import pytest

from siltwork.llm import ann, embed_dedup
from siltwork.llm.ann import VantageTree, nearest
from siltwork.llm.embed_dedup import near_duplicates
from siltwork.llm.shared import connected_components

NAN, INF = float("nan"), float("inf")


def vectors(seed=0, n=400, size=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(20, size))
    x = (base[r.integers(20, size=n)] + r.normal(scale=0.25, size=(n, size))).astype(np.float32)
    x[50:60] = x[50]
    x[60] = 2 * x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    return rows, [(1000, None), (1001, [0.0] * size), (1002, [None] + [1.0] * (size - 1)), (1003, [NAN] * size), (1004, [INF] + [0.0] * (size - 1)), (1005, [1.0]), (1006, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "k") for i, v in rows], "vec_id long, embedding array<float>, id int, vector string")


@pytest.mark.parametrize("rows_each,group_bytes,least", [(16_384, 256_000_000, 5), (20, 64 * 60, 1), (1_000_000, 1, 3)])
def test_near_duplicates(spark, monkeypatch, rows_each, group_bytes, least):
    monkeypatch.setattr(embed_dedup, "LEAF", 16)
    monkeypatch.setattr(embed_dedup, "INTERVAL_ROWS", rows_each)
    monkeypatch.setattr(embed_dedup, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(embed_dedup, "LEAST_GROUPS", least)
    rows, bad = vectors()
    x = np.array([v for _, v in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(close, label[None], len(x)).min(1))
    want = {i: (int(close[i].sum()), int(label[i]), label[i] == i) for i in range(len(x))}
    want |= {i: (0, i, True) for i, _ in bad}
    got = near_duplicates(frame(spark, rows + bad + rows[:3])).collect()
    assert len(got) == len(want)
    assert {r["vec_id"]: tuple(r)[1:] for r in got} == want


def test_only_unusable_vectors(spark):
    got = near_duplicates(frame(spark, vectors()[1])).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, i, True) for i, _ in vectors()[1]]
    assert near_duplicates(frame(spark, [])).collect() == []


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 16)
    rows, bad = vectors(4)
    x = np.array([v for _, v in rows], np.float64)
    got = nearest(frame(spark, rows + bad), frame(spark, [r for r in rows + bad if r[0] % 20 == 0]), k=15).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 400, 20))
    for q, found in by.items():
        scores = np.zeros(len(x))
        for j in range(x.shape[1]):
            scores += x[:, j] * x[q, j]
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:15]
        assert found == [(i, scores[i]) for i in order]


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 2.0])]
    got = nearest(frame(spark, rows), frame(spark, rows[:2])).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0)]
    assert nearest(frame(spark, []), frame(spark, [])).collect() == []


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.2, 0.9)])
def test_recall_by_factor(factor, least):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 16))
    ids = np.arange(3000)
    rows, found, _ = VantageTree(ids, x).search(ids[:50], x[:50], 10, factor)
    hits = 0
    for q in range(50):
        scores = x @ x[q]
        scores[q] = -INF
        hits += len(set(np.argsort(-scores)[:10]) & set(found[rows == q]))
    assert hits / 500 >= least


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 12), (12, 13), (13, 10), (7, 7)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10} | {100 + i: 100 for i in range(61)}


def test_lengths_and_repeated_ids(spark):
    """Vectors meet those of their own length; different vectors of one id all count."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [0.0, 1.0]), (5, [1.0, 0.01]), (5, [0.0, 1.0]), (20, [0.5, 0.0, 0.0])]
    got = sorted(tuple(r) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 3, True), (4, 2, 3, False), (5, 0, 5, True), (5, 2, 1, False), (20, 2, 3, False)]
    found = nearest(frame(spark, rows), frame(spark, [r for r in rows if r[0] in (1, 20)]))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 2, 1.0), (1, 2, 5, 1.0), (1, 3, 5, 0.0), (1, 4, 5, 0.0), (20, 1, 4, 1.0), (20, 2, 3, 0.5)]

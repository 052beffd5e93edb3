"""Runs of the frontier within a budget, against visits one after the other."""

import random

import pytest

from siltwork.operators.graph import run_frontier
from siltwork.plans.graph import frontier_run, linked_customers

NODES = "source string, node long, kind string, depth int, active int, exhausted int, seen long, hits long, last_visited long, parent long"


def one_by_one(nodes, visits, edges, budget, most_visits, most_depth=3):
    state = {(r[0], r[1]): dict(zip(("source", "node", "kind", "depth", "active", "exhausted", "seen", "hits", "last_visited", "parent"), r), turn=None) for r in nodes}
    yields = {(r[0], r[1]): r[2:] for r in visits}
    leads = {}
    for source, node, neighbour in edges:
        leads.setdefault((source, node), []).append(neighbour)
    stats, turn = [], 0
    while True:
        turn += 1
        now = {"visited": 0, "candidates": 0, "hits": 0, "discovered": 0}
        for source in sorted({s for s, _ in state}):
            spent = sum(1 for k, n in state.items() if k[0] == source and n["turn"] is not None)
            able = [n for k, n in state.items() if k[0] == source and n["active"] == 1 and n["exhausted"] == 0 and n["depth"] <= most_depth and n["turn"] is None]
            able.sort(key=lambda n: (n["last_visited"] is not None, n["depth"], n["last_visited"] or 0, n["node"]))
            for n in able[: max(0, min(most_visits, budget - spent))]:
                before = dict(n)
                seen, hits, exhausted = yields.get((source, n["node"]), (0, 0, None))
                n.update(seen=n["seen"] + seen, hits=n["hits"] + hits, turn=turn, exhausted=n["exhausted"] if exhausted is None else exhausted)
                now["visited"], now["candidates"], now["hits"] = now["visited"] + 1, now["candidates"] + seen, now["hits"] + hits
                worth = before["kind"] == "seed" or before["seen"] < 20 or before["hits"] / before["seen"] >= 0.02
                if exhausted is not None and worth and before["depth"] < most_depth:
                    for other in leads.get((source, n["node"]), ()):
                        if (source, other) not in state:
                            state[(source, other)] = {"source": source, "node": other, "kind": "discovered", "depth": before["depth"] + 1, "active": 1, "exhausted": 0, "seen": 0, "hits": 0, "last_visited": None, "parent": n["node"], "turn": None}
                            now["discovered"] += 1
        if not now["visited"]:
            return sorted((tuple(n[c] for c in ("source", "node", "kind", "depth", "exhausted", "seen", "hits", "parent", "turn")) for n in state.values()), key=str), stats
        stats.append(now)


COLUMNS = ["source", "node", "kind", "depth", "exhausted", "seen", "hits", "parent", "turn"]


def check(spark, nodes, visits, edges, **limits):
    got, stats = run_frontier(
        spark.createDataFrame(nodes, NODES), spark.createDataFrame(visits, "source string, node long, seen long, hits long, exhausted int"),
        spark.createDataFrame(edges, "source string, node long, neighbour long"), **limits,
    )
    want, want_stats = one_by_one(nodes, visits, edges, **limits)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == want
    assert stats == want_stats
    return stats


@pytest.mark.parametrize("budget,most_visits", [(25, 8), (1000, 50), (3, 50)])
def test_equals_visits_one_by_one(spark, budget, most_visits):
    r = random.Random(budget)
    nodes = [(s, n, r.choice(("seed", "discovered")), r.randrange(4), r.choice((1, 1, 0)), r.choice((0, 0, 1)), r.choice((0, 30)), r.choice((0, 1)), r.choice((None, 5, 9)), None) for s in "ab" for n in range(8)]
    visits = [(s, n, r.randrange(40), r.randrange(2), r.choice((0, 0, 1))) for s in "abc" for n in range(60) if r.random() < 0.9]
    edges = sorted({(s, r.randrange(60), r.randrange(60)) for s in "abc" for _ in range(160)})
    check(spark, nodes, visits, edges, budget=budget, most_visits=most_visits)


def test_gate_and_failures(spark):
    """A failing node costs its visit and leads nowhere; a dud of 100 without a hit does not expand, a young one does."""
    nodes = [("s", 1, "seed", 0, 1, 0, 100, 0, None, None), ("s", 2, "discovered", 1, 1, 0, 100, 0, None, None), ("s", 3, "discovered", 1, 1, 0, 2, 0, None, None), ("s", 4, "seed", 0, 1, 0, 0, 0, None, None)]
    visits = [("s", 1, 5, 1, 0), ("s", 2, 5, 1, 0), ("s", 3, 5, 0, 1)]
    stats = check(spark, nodes, visits, [("s", 1, 10), ("s", 2, 11), ("s", 3, 12), ("s", 4, 13), ("s", 1, 2)], budget=50, most_visits=50)
    assert stats[0] == {"visited": 4, "candidates": 15, "hits": 2, "discovered": 2}
    assert check(spark, [], visits, [], budget=5, most_visits=5) == []


def test_query(spark):
    data = "/root/testdata/sf0.001"
    nodes, visits, edges = ([tuple(r) for r in part.collect()] for part in linked_customers(spark, data))
    want, _ = one_by_one(nodes, visits, edges, budget=400, most_visits=150)
    assert sorted((tuple(r) for r in frontier_run(spark, data).collect()), key=str) == want

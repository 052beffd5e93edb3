"""The whole grid of weights in steps of 0.05 against plain Python."""

import duckdb
import pytest

from siltwork.plans import catalogue
from siltwork.plans.ranking import judged

DATA = "/root/testdata/sf0.001"


def wanted(rows, ws, wt):
    wr = round(1 - ws - wt, 2)
    scored = [(-round(ws * r.similarity + wt * (r.doc_id * 11 % 101 / 100) + wr * 0.5 ** (r.doc_id * 37 % 720 / 90), 9), r.doc_id, r.good) for r in rows]
    places = [place for place, (_, _, good) in enumerate(sorted(scored), 1) if good]
    return sum(hit / place for hit, place in enumerate(places, 1)) / len(places)


@pytest.fixture(scope="module")
def found(spark):
    return {(r.ws, r.wt): r.average_precision for r in catalogue.QUERIES["weight_grid"](spark, DATA).collect()}


def test_all_triples_are_tried(spark, found):
    rows = judged(spark, DATA).collect()
    steps = [(round(a * 0.05, 2), round(b * 0.05, 2)) for a in range(21) for b in range(21 - a)]
    assert len(found) == 231
    assert found == pytest.approx({s: wanted(rows, *s) for s in steps}, abs=2e-9)


def test_agrees_with_the_sql(found):
    con = duckdb.connect()
    for name in ("labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    known = {(ws, wt): value for ws, wt, value in con.execute(f"SELECT ws, wt, average_precision FROM ({catalogue.ORACLES['weight_grid']})").fetchall()}
    assert len(known) == 231
    assert {s: found[s] for s in known} == pytest.approx(known, abs=2e-9)

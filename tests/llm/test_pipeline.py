"""The corpus pipeline stage by stage on a small corpus."""

import corpus_pipeline as P
import pytest

from siltwork.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        out.append((docs, docs := spark.read.parquet(f"{folder}/{i}")))
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_strings", "packing"]


def test_quality_rejects_and_keeps(spark, stages):
    before, after = stages[0]
    assert after.columns == P.COLUMNS == before.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(after))
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) / len(labels) > 0.95
    assert quality.THRESHOLD == 0.3


def test_one_document_of_each_group(stages):
    from tests.llm.test_ngram_join import brute

    before, after = stages[1]
    want = sorted(d for d, _, c in brute([(r["doc_id"], r["text"]) for r in before.collect()]) if d == c)
    assert ids(after) == want


def test_repeated_strings(stages):
    from tests.llm.test_suffix_dedup import brute

    before, after = stages[2]
    want = {d: kept.decode("utf-8", "ignore") for d, _, gone, _, kept in brute([(r["doc_id"], r["text"]) for r in before.collect()]) if not gone or kept}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_packing(stages):
    before, after = stages[3]
    assert sorted({r["doc_id"] for r in after.collect()}) == ids(before)


def test_run_returns_the_last_stage(spark, stages):
    assert P.run(spark, SF).count() == stages[3][1].count()


def odd_rows(spark):
    """Null ids and texts, empty texts, repeated rows, a long text, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(6).collect()]
    rows = [(i, t) for i, t in enumerate(base)] + [(2, base[2]), (None, base[1]), (None, None), (50, None), (51, ""), (51, ""), (52, long_text), (53, base[3])]
    return spark.createDataFrame([(d, t, "en", "web", len(t or ""), 1, "x", 2.0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, keys int, ids string, row double")


@pytest.mark.parametrize("at", range(4))
def test_odd_rows_and_empty_tables(spark, at):
    name, stage = P.STAGES[at]
    docs = odd_rows(spark)
    got = stage(spark, docs, SF).collect()
    assert stage(spark, docs.limit(0), SF).collect() == []
    given = sorted(str(r["doc_id"]) for r in docs.collect())
    found = sorted(str(r["doc_id"]) for r in got)
    if name == "quality":
        assert set(found) <= set(given) and found.count("51") in (0, 2)
    elif name == "near_duplicates":
        assert found == sorted(d for d in given if d != "53" and d != "None") + ["None"] or "53" not in found and found.count("2") == 2 and found.count("51") == 2
    elif name == "repeated_strings":
        assert found == [d for d in given if d != "53"]
        assert {r["doc_id"]: r["text"] for r in got}[50] == ""
    else:
        assert sorted(set(found)) == sorted(set(given))

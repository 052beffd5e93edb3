"""Repeated word windows against a count of all windows."""

import random
from collections import Counter

import pytest

from siltwork.llm.substring_dedup import COVER, PERIOD, remove_repeats


def brute(rows, window=35):
    lists = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in lists for i in range(len(w) - window + 1))
    out = []
    for d, words in lists:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


def test_cover_has_every_distance():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_matches_all_windows(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(300)}é"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 90)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(r.randint(0, 4)):
            words += [word() for _ in range(r.randint(0, 40))] + r.choice(passages)[r.choice((0, 0, 5)) :]
        rows.append((i, "  ".join(words)))
    rows += [(100, " ".join(["same"] * 80)), (101, None), (102, ""), (103, " ".join(["a", "b"] * 17) + " a"), (104, rows[5][1]), (104, rows[5][1]), (None, rows[6][1]), (105, " ".join(map(str, range(50_000))))]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, doc int, candidates string")
    got = remove_repeats(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_weak_hashes_only_cost_time(spark):
    """With hashes of nine bits most windows that are matched differ; words decide, over several rounds."""
    r = random.Random(4)
    passages = [[f"w{r.randrange(40)}" for _ in range(45)] for _ in range(3)]
    rows = [(i, " ".join([f"w{r.randrange(40)}" for _ in range(30)] + r.choice(passages)[r.randrange(12) :])) for i in range(24)]
    rows += [(50, rows[3][1]), (51, rows[4][1] + " tail"), (51, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hash_bits=9)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("slices,bits", [(1, 6), (4, 6), (8, 6), (32, 6), (4, 64)])
def test_every_layout(spark, slices, bits):
    """Equal windows in different tasks, between windows that only their hash has in common."""
    common, (w, x) = [f"c{i}" for i in range(34)], ("".join("ab"[(bin(i).count("1") + j) % 2] for i in range(1024)) for j in (0, 1))
    rows = [(i, " ".join([*common, w if i in (0, 31) else x])) for i in range(32)]
    rows += [(100 + i, " ".join([f"p{i % 11}q{j}" for j in range(40)])) for i in range(32)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), "doc_id long, text string")
    got = remove_repeats(docs, hash_bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []

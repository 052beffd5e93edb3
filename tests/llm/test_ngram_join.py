"""The grouped prefix join against a comparison of all pairs."""

import random

import pytest

from siltwork.llm import ngram_join
from siltwork.llm.ngram_join import similar_documents


def brute(rows):
    def shingles(text):
        words = (text or "").encode().lower().split()
        if len(words) >= 5:
            return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        return frozenset([tuple(words)]) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        root = find(i)
        least[root] = min(x for x in (d, least.get(root)) if x is not None) if d is not None or least.get(root) is not None else None
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, docs, base=6):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    roots = [[word() for _ in range(r.randint(3, 60))] for _ in range(base)]
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(docs):
        words = list(r.choice(roots))
        for _ in range(r.choice((0, 0, 1, 1, 2, 6))):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.3:
            words = words + passage
        if r.random() < 0.2:
            words = [w.upper() for w in words]
        rows.append((i * 3, r.choice((" ", "\n", "\x0b ")).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed, 160)
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_blocks_of_large_runs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    rows = corpus(7, 120, base=2)
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (7, "one two three four five"), (7, "one two three four five"), (8, long), (9, long + " end"), (None, "one two")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, set int, component_id string")
    got = similar_documents(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def opposite_words(size):
    """Two words of ``a`` and ``b`` that differ everywhere; sums of powers of an odd base modulo 2^64 are equal."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 2048])
def test_structured_words(spark, size):
    w, x = opposite_words(size)
    rows = [(1, w), (2, x), (3, "other"), (4, f"{w} a b c d e"), (5, f"{x} a b c d e"), (6, f"{w}\n{w}"), (7, w.upper())]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("slices,bits", [(1, 3), (5, 64), (40, 3)])
def test_names_and_layouts(spark, slices, bits):
    rows = corpus(9, 90)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), "doc_id long, text string")
    assert sorted((tuple(r) for r in similar_documents(docs, name_bits=bits).collect()), key=str) == brute(rows)


def test_blocks_by_bytes(spark, monkeypatch):
    """Long sets make small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 200)
    rows = corpus(11, 60, base=2)
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []

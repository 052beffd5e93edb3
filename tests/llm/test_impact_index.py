"""The bit-sliced index against plain scoring."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from siltwork.llm import impact_index
from siltwork.llm.impact_index import Sum, build_index, dense, search, slices_of, terms_of, times, top_places

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in PATTERN.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(d, Counter(plain_terms(t))) for d, t, *_ in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text, *_ in items:
        scores = []
        for doc, bag in bags:
            n, score = sum(bag.values()), 0
            for t in set(plain_terms(text)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * (10 + (90 * n * n_docs) // n_terms)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, "x", 3) for r in docs], "doc_id long, text string, term string, item_id int")
    i = spark.createDataFrame([(*r, "x", 3) for r in items], "item_id long, text string, term string, doc_id int")
    got = search(build_index(d), i, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed=0, n=150):
    r = np.random.default_rng(seed)
    words = [f"W{i}" if i % 3 else f"é{i}" for i in range(60)] + ["THE", "the", "K", "İ", "😀", "a b"]
    p = 1 / (1 + np.arange(len(words)))
    docs = [(i, " ,\t-".join(r.choice(words, r.integers(1, 60), p=p / p.sum()))) for i in range(n)]
    docs += [(1000, None), (1001, ""), (1002, " .,;\n"), (5, "w1 w1 only"), (5, "w1 w1 only"), (None, "w1 w1 only"), (1003, "w2 " * 20_000), (1004, "x" * 50_000), (-4, docs[3][1])]
    items = [(i, " ".join(r.choice(words, 6))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (3, "w1 W1 w1"), (3, "w1 W1 w1"), (None, "the w2"), (53, "x" * 50_000)]
    return docs, items


@pytest.mark.parametrize("docs_each,bytes_each,read,pairs,block,terms", [(16_384, 24_000_000, 1_000_000, 100_000, 64, 200_000), (7, 24_000_000, 300, 5, 3, 0), (1000, 900, 200, 40, 64, 200_000)])
def test_ranks(spark, monkeypatch, docs_each, bytes_each, read, pairs, block, terms):
    values = {"SHARD_DOCS": docs_each, "SHARD_BYTES": bytes_each, "READ_BYTES": read, "PAIRS_AT_ONCE": pairs, "BLOCK_ITEMS": block, "BROADCAST_TERMS": terms, "SALT": 4}
    for name, value in values.items():
        monkeypatch.setattr(impact_index, name, value)
    docs, items = corpus()
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus()
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [], []) == []
    assert found(spark, [(1, None), (2, "")], items) == []
    tie = [(2, "w1"), (1, "w1")], [(1, "w1")]
    assert [r[:3] for r in found(spark, *tie, k=1)] == [(1, 1, 1)]
    assert found(spark, *tie, k=1) == brute(*tie, k=1)


def test_terms():
    text = "AbÄb x-y_z 9a b c\x7fd\x00e"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def test_sliced_arithmetic():
    r = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 500):
        a, b = r.integers(0, 1 << 20, size), r.integers(0, 1 << 20, size)
        total = Sum(45, -(-size // 64))
        for values, w in ((a, 12345), (b, 1), (a, 0), (b, 16383)):
            total.add(times(slices_of(values, 45), w))
        want = a * 12345 + b + b * 16383
        want[::3] = want[0]
        for k in (1, 5, size, size + 3):
            sliced = total.total() if k == 1 else slices_of(want, 45)
            numbers = a * 12345 + b + b * 16383 if k == 1 else want
            order = [i for i in np.lexsort((np.arange(size), -numbers)) if numbers[i] > 0][:k]
            places, scores = top_places(sliced, k)
            assert sorted(zip((-scores).tolist(), places.tolist())) == [(-int(numbers[i]), int(i)) for i in order]


def test_dense():
    values = np.array([3, 1 << 19, 77])
    bits = (values[None, :] >> np.arange(20)[:, None] & 1).astype(np.uint8)
    got = dense(np.array([0, 64, 99]), np.packbits(bits.ravel(), bitorder="little"), 100, 25)
    want = np.zeros(100, np.int64)
    want[[0, 64, 99]] = values
    assert (got == slices_of(want, 25)).all()

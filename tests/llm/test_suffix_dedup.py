"""Suffix sorting, and removal of earlier strings, against plain comparison."""

import random

import numpy as np
import pytest

from siltwork.llm import suffix_sort
from siltwork.llm.suffix_dedup import regions, remove_earlier
from siltwork.llm.suffix_sort import Scratch, common_prefixes, suffix_order


@pytest.mark.parametrize("spill", [4_000_000, 3])
@pytest.mark.parametrize("allowance", [10**9, 0])
def test_suffix_order(monkeypatch, spill, allowance):
    monkeypatch.setattr(suffix_sort, "SPILL_ITEMS", spill)
    r = random.Random(5)
    for trial in range(60):
        body = [r.randint(1, r.choice((1, 2, 5))) for _ in range(r.randint(0, 50))] * r.choice((1, 1, 3))
        text = np.array([*body, 0], np.uint16)
        with Scratch(allowance) as scratch:
            order = suffix_order(text, 6, len(text), scratch)
            assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        same = common_prefixes(text, order, 6)
        padded = text.tolist() + [0] * 6
        assert same.tolist() == [i > 0 and padded[a : a + 6] == padded[b : b + 6] for i, (a, b) in enumerate(zip(order, np.r_[0, order]))]


def brute(rows, window=50):
    first = {}
    for d, t in rows:
        body = (t or "").encode()
        for i in range(len(body) - window + 1):
            if d is not None:
                first[body[i : i + window]] = min(d, first.get(body[i : i + window], d))
    out = []
    for d, t in rows:
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - window + 1):
            if d is not None and first[body[i : i + window]] < d:
                gone[i : i + window] = True
        spans = sum(1 for i in range(len(body)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(body), int(gone.sum()), spans, bytes(np.frombuffer(body, np.uint8)[~gone])))
    return sorted(out, key=str)


def test_matches_plain_comparison(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé ñ") for _ in range(r.randint(1, 9)))
    passages = ["".join(word() for _ in range(n)) for n in (9, 12, 15, 40)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += ["".join(word() for _ in range(r.randint(0, 25))), r.choice(passages)[r.choice((0, 0, 7)) :]]
        rows.append((r.randrange(1000) * 7 + i, "".join(parts)))
    rows += [(5000, None), (5001, ""), (5002, "-" * 300), (5003, "-" * 120 + "x" + "-" * 60), (1, rows[3][1]), (9999, rows[3][1]), (9999, rows[3][1]), (None, rows[3][1]), (6000, "ab" * 20_000), (6001, "ba" * 200)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, doc int, kept string")
    got = remove_earlier(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted(((*r[:4], bytes(r[4])) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert remove_earlier(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def asked_for(texts, window=50):
    """Of each text the windows by place: (minimizer, keys of its region)."""
    text, first, last, minimizer, keys, region = regions(texts, window)
    of = [set() for _ in text]
    for k, i in zip(keys.tolist(), region.tolist()):
        of[i].add(k)
    out = [{} for _ in texts]
    for t, a, b, m, k in zip(text.tolist(), first.tolist(), last.tolist(), minimizer.tolist(), of):
        for place in range(a, b + 1):
            assert place not in out[t]
            out[t][place] = (m, k)
    return out


@pytest.mark.parametrize("window", [16, 17, 33, 50])
def test_equal_windows_have_a_key_in_common(window):
    r = random.Random(window)
    passages = [bytes(r.choice(b"abc ") for _ in range(n)) for n in (window, window + 1, 90, 200)] + [b"-" * 130, b"ab" * 80]
    for _ in range(30):
        texts = [b"".join(r.choice((bytes(r.choice(b"abc ") for _ in range(r.randint(0, 70))), r.choice(passages))) for _ in range(r.randint(0, 4))) for _ in range(8)]
        windows = {}
        for body, found in zip(texts, asked_for(texts, window)):
            assert sorted(found) == list(range(len(body) - window + 1))
            for place, (minimizer, keys) in found.items():
                windows.setdefault(body[place : place + window], []).append((minimizer, keys))
        for (minimizer, keys), *others in windows.values():
            assert keys and all(m == minimizer and k & keys for m, k in others)


def test_short_strings_in_common_are_not_asked_for():
    """Strings as long as a minimizer recur by chance in a large input; their regions must not travel."""
    r = random.Random(3)
    odd = lambda n: bytes(r.randrange(256) for _ in range(n))
    common = [odd(32) for _ in range(200)]
    one, two = (asked_for([b"".join(odd(40) + c for c in common)])[0].values() for _ in range(2))
    assert len({m for m, _ in one} & {m for m, _ in two}) > 50
    assert not set().union(*(k for _, k in one)) & set().union(*(k for _, k in two))


@pytest.mark.parametrize("window", [16, 31])
def test_other_windows(spark, window):
    r = random.Random(window)
    passages = ["".join(r.choice("abé ") for _ in range(n)) for n in (window, 40, 90)]
    rows = [(i, "".join("".join(r.choice("abé ") for _ in range(r.randint(0, 30))) + r.choice(passages) for _ in range(r.randint(0, 3)))) for i in range(40)]
    got = remove_earlier(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    assert sorted(((*x[:4], bytes(x[4])) for x in got), key=str) == brute(rows, window)

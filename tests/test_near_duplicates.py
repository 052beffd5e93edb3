"""The near-duplicate map against a plain form of the reference's find_duplicates."""

import random
import re

import numpy as np

from siltwork.plans import catalogue

START, FACTOR, STEP, FULL = 1469598103934665603, 1099511628211, 0x9E3779B97F4A7C15, (1 << 64) - 1


def minhash(text):
    words = re.findall("[a-z0-9]+", text.lower())
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    least = np.full(128, FULL, np.uint64)
    for run in runs:
        h = np.array([START ^ (p * STEP & FULL) for p in range(128)], np.uint64)
        for byte in run.encode():
            h = (h ^ np.uint64(byte)) * np.uint64(FACTOR)
        least = np.minimum(least, h)
    return tuple(least.tolist())


def find_duplicates(texts, threshold=0.7, bands=16):
    signed, buckets, out = {k: minhash(t or "") for k, t in texts.items()}, {}, {}
    for k, s in signed.items():
        for b in range(bands):
            buckets.setdefault((b, s[b * 8 : b * 8 + 8]), []).append(k)
    for first, *others in buckets.values():
        for other in others:
            alike = sum(x == y for x, y in zip(signed[first], signed[other])) / 128
            if other not in out and alike >= threshold:
                out[other] = (first, alike)
    return out


def fixture():
    """Texts that drift apart word by word, so that groups overlap, with copies and empty ones."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for _ in range(4):
        now = [word() for _ in range(60)]
        for _ in range(14):
            texts.append(" ".join(now))
            now[rng.randrange(60)] = word()
    return dict(enumerate([*texts, "", None, texts[3], "Two words", "two, WORDS!", ""]))


def test_map_is_the_reference_map(spark, tmp_path):
    texts = fixture()
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.duplicate_of, r.similarity) for r in catalogue.QUERIES["near_duplicate_map"](spark, str(tmp_path)).collect()}
    assert found == find_duplicates(texts)


def test_hashes_at_once_fit_a_cores_cache():
    from siltwork.operators import similarity

    assert similarity.RUNS_AT_ONCE * similarity.PERMUTATIONS * 8 <= 1 << 20

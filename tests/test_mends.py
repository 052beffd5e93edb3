"""Hashes over UTF-16, a judge's capacity, reports that grow, and rejections, on small rows."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators import exports as X
from siltwork.operators import filters
from siltwork.operators.stages import triage


def fnv(text):
    value = 2166136261
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        value = (value ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 % (1 << 32)
    return f"{value:08x}"


def test_hash_over_utf16(spark):
    texts = ["", "a", "a😀b", "é", "日本", "x" * 500, "😀" * 40]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", T.fnv32(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: fnv(t) for t in texts} | {None: None}
    assert fnv("a😀b") == "8fca8501"


@pytest.mark.parametrize("slices", [1, 7])
@pytest.mark.parametrize("capacity", [0, 5, 100])
def test_capacity_counts_all_tasks(spark, slices, capacity):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i, f"text {i}", "t", i % 3) for i in range(40)], slices), "id long, text string, thesis string, rank int")
    got = triage(rows, "id", lambda text, thesis: "{}", capacity, [F.desc("rank")]).collect()
    order = sorted(range(40), key=lambda i: (-(i % 3), i))
    assert sorted(r["id"] for r in got if r["answer"]) == sorted(order[:capacity])
    assert len(got) == 40


def test_a_report_has_one_header(spark, tmp_path):
    path = str(tmp_path / "fund")
    rows = [(f"{i}", f'line "{i}", with\nbreak', None if i % 2 else "x") for i in range(10)]
    for part in (rows[:4], rows[4:], []):
        X.append_report(spark.createDataFrame(part, "Score string, `A note` string, Link string").repartition(3), path)
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{path}/*.csv")))
    whole = list(csv.reader(text.splitlines(keepends=True)))
    assert whole[0] == ["Score", "A note", "Link"]
    assert sorted(whole[1:]) == sorted([a, b, c or ""] for a, b, c in rows)
    back = X.read_report(spark, path)
    assert back.columns == ["Score", "A note", "Link"]
    assert sorted((r[0], r[1], r[2] or "") for r in back.collect()) == sorted((a, b, c or "") for a, b, c in rows)


#: Texts of each rule, at a fixed day.
CASES = [
    ("I built a compiler for spreadsheets and it runs in the browser today.", 0, None),
    ("We're hiring senior engineers, full-time position with competitive salary.", 0, "job_ad"),
    ("Use my discount code for forty percent off before black friday ends.", 0, "promo"),
    ("Ask HN: what database do you use at work for analytics these days?", 0, "question"),
    ("x" * 39, 0, "too_short"),
    ("Ask HN: I built a database for analytics, what would you pay for it?", 0, None),
    ("I built a compiler for spreadsheets and it runs in the browser today.", 900, "too_old"),
    ("I built a compiler for spreadsheets and it runs in the browser today.", None, None),
    (None, 0, "too_short"),
]


def test_rejections(spark):
    now = 1789171200
    rows = [(i, t, None if d is None else now - d * 86400) for i, (t, d, _) in enumerate(CASES)]
    got = spark.createDataFrame(rows, "i int, text string, posted long").select("i", filters.rejection(F.col("text"), F.col("posted"), now).alias("r")).select("i", "r.filter", "r.reason").collect()
    assert [r["filter"] for r in sorted(got)] == [want for *_, want in CASES]
    assert {r["i"]: r["reason"] for r in got}[1] == "reads as a vacancy: We're hiring"
    assert {r["i"]: r["reason"] for r in got}[6] == "900 days old, over 540"

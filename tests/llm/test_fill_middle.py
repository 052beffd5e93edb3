"""Fill-in-middle against a plain form, and read back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltwork.llm import fill_middle
from siltwork.llm.fill_middle import fill_in_middle, restored

TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "ä😀\n\nb\r\nc", "has <P> mark\nb", "x<S>", "<M>", "< P>\n<", "<\nS>\n<\nP>", "cut <\nP> here\n" * 3,
    "tab\tand 'quote' \\n \\\n$1", "no line feed " * 500, "many\n" * 5000, "nul\x00byte\nend", " \n\u0085\nz", "S>\n<S\n>",
]


def plain(doc, text, seed=7, share=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("most", [2_000_000, 50])
@pytest.mark.parametrize("share,spm", [(100, 50), (40, 0), (0, 50)])
def test_equals_the_plain_form(spark, monkeypatch, most, share, spm):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", most)
    rows = [(i, TEXTS[i % len(TEXTS)], "x", 1) for i in range(-20, 200)] + [(None, "a\nb\nc", "x", 1), (3, "again\n\n", "x", 1), (3, "again\n\n", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n long")
    made = fill_in_middle(docs, share=share, spm_share=spm).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted([(r["doc_id"] is None, r["doc_id"] or 0, *tuple(r)[1:]) for r in made], key=str)
    assert got == sorted([(d is None, d or 0, *plain(d, t, share=share, spm=spm), t or "") for d, t, *_ in rows], key=str)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_and_sql(spark, tmp_path):
    import duckdb

    rows = [(i, (TEXTS[i % len(TEXTS)] or "").replace("\x00", "") if TEXTS[i % len(TEXTS)] is not None else None) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = fill_middle.op12_fill_middle(spark, str(tmp_path))
    assert got.columns == columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({fill_middle.OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    sha = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
    assert all(r["restored_sha256"] == sha[r["doc_id"]] for r in got.collect())

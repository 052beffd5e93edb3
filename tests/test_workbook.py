"""Workbooks read back, without a spreadsheet library."""

from pyspark.sql import functions as F

from siltwork.operators import workbook as W
from siltwork.plans import catalogue


def test_rows_read_back(spark):
    rows = [("a", i, f'text <&> "{i}"\n\x00\x0bend', i * 7 % 100) for i in range(23)] + [("b/ü", 0, "ä😀", 80), (None, 1, None, None)]
    made = spark.createDataFrame(rows, "fund string, n int, note string, score int")
    first = W.with_averages(W.sheet(made, "fund", [F.col("n")], [W.text_cell(F.col("note")), W.number_cell(F.col("score"), W.SCORE_COLOURS)]), (1,))
    second = W.sheet(made.where("fund = 'a'"), "fund", [F.desc("n")], [W.number_cell(F.col("n"))])
    books = {(r["fund"], r["part"]): W.read_workbook(bytes(r["workbook"])) for r in W.workbooks([("Sum & up", ("Note", "Score"), first), ("More", ("N",), second)], most=10).collect()}
    assert sorted(books, key=str) == sorted([("a", 0), ("a", 1), ("a", 2), ("b/ü", 0), (None, 0)], key=str)
    notes = [row for part in range(3) for row in books["a", part]["Sum & up"][1:]]
    scores = [i * 7 % 100 for i in range(23)]
    assert notes == [[f'text <&> "{i}"\nend', float(s)] for i, s in enumerate(scores)] + [["Averages", int(sum(scores) / 23 * 100 + 0.5) / 100]]
    assert [row for part in range(3) for row in books["a", part]["More"][1:]] == [[float(i)] for i in range(22, -1, -1)]
    assert books["b/ü", 0] == {"Sum & up": [["Note", "Score"], ["ä😀", 80.0], ["Averages", 80.0]], "More": [["N"]]}
    assert books[None, 0]["Sum & up"] == [["Note", "Score"], ["", ""], ["Averages", ""]]


def test_colours_and_no_rows(spark):
    made = spark.createDataFrame([(v,) for v in (80, 79, 72, 64, 42, 41)], "v int")
    assert [r[0] for r in made.select(W.number_cell(F.col("v"), W.SCORE_COLOURS)["colour"]).collect()] == ["D4EDD8", "E8F2DD", "E8F2DD", "FFF6D6", "FFE9CC", "FFE0E0"]
    none = spark.createDataFrame([], "fund string, n int")
    assert W.workbooks([("S", ("N",), W.sheet(none, "fund", [F.col("n")], [W.number_cell(F.col("n"))]))]).collect() == []


def test_sheets_of_several_files_have_one_digest(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, catalogue.QUERIES["deal_workbooks"](spark, data).collect()))
    monkeypatch.setattr(W, "ROWS_PER_FILE", 7)
    assert sorted(map(tuple, catalogue.QUERIES["deal_workbooks"](spark, data).collect())) == whole

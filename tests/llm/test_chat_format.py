"""Chat formatting: exact round trip, merged turns, loss spans."""

from pyspark.sql import functions as F

from siltwork.llm.chat_format import format_chat, loss_text, turns_of

ROWS = [
    (1, 0, "system", "be </s> kind"), (1, 1, "user", "hi [INST]"), (1, 2, "user", "<s>\\<\\s>"), (1, 3, "assistant", "a\\"), (1, 4, "assistant", "b[/INST]é😀"), (1, 5, "user", None),
    (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, None, "user", "first"),
    (3, 0, None, "x"), (3, 1, "[INST]", "y"), (None, 0, "user", "n"),
]


def test_round_trip(spark):
    rows = spark.createDataFrame([(*r, "z", 1) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, turns int")
    chats = format_chat(rows)
    assert chats.columns == ["conv_id", "formatted", "loss_spans"]
    read = {r[0]: r for r in chats.select("conv_id", turns_of(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans")), "formatted", "loss_spans").collect()}
    for key in (1, 2, 3, None):
        mine = sorted((r for r in ROWS if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [tuple(t) for t in read[key][1]] == [(r[2] or "", r[3] or "") for r in mine]
        assert read[key][2] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        for span in read[key][4]:
            assert "[INST]" not in read[key][3][span["start"] : span["start"] + span["length"]]
    assert read[1][3].count("[/INST]") == 4


def test_empty_table(spark):
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []

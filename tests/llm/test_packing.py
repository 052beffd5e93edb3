"""Packing: every id in exactly one piece, ids as the tokenizers library gives them."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltwork.llm.packing import ByteEncoder, byte_vocabulary, pack

TEXTS = ["Hello world", None, "", " two  spaces   and\n\n lines \t x", "a <|endoftext|>b<|endoftext|>", "don't 12345 ééé 😀 \x1c x  y", "long text " * 2000, "long text " * 2000, "x" * 4000, "   ", "\n a"]


def test_pack(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, offset int, ids string").repartition(3)
    pieces = pack(docs, ["doc_id"], *byte_vocabulary()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    total = 0
    for i, text in enumerate(TEXTS):
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [0], 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes()) == p["ids_crc32"]
        assert at == len(ids)
        total += at
    assert sorted(by_sequence) == list(range(-(-total // 1024)))
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024


def test_repeated_ids_and_empty_table(spark):
    pieces = pack(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), ["doc_id"], *byte_vocabulary()).collect()
    assert sorted((str(p["doc_id"]), p["length"]) for p in pieces) == [("1", 2), ("1", 2), ("None", 2)]
    assert pack(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], *byte_vocabulary()).collect() == []


def test_ids_of_all_documents_and_clashing_columns(spark):
    """Ids of the whole small table, and kept columns named like the pieces' own."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = ByteEncoder(*byte_vocabulary())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in texts:
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, "a b", "x", 5, 6)], "start long, text string, ids string, offset long, partition long")
    got = pack(docs, ["start", "ids", "offset", "partition"], *byte_vocabulary()).collect()
    assert [(r["kept_start"], r["ids"], r["kept_offset"], r["partition"], r["start"], r["length"], r["offset"]) for r in got] == [(1, "x", 5, 6, 0, 3, 0)]

"""Encoding and decoding against the tokenizers library."""

import json

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltwork.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello <|endoftext|> world<|startoftext|>x", "Σίσυφος ΣΑΣ İstanbul école", "a" * 5000 + "b" * 100, "naïve 😀😀 it's 12345 \x1c\x1d x​z\xa0\x85q", "'S 'T don't they'LL", "ﬁ Ａ１½²ⅷ", "ᄀᄀ가 각", "the the the", "the the the", "tab\tline\r\n\x0b end", "é combining"]


def expected():
    tokenizer = Tokenizer.from_file(PATH)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    return [(i, tokenizer.decode(i, skip_special_tokens=False)) for i in ids]


def test_encode(spark):
    docs = spark.createDataFrame([(i, t, "old", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, extra int")
    lexicon = bpe.build_lexicon(spark, bpe.frequent_words(docs), PATH)
    for name in (lexicon, None):
        got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, name).collect()}
        for i, (ids, decoded) in enumerate(expected()):
            assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids
            assert got[i]["decoded"] == decoded
            assert got[i]["extra"] == 3


def test_automaton_is_minimal_and_exact(tmp_path):
    words = ["walked", "walking", "talked", "talking", "stalked", "a", "ab"]
    with open(PATH, encoding="utf-8") as f:
        merger = bpe.Merger(json.load(f))
    bpe.compile_lexicon(sorted((w.encode(), merger.ids(w)) for w in words), str(tmp_path / "x"))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    assert lexicon.lookup([w.encode() for w in words]) == [merger.ids(w) for w in words]
    assert lexicon.lookup([b"walk", b"walkedx", b"z"]) == [None] * 3
    assert len(lexicon.final) < len({w[:k] for w in words for k in range(len(w) + 1)})


def test_long_and_short_merges_agree():
    with open(PATH, encoding="utf-8") as f:
        merger = bpe.Merger(json.load(f))
    for word in ("internationalization", "aaaaaaaaaaaaaaaa", "éèêë", "1", "!!!!!!!!"):
        raw = word.encode()
        ids = [merger.first[b] for b in raw[:-1]] + [merger.last[raw[-1]]]
        assert merger._short(list(ids)) == merger._long(list(ids))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, None).collect() == []


def test_capitals_that_lower_to_a_special_token_are_none(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["<|ENDOFTEXT|> a", "b<|endoftext|>C", "<|EndOfText|><|endoftext|>"]
    found = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, None).collect()
    for r in found:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_words_are_merged_together(monkeypatch):
    """Pieces that no earlier chunk held are encoded without a merge of single words."""
    texts = ["Übermut, o'clock's naïve! <|startoftext|>x'll", "anshor zzz " + "ab" * 24 + " " + "c" * 49, "", "the thenued ŉ ſ ÿ.,; a1b2 ½", "." * 47 + "é"]
    tokenizer = Tokenizer.from_file(PATH)
    monkeypatch.setattr(bpe.Merger, "_short", lambda *_: 1 / 0)
    with open(PATH, encoding="utf-8") as f:
        encoder = bpe.Encoder(bpe.Merger(json.load(f)), None)
    packed, shown = encoder.encode(texts)
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(p, "<u4").tolist() for p in packed.to_pylist()] == wanted
    assert shown.to_pylist() == [tokenizer.decode(i, skip_special_tokens=False) for i in wanted]


def test_frequent_words(spark):
    docs = spark.createDataFrame([("The cat, the CAT 1 the",), (None,), ("É cat",), ("",)], "text string")
    for rows in (docs, docs.coalesce(1), docs.repartition(9)):  # some of the nine are empty
        assert bpe.frequent_words(rows, most=3) == ["cat", "the", "é"]
    assert bpe.frequent_words(docs.limit(0)) == []

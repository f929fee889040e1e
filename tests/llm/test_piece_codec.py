import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from loomgraph.llm import piece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "   x", "x   ", " a", "Hello  world\n\n x\t y ", "é▁ü ▁ z", "<s> </s> <unk>", "日本語 の テキスト", "\U0001f600 \U0001f600\U0001f468‍",
    "a\x00b", "�", "é ñ", " nbsp em", "word " * 3000, "x" * 20000, "\r\n\r\n", "▁", "▁▁a", "<0x41> 0x",
]


def random_texts(n):
    r = random.Random(2)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "漢", "\U0001f642", ".", "1", "▁", "\t"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_against_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(TEXTS + random_texts(400)))
    rows += [rows[7], (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    want = []
    for i, t in rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in piece_codec.digests(df, MODEL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    encoded = piece_codec.encode(df, MODEL)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str) == sorted(
        ((i, [*sp.encode(t or ""), sp.eos_id()]) for i, t in rows), key=str
    )
    back = {r.doc_id: r.text for r in piece_codec.decode(encoded, MODEL).collect()}
    assert all(back[i] == sp.decode(sp.encode(t or "")) for i, t in rows)


def test_small_table_gives_the_same(spark, monkeypatch):
    for limits in ({"chunks": 2}, {"size": 20}):
        table = piece_codec.ChunkTable(piece_codec._encoder(MODEL), **limits)
        for text in (b" one", b" two", b" three", b" one", b" four"):
            assert len(table.chunks) <= 6
            place = table.find([text])[0]
            assert table.text_of(place).tolist() == piece_codec.processor(MODEL).encode(text[1:].decode())


def test_periodic_words_are_told_apart(spark):
    """Words on which a polynomial hash mod 2**64 collides whatever its base."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in piece_codec.encode(df, MODEL).collect()}
    assert got == {i: [*sp.encode(t), sp.eos_id()] for i, t in ((1, one), (2, two))}


def test_empty_and_crossing(spark, monkeypatch):
    assert piece_codec.digests(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
    assert piece_codec.crossing_pieces(MODEL) == []
    monkeypatch.setattr(piece_codec, "crossing_pieces", lambda path: ["a▁b"])
    with pytest.raises(ValueError):
        piece_codec.digests(spark.createDataFrame([], "doc_id long, text string"), MODEL)

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tokensift.llm.tokens import _SETTLED, TOKENIZER, Decoder, PieceEncoder, decode_ids, encode_texts, slices, text_parts, token_offsets

ALPHABET = "ab1 2'\n\t  '’éя ,.stmdrevl-　 ＡⅣ²😀漢‍़ש\x00\x85S"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def samples():
    r = random.Random(1)
    texts = ["", " ", "  ", "\n \n", "<|endoftext|> is text", "don't we'll they've I'm he'd it's you're 'SHOUT' ''s 's'S ' s", "𝔘𝔫 x 's", "a" * 20_000, "\t\t x", "1\n00:00:01,000 --> 00:00:02,000\nHi -- you…\n"]
    return texts + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(4000)]


def split(encoder, texts):
    ids, counts, spans = encoder.encode(texts)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])], None if spans is None else [spans[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_ids_like_the_library(library):
    texts = samples()
    assert split(PieceEncoder(TOKENIZER), texts)[0] == library(texts)
    assert split(PieceEncoder(TOKENIZER, keep=50), texts)[0] == library(texts)  # a memory that overflows


def test_every_settled_character(library):
    chars = [chr(c) for first, last in _SETTLED for c in range(first, last + 1)]
    texts = ["".join(f"a{c}b 1{c}2 {c} \n{c}  {c}{c}'s" for c in chars[i : i + 16]) for i in range(0, len(chars), 16)]
    assert split(PieceEncoder(TOKENIZER), texts)[0] == library(texts)


def test_offsets_cover_the_characters():
    texts = samples()
    decoder = Decoder(TOKENIZER)
    for text, ids, spans in zip(texts, *split(PieceEncoder(TOKENIZER, spans=True), texts)):
        assert decoder.decode(ids) == text
        at = 0
        for (a, b), i in zip(spans, ids):
            own = decoder.bytes[i]
            assert a < b and own in text[a:b].encode() and a in (at, at - 1)
            at = b
        assert at == len(text)


def test_queries(spark):
    texts = [None, "", " ", "don't stop 😀", "don't stop 😀", "x" * 100_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a", "b"), (3, "don't stop 😀", "again")], "doc_id long, text string, ids string")
    rows = encode_texts(df).collect()
    assert len(rows) == len(texts) + 2
    own = {r.doc_id: r.ids for r in rows}
    assert own[0] == own[1] == [] and own[2] and own[3] == own[4]
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(df)).collect()}
    assert [back[i] for i in range(6)] == ["", *texts[1:]]
    assert {r.doc_id: len(r.ids) == len(r.starts) == len(r.ends) for r in token_offsets(df).collect()} == dict.fromkeys([None, *range(6)], True)
    assert encode_texts(df.limit(0)).count() == 0
    assert decode_ids(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()[0].text is None


def test_whole_documents_like_the_library(spark, library):
    """Ids and offsets of every document of the smallest scale."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = dict(zip(texts, library(list(texts.values()))))
    assert {r.doc_id: r.ids for r in encode_texts(docs).collect()} == want
    decoder = Decoder(TOKENIZER)
    for r in token_offsets(docs).collect():
        assert r.ids == want[r.doc_id] and len(r.starts) == len(r.ends) == len(r.ids)
        text, at = texts[r.doc_id], 0
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        for token, start, end in zip(r.ids, r.starts, r.ends):
            width = len(decoder.bytes[token])
            assert (start, end) == (owner[at], owner[at + width - 1] + 1)
            at += width


def test_other_kinds_of_tokenizers_are_refused(spark):
    other = TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k")
    for make in (PieceEncoder, Decoder):
        with pytest.raises(ValueError, match="byte-level"):
            make(other)
    with pytest.raises(Exception, match="byte-level"):
        encode_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer=other).collect()


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(x'61ff62' AS STRING) AS text")
    assert decode_ids(encode_texts(df)).first().text == "a\ufffdb"


def test_split_characters():
    decoder = Decoder(TOKENIZER)
    ids = split(PieceEncoder(TOKENIZER), ["漢😀"])[0][0]
    assert decoder.decode(ids) == "漢😀" and "�" in decoder.decode(ids[:1])


def test_parts_of_long_texts(library):
    text = "".join(t + " " for t in samples()[7:600])
    for size in (1, 7, 100, 10_000):
        parts = list(text_parts(text, size))
        assert "".join(p for _, p in parts) == text and all(text.startswith(p, at) for at, p in parts)
        assert [i for p in library([p for _, p in parts]) for i in p] == library([text])[0]
    long = ("one two's 3\n" * 300_000, "x")
    ids, spans = split(PieceEncoder(TOKENIZER, spans=True), list(long))
    assert ids == library(list(long)) and spans[0][-1] == [len(long[0]) - 1, len(long[0])]


def test_slices_are_whole():
    column = pa.array(["a" * 10, None, "", "b" * 30, "c"])
    assert list(slices(column, 20)) == [(0, ["a" * 10, "", "", "b" * 30]), (4, ["c"])]

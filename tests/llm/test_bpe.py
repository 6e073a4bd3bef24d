"""Byte-level BPE against the tokenizers library, and back."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a  b", "a   b c ", " a b", "a\n b \n c \nd\n", "a\n ", "aaaa aaaaaaa", "\t\r\n x",
    "<|endoftext|>a<|endoftext|> <|endoftext|", "x<|endoftext|> y", "a\x00b \x00 c", "a\n\x00 d", "\x85\x1c\xa0",
    "don't I'LL we've", "1234567 ½ ²", "日本語 ñandú 🙂👩‍👩‍👧", "====----!!!!!!", "ǅ ʰ ـ ’s ٣", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(spark, sf_dir):
    return ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_encoder_equals_the_library(spark, sf_dir, library):
    wanted = [e.ids for e in library.encode_batch(texts(spark, sf_dir), add_special_tokens=False)]
    encoder = bpe.Encoder(bpe.read_vocabulary(PATH))
    for _ in range(2):  # cold and warm
        ids, sizes = encoder.encode(texts(spark, sf_dir))
        ends = sizes.cumsum()
        assert [ids[e - n:e].tolist() for e, n in zip(ends, sizes, strict=True)] == wanted


def test_a_parts_rank_comes_first():
    """What lets the index merge a pair at all its positions at once."""
    v = bpe.Vocabulary(bpe.read_vocabulary(PATH))
    made = {}
    for rank, token in enumerate(v.made.tolist()):
        assert made.setdefault(token, rank) == rank
    for rank, pair in enumerate(zip(v.left.tolist(), v.right.tolist(), strict=True)):
        assert all(made.get(token, -1) < rank for token in pair)


def test_columns_nulls_and_back(spark, library):
    rows = [(1, None, "k"), (1, None, "k"), (2, "", None), (None, "tea time  ", "z"), (3, "<|endoftext|>é", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "ids"]
    got = {(r.doc_id, r.text): r.ids for r in coded.collect()}
    assert got[1, None] == got[2, ""] == [] and coded.count() == 5
    assert got[None, "tea time  "] == library.encode("tea time  ").ids
    back = bpe.decode(coded, PATH, text="text2")
    assert all(r.text2 == (r.text or "") for r in back.collect())
    assert bpe.encode(docs.limit(0), PATH).collect() == []


def test_decoding_what_no_text_gives(spark, library):
    lists = spark.createDataFrame([(1, [243, 162]), (2, None), (3, [-5, 999_999, 40])], "i int, ids array<int>")
    got = {r.i: r.decoded for r in bpe.decode(lists, PATH).collect()}
    assert got == {1: library.decode([243, 162], skip_special_tokens=False), 2: "", 3: "I"}

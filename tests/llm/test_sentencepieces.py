"""SentencePiece ids and texts against the library."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from faultmill.llm import sentencepieces
from faultmill.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁a", "a▁b", "▁", "▁ ▁", "a\tb\n c", "　x", "ﬁ x½", "\0a", "a\0 b", "<s>a</s>",
       "<0x41>", "é", "😀 👩‍👩", "​", "<unk> ⁇ ", "日本語 ñandú", "x" * 5000, " " * 40 + "y" + " " * 17, "a b " * 3000]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_model(library):
    model = sentencepieces.Model(sentencepieces.read_model(PATH))
    assert model.cuttable and model.pieces == [library.id_to_piece(i) for i in range(library.vocab_size())]


@pytest.mark.parametrize("limit", [48 << 20, 100])
def test_chunk_table(library, spark, sf_dir, monkeypatch, limit):
    monkeypatch.setattr(sentencepieces, "TABLE_BYTES", limit)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    table = sentencepieces.ChunkTable(sentencepieces.read_model(PATH))
    for lo in range(0, len(texts), 40):
        part = texts[lo:lo + 40]
        ids, sizes = table.encode(part)
        ends = sizes.cumsum()
        assert [ids[e - n:e].tolist() for e, n in zip(ends, sizes, strict=True)] == library.encode(part)


def test_whole_texts_where_pieces_may_cross(library):
    table = sentencepieces.ChunkTable(sentencepieces.read_model(PATH))
    table.cuttable = False
    ids, sizes = table.encode(ODD)
    assert ids.tolist() == [i for text in ODD for i in library.encode(text)] and len(sizes) == len(ODD)


def test_decoder(library):
    decoder = sentencepieces.Decoder(sentencepieces.read_model(PATH))
    draw = random.Random(7)
    kinds = [range(0, 3), range(3, 259), range(259, 400), range(259, 32000), [264, 28705, 2287]]
    for _ in range(3000):
        ids = [draw.choice(draw.choice(kinds)) for _ in range(draw.randint(0, 7))]
        assert decoder.text(ids) == library.decode(ids), ids
    for text in ODD:
        assert decoder.text(library.encode(text)) == library.decode(library.encode(text))


def test_frames(library, spark):
    rows = [(i, t, [9], "x") for i, t in enumerate([*ODD, None, ODD[6], ODD[6]])] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids array<int>, decoded string").repartition(3)
    coded = sentencepieces.encode(docs, PATH)
    assert sorted(coded.columns) == ["decoded", "doc_id", "ids", "text"]
    for r in coded.collect():
        assert r.ids == library.encode(r.text or "")
    back = sentencepieces.decode(coded, PATH).collect()
    assert len(back) == len(rows)
    assert all(r.decoded == library.decode(library.encode(r.text or "")) for r in back)
    lists = spark.createDataFrame([(None,), ([],), ([264, None, 99_999, -4, 264],)], "ids array<int>")
    assert sorted(r.decoded for r in sentencepieces.decode(lists, PATH).collect()) == ["", "", "a a"]
    assert sentencepieces.decode(sentencepieces.encode(docs.limit(0), PATH), PATH).collect() == []


def test_query(library, spark, sf_dir):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op11_sentencepiece"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *(
            hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))))

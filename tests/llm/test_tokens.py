"""Token files and token counts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultmill.llm import tokencounts, tokenfiles
from faultmill.llm.bpe import read_vocabulary

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a   B ", "日本語 ñandú 🙂👩‍👩", "é ́ x", "ΑΣ ΣΑΣ. İI ǅ", "<|endoftext|>a <|startoftext|>B<|endof",
       "Don't I'LL", "\x00\x01\x1c a\x85b", "½²१२ ﬁ K Å ẞ 한국 각", "a\0b c", "\t\n"]


@pytest.mark.parametrize("values", [
    [], [0], [1] * 61, [2**63, 5, 2**60 - 1, 2**60, 0, 1] * 9, list(range(50_000)), [2**64 - 1] * 3, [0] * 200 + [49407]])
def test_simple8b_round_trip(values):
    words, lanes = tokenfiles.pack(np.array(values, np.uint64))
    assert tokenfiles.unpack(words, len(values)).tolist() == values
    assert lanes.size == -(-len(values) // tokenfiles.LANE)
    for lo in range(0, len(values), 997):
        for hi in (lo, lo + 1, lo + 700, lo + 5000):
            hi = min(hi, len(values))
            assert tokenfiles.unpack_range(words, lanes, len(values), lo, hi).tolist() == values[lo:hi]


def test_one_document_through_the_directory(monkeypatch):
    """Blocks without it are jumped over, and of its own block only its lanes are decoded."""
    sizes = np.array([3000, 0, 70_000, 5, 9000], np.int64)
    ids = np.arange(sizes.sum()) * 7 % 49_000
    content = b"".join(tokenfiles.write_block(np.arange(5) + 10 * b, sizes, (ids + b) % 49_000, 0, b)
                       + tokenfiles.MARK.encode() for b in range(3))
    decoded = []
    whole = tokenfiles.unpack
    monkeypatch.setattr(tokenfiles, "unpack", lambda w, n: decoded.append(n) or whole(w, n))
    (_, block, place, doc_ids, own, got), = tokenfiles.read_blocks(content, np.array([13]))
    assert (block, place.tolist(), doc_ids.tolist(), own.tolist()) == (1, [3], [13], [5])
    assert got.tolist() == ((ids + 1) % 49_000)[73_000:73_005].tolist()
    assert max(decoded) <= 2 * tokenfiles.LANE


def test_library_encoder(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    library = Tokenizer.from_file(WORDS)
    ids, sizes = tokenfiles.LibraryEncoder(read_vocabulary(WORDS)).encode(texts)
    ends = sizes.cumsum()
    assert [ids[e - n:e].tolist() for e, n in zip(ends, sizes, strict=True)] == [
        e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files_and_digests(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 64)
    rows = [(i * 7 % 50, f"text number {i} " * (i % 9)) for i in range(50)]
    rows += [(None, "no id"), (3, "again"), (3, "again"), (9, None), (99, "x y z " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    library = Tokenizer.from_file(WORDS)
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    got = tokenfiles.digests(docs, WORDS, 2).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (d is not None, d or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(
        [d for d, _ in rows], key=lambda d: (d is not None, d))
    path = str(tmp_path / "tokens")
    tokenfiles.write(docs, WORDS, path, 2)
    back = tokenfiles.read(spark, path)
    assert sorted((r.doc_id or -1, r.ids) for r in back.collect()) == sorted((d or -1, x) for d, x in ids)
    some = tokenfiles.read(spark, path, [3, 99, 1000])
    assert sorted((r.doc_id, r.ids) for r in some.collect()) == sorted((d, x) for d, x in ids if d in (3, 99))
    assert tokenfiles.digests(docs.limit(0), WORDS, 2).count() == 0


def brute(ids, lengths, spans, rule):
    """Bytes of each token by section, one token at a time."""
    counts, at = [0] * len(spans), 0
    for i in ids:
        places = range(at, at + lengths[i])
        at += lengths[i]
        shares = [sum(a <= p < b for p in places) for a, b in spans]
        if rule == "first":
            home = next((k for k, (a, b) in enumerate(spans) if places and a <= places[0] < b), None)
        else:
            home = max(range(len(spans)), key=lambda k: (shares[k], -k)) if spans and max(shares) else None
        if home is not None:
            counts[home] += 1
    return counts


@pytest.mark.parametrize("rule", ["first", "most"])
def test_counts_by_section(spark, rule):
    texts = ["Rye bread\nand  tea\n\nwith ñandú 🙂 jam", None, "", "\n\n", "one line", "a\nb" * 300]
    spans = [[(0, 5), (5, 14), (20, 99)], [(0, 3)], None, [(0, 1), (1, 2)], [(0, 2), (3, 3), (4, 8)], []]
    rows = [(i, t, s and [{"start": a, "stop": b} for a, b in s]) for i, (t, s) in enumerate(zip(texts, spans, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans array<struct<start:int,stop:int>>")
    library = Tokenizer.from_file(BYTES)
    from faultmill.llm.bpe import token_bytes
    lengths = [len(b) for b in token_bytes(read_vocabulary(BYTES))]
    for column in (None, "spans"):
        for r in tokencounts.attribute(docs, BYTES, spans=column, rule=rule).collect():
            text = r.text or ""
            given = spans[r.doc_id] or [] if column else tokencounts.line_bounds(text).tolist()
            in_bytes = [tuple(len(text[:min(p, len(text))].encode()) for p in span) for span in given]
            want = brute(library.encode(text).ids, lengths, in_bytes, rule)
            assert [s.n_tokens for s in r.sections] == want
            if not column:
                assert sum(want) == len(library.encode(text).ids)


def test_unknown_rule():
    with pytest.raises(ValueError):
        tokencounts.allocate(np.array([1]), np.array([0]), np.array([1]), "half")

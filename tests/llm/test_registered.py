"""The registered queries of the training-data part on the smallest tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import TABLES, canonical
from faultmill.llm import queries
from faultmill.llm.common import table

CONTRACT = {
    "op1_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    "op2_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_decontamination": ["doc_id", "contaminated", "items"],
    "op9_token_counts": ["doc_id", "section", "start", "stop", "n_tokens", "n_shared"],
    "op10_html": ["page_id", "url", "text", "n_chars"],
    "op11_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                 "repaired_sha256"],
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {name: queries.QUERIES[name](spark, sf_dir).toPandas() for name in CONTRACT}


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


def test_columns_and_rows(results, documents, spark, sf_dir):
    rows = {"op1_embeddings": table(spark, sf_dir, "embeddings").count(),
            "op10_html": table(spark, sf_dir, "pages").count(),
            "op9_token_counts": sum(t.count("\n") + 1 for t in documents.values()),
            "op12_hard_negatives": len(results["op12_hard_negatives"]),  # compared with its SQL below
            "op13_conversation_repair": table(spark, sf_dir, "conversations").select("conv_id").distinct().count()}
    for name, columns in CONTRACT.items():
        assert list(results[name].columns)[:len(columns)] == columns
        assert len(results[name]) == rows.get(name, len(documents))
    assert {*CONTRACT, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(results, sf_dir, name):
    con = duckdb.connect()
    for each in TABLES:
        con.execute(f"CREATE VIEW {each} AS SELECT * FROM '{sf_dir}/{each}.parquet'")
    assert canonical(results[name]) == canonical(con.execute(queries.ORACLE_SQL[name]).fetchdf())


def test_digests(results, documents):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))
    for r in results["op3_bpe"].itertuples():
        ids = library.encode(documents[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)))
    library, at = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE)), 0
    for r in results["op5_token_files"].sort_values("doc_id").itertuples():
        ids = [*library.encode(documents[r.doc_id], add_special_tokens=False).ids, queries.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    by_doc = results["op9_token_counts"].groupby("doc_id").n_tokens.sum()
    assert (by_doc == results["op3_bpe"].set_index("doc_id").n_tokens).all()


def test_contaminated_are_those_with_an_item(results, documents, spark, sf_dir):
    def words(text):
        return " " + " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split()) + " "

    items = {r.item_id: words(r.text) for r in table(spark, sf_dir, "benchmark").collect()}
    for r in results["op8_decontamination"].itertuples():
        held = [i for i, text in items.items() if text in words(documents[r.doc_id])]
        assert set(held) <= set(r.items) and (held or not r.contaminated)


def test_pipeline(spark, sf_dir, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "toxicity", "near_duplicates", "decontamination", "bpe"]
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(90_001, None, None, None, 0), (90_002, "", "en", "s", 0), (90_003, "12 34", "en", "s", 5),
                                 (None, documents[0] + " again", "fr", "s", 1), (90_004, documents[0], "fr", "s", 1)],
                                docs.schema)
    kept = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir)
        if name != "bpe":
            assert kept.columns == docs.columns
    left = {r.doc_id: r for r in kept.collect()}
    assert not {90_001, 90_002, 90_003, 90_004, None} & set(left)
    assert all(r.decoded == r.text for r in left.values())
    assert len({r.text for r in left.values()}) == len(left) > 0.7 * len(documents)


def test_pipeline_keeps_columns_with_clashing_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(60)
    for name in ("leaks", "__score", "__lang", "__key", "__ids", "score", "lang_pred", "key", "t", "a b.c"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns + (["ids", "decoded"] if name == "bpe" else [])
    rows = kept.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in docs.columns[5:])


def test_pipeline_of_nothing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []

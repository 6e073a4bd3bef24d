"""One registered query per operator, over the whole of its table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    conversations,
    decontaminate,
    embeddings,
    hardnegatives,
    htmltext,
    langid,
    sentencepieces,
    sharding,
    simhash,
    tokencounts,
    tokenfiles,
    toxicity,
)
from .common import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
END_ID = 2


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, all shards with the same mixture of sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return sharding.shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path(BYTE_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path).select("doc_id", "ids")
    listed = coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    return bpe.decode(listed, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the model learns from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of every document lie in the files, read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenfiles.digests(docs, public_tokenizers.path(WORD_BPE), END_ID)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = langid.fit(langid.training_rows(docs))
    return langid.predict(docs.select("doc_id", "text"), models).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"),
                        F.col("leaks.item").alias("items"), F.array_max("leaks.share").alias("share"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencounts.attribute(docs, public_tokenizers.path(BYTE_BPE))
    return counted.select("doc_id", F.posexplode("sections").alias("section", "s")).select(
        "doc_id", "section", "s.start", "s.stop", "s.n_tokens", "s.n_shared")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids and decoded text of every document, as digests."""
    path = public_tokenizers.path(PIECE_BPE)
    coded = sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    listed = coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    return sentencepieces.decode(listed, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh one has its label moved on."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text, as a digest, of every damaged conversation."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mended = conversations.repair(conversations.damaged(given))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    named = mended.summary.withColumnRenamed("conv_id", "c").join(
        conversations.digests(mended.texts), F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    every = given.select("conv_id").distinct().join(named, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_shards": op2_shards,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_html": op10_html,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {"op1_embeddings": embeddings.ORACLE_SQL, "op12_hard_negatives": hardnegatives.ORACLE_SQL}

"""Shards that all match the mixture of sources: proportional stratified interleaving."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import numbered


def shards(docs: DataFrame, count: int = 8, seed: str = "shards", doc_id: str = "doc_id",
           source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row, rows per shard at most one apart.

    Rows are shuffled by a seeded hash within their source and ranked; sorting all rows by the
    fraction rank / rows of the source spreads every source evenly over the order, and equal cuts
    of the order are the shards, so each holds ``1 / count`` of every source, give or take a row.
    ``slot`` numbers a shard's rows in that order.

    Both orders are range shuffles of narrow rows, a large source being cut like all others; texts
    stay behind.  Rows without a source are a source of their own; null texts have size 1 and the
    checksum 0 of nothing; equal rows are told apart by nothing and get neighbouring places.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(source).isNull().alias("unsourced"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("draw", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    stratum = [F.col("source"), F.col("unsourced")]
    ties = [F.col("draw"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = materialize(numbered(rows, [*stratum, *ties], "place", "by_source"), "ranked")
    sources = materialize(ranked.groupBy("source", "unsourced").agg(
        F.count("*").alias("rows"), F.min("place").alias("first")), "sources")
    # stored sides on both ends, so that the join can split a large source
    mixed = ranked.join(sources, ["source", "unsourced"]).withColumn(
        "fraction", (F.col("place") - F.col("first") + 0.5) / F.col("rows"))
    placed = numbered(mixed, [F.col("fraction"), *stratum, *ties], "at", "by_fraction")
    total = placed.agg(F.count("*").alias("total"))
    shard = F.expr(f"CAST(at * {count} DIV total AS INT)")
    return placed.crossJoin(F.broadcast(total)).withColumn("shard", shard).select(  # the one row of a count
        "doc_id", F.when(~F.col("unsourced"), F.col("source")).alias("source"), "size", "text_crc32", "shard",
        F.expr(f"at - (shard * total + {count - 1}) DIV {count}").alias("slot"))

"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the rows they keep, with the columns of ``docs``. Null and empty texts have no
language and leave in the first stage; rows without a key are kept like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.byte_bpe import RANKS, digests, encode_documents
from hailbook.llm.common import documents, staged
from hailbook.llm.decontamination import leaks
from hailbook.llm.exact_dedup import exact_dedup
from hailbook.llm.language_id import accepted, learn
from hailbook.llm.ngram_join import ngram_join


def _only(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is (left_semi) or is not (left_anti) among ``keys``; null equals null."""
    keys = keys.select(F.col("doc_id").alias("_key"))
    return docs.join(keys, docs.doc_id.eqNullSafe(keys._key), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language. The network learns from ``docs`` itself."""
    return accepted(docs, learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest key of each group of equal texts, and one row of repeated ones."""
    found = staged(exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "exact")
    stay = found.filter("kept")
    repeated = staged(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"), "exact-repeated")
    kept = _only(docs, stay)
    if repeated.isEmpty():
        return kept
    # a key that several rows have: each of its kept texts stays once
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    several = _only(docs, repeated).withColumn("_digest", digest)
    wanted = stay.select(F.col("doc_id").alias("_key"), F.col("text_sha256").alias("_wanted"))
    several = several.join(
        wanted, several.doc_id.eqNullSafe(wanted._key) & (several._digest == wanted._wanted), "left_semi"
    )
    return _only(kept, repeated, "left_anti").union(several.dropDuplicates(["doc_id", "_digest"]).drop("_digest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates: of the least key (null last), then of the least text hash.

    Rows are judged apart, whatever key they have: each gets a number, which is staged.
    """
    docs = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = ngram_join(docs, key="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    ranked = docs.select("_row", order.alias("rank")).join(found, "_row")
    ranked = staged(ranked, "ranked")
    stay = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank._row")
    gone = staged(ranked.select("_row").join(stay, "_row", "left_anti"), "near-copies")
    return docs.join(gone, "_row", "left_anti").drop("_row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text holds no benchmark item. Only the text counts, so texts are told apart by digest, not by key."""
    rows = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    found = leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_digest")
    found = staged(found.select(F.col("doc_id").alias("_digest")).distinct(), "leaking")
    return rows.join(found, "_digest", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every document that is left."""
    encoded = encode_documents(docs, public_tokenizers.path(RANKS))
    return digests(encoded, "ids")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: None: SQL can't express the network and the merges; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

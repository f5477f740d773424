"""Exact dedup by content-defined chunk recipes.

A text is cut where its content says so: at the first full stop or line end
after ``MIN_CHUNK`` characters, at ``MAX_CHUNK`` at the latest. Each chunk gets
an identifier that is verified once over all chunks (no two different chunks
share it), and a document becomes the ordered list of its identifiers. Equal
lists are equal texts, so only lists move after that, never the long texts.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hailbook.llm.common import documents, join_groups, staged

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; put together they are the text. An empty text has none."""
    pattern = rf"(?s).{{{least},{most}}}?(?:[.\n]|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clashing(texts: DataFrame, chunk_id: Callable[[Column], Column]) -> DataFrame:
    """Identifiers that stand for more than one chunk: each distinct chunk moves once, for this."""
    return (
        texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        .groupBy(chunk_id(F.col("chunk")).alias("id"))
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .filter(F.col("least") != F.col("most"))
        .select("id")
    )


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text",
            chunk_id: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, recipe, text_sha256): ``recipe`` is the ordered list of (identifier, number).

    The number is 0 unless different chunks share the identifier; then it is the
    chunk's place among them, so the pair is exact whatever the hash does.
    """
    texts = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    plain = texts.select(
        "doc_id",
        F.transform(
            chunks(F.col("text")),
            lambda c: F.struct(chunk_id(c).alias("id"), F.lit(0).alias("number")),
        ).alias("recipe"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
    clashes = staged(clashing(texts, chunk_id), "chunk-clashes")
    if clashes.isEmpty():  # every identifier is verified: the lists stand as they are
        return plain
    numbered = (
        texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        .withColumn("id", chunk_id(F.col("chunk")))
        .join(clashes, "id", "left_semi")
        .distinct()
        .withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
    )
    one = texts.withColumn("row", F.monotonically_increasing_id())
    one = staged(one, "rows")
    placed = one.select("doc_id", "row", F.posexplode_outer(chunks(F.col("text"))).alias("at", "chunk"))
    placed = placed.withColumn("id", chunk_id(F.col("chunk"))).join(numbered, ["id", "chunk"], "left")
    lists = placed.groupBy("row").agg(
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("chunk").isNotNull(),
                    F.struct("at", "id", F.coalesce("number", F.lit(0)).alias("number")),
                )
            )
        ).alias("placed")
    )
    return one.join(lists, "row").select(
        "doc_id",
        F.transform("placed", lambda p: F.struct(p["id"].alias("id"), p["number"].alias("number"))).alias("recipe"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
                chunk_id: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    A null text is empty; all empty texts are one group. ``keep_id`` is the
    largest key of the group (null only if all its keys are null), ``kept`` is
    whether the row has it: rows that repeat a kept key are all kept. Other
    columns of ``docs`` are not looked at.
    """
    rows = staged(recipes(docs, key, text, chunk_id), "recipes")
    groups = rows.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    return join_groups(rows, groups, "recipe", F.size("recipe")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

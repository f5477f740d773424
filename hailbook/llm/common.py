"""Shared steps of the operators: written tables, blocks of texts, joins of rows to their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.session import staged  # noqa: F401  the operators import it from here

#: Bytes of text in a block; a block is what one call of a Python step holds.
BLOCK_BYTES = 4 << 20
ROW_BYTES = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, tag: Column, how: str = "inner") -> DataFrame:
    """Rows joined to ``groups`` (one row per ``key``), where one key may hold most rows.

    ``tag`` is any function of the key. With it among the join keys both sides
    are shuffled for the join itself, so that adaptive execution may split a hot
    partition; straight from the aggregate it could not.
    """
    left = rows.withColumn("_tag", tag)
    return left.join(groups.withColumn("_tag", tag), [key, "_tag"], how).drop("_tag")


def in_blocks(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES, least: int = 1) -> tuple[DataFrame, int]:
    """(block, key, text) with whole documents spread over blocks of about ``block_bytes``, and the total bytes.

    The block is a hash of key and text, so rows of one key (or of none) spread
    and a task that runs again sees the same documents. One pass sums the text
    lengths and looks for rows equal in both that would overfill a block; only
    if there are such, rows are numbered, staged, and the number hashed as well.
    A row counts ``ROW_BYTES`` besides its text there.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    same = rows.groupBy(F.xxhash64("doc_id", "text").alias("same")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    repeated = F.max(F.when(F.col("rows") > 1, F.col("bytes") + ROW_BYTES * F.col("rows")))
    total, most = same.agg(F.sum("bytes"), repeated).first()
    total = total or 0
    count = max(least, -(-total // block_bytes))
    hashed = ["doc_id", "text"]
    if (most or 0) > block_bytes:
        rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        hashed.append("_row")
    block = F.pmod(F.xxhash64(*hashed), F.lit(count)).cast("int")
    return rows.select(block.alias("block"), "doc_id", "text"), total

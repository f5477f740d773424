"""A join that stays balanced when few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailbook.session import staged

ROWS_PER_TASK = 1_000_000
MOST_HOT = 50_000
TRACKED = 393_216  # hashes in a sketch: three quarters of 2**19
GROUPS = 64  # sketches merged by the last step


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys too frequent for one task and the number of tasks each one needs.

    A key is hot above ``rows_per_task`` rows or one part in ``MOST_HOT`` of all
    rows, whichever is more. Frequent-items sketches of the tasks' 64-bit key
    hashes are merged in two steps, so rows are read once and not shuffled. A
    sketch of ``TRACKED`` hashes is off by at most one row in 149,796 (3.5 /
    2**19), always upwards: no hot key is left out, one just below the limit
    may come along. That bounds what is broadcast to 149,796 keys. Two keys that
    share a hash are only split more. The keys are staged: both sides of a join
    must see the same ones, and a sketch depends on the order it is merged in.
    """
    hashes = df.select(F.xxhash64(key).alias("key_hash"), F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("group"))
    sketches = hashes.groupBy("group").agg(
        F.expr(f"approx_top_k_accumulate(key_hash, {TRACKED})").alias("sketch"), F.count("*").alias("rows")
    )
    # grouped by a constant: without rows there is no group, and combining no sketch at all fails
    merged = sketches.groupBy(F.lit(1)).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch), {TRACKED})").alias("top"), F.sum("rows").alias("rows")
    )
    limit = F.greatest(F.lit(rows_per_task), F.ceil(F.col("rows") / MOST_HOT))
    counts = merged.select(F.explode("top").alias("top"), limit.alias("limit"))
    hot = counts.filter(F.col("top.count") > F.col("limit")).select(
        F.col("top.item").alias("key_hash"), F.ceil(F.col("top.count") / F.col("limit")).cast("int").alias("parts")
    )
    return staged(hot, "hot-keys")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join on ``key`` with the hot keys of ``left`` split over many tasks.

    ``right`` has one row per key; only its hot rows are repeated, once per
    part. ``spread`` names left columns that differ within a key: the part is a
    hash of them, so a task that runs again takes the same rows. ``hot`` gives
    the hot keys where they have been counted before.
    """
    hot = F.broadcast(hot_keys(left, key, rows_per_task) if hot is None else hot)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    on_hash = F.xxhash64(key) == F.col("key_hash")
    left_parts = (
        left.join(hot, on_hash, "left")
        .withColumn("part", F.pmod(F.xxhash64(*spread), parts).cast("int"))
        .drop("key_hash", "parts")
    )
    right_parts = (
        right.join(hot, on_hash, "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("key_hash", "parts")
    )
    return left_parts.join(right_parts, [key, "part"], how).drop("part")

"""Tables that keep the layout of a shuffle: hashed into buckets by a key and sorted by it within them.

What is written once this way can be joined, merged or grouped by that key
without moving its rows again. Tables are plain Parquet folders; whoever reads
one names the key and the number of buckets it was written with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def default_buckets(spark: SparkSession) -> int:
    """As many as shuffles have partitions, so that what an aggregation leaves needs no second shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` to the new folder ``path``. Nothing stays in the catalog."""
    name = f"hailbook_{uuid.uuid4().hex}"
    try:
        df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The table below ``path``; Spark knows its buckets. Nothing stays in the catalog."""
    name = f"hailbook_{uuid.uuid4().hex}"
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")

"""Tables of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.bucketed import read_bucketed
from hailbook.schema import PAGES, RESPONSES


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages with the columns of ``schema.RESPONSES``."""
    return spark.read.schema(RESPONSES).parquet(path)


def read_page_store(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages written by ``sinks.pages.write_page_store``; joins by requested URL leave them where they are."""
    buckets = spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RESPONSES.fields)
    return read_bucketed(spark, f"{path}/pages", schema, "requested_url", buckets)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A plain page table with the columns of ``schema.PAGES``."""
    return spark.read.schema(PAGES).parquet(path)


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """A plain ``(url, html)`` table as successful html responses."""
    return pages.select(
        F.col("url").alias("requested_url"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"),
        "html",
    )

"""Pages as a stream of files, each handled once across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hailbook.functions.urls import normalize_domain
from hailbook.operators.pages import with_contacts
from hailbook.operators.skew import ROWS_PER_TASK, hot_keys, salted_join
from hailbook.schema import PAGES
from hailbook.sinks.runs import publish
from hailbook.sources.lines import load_processed_domains
from hailbook.sources.runs import published


def stream_pages(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: StructType = PAGES
) -> DataFrame:
    """Page files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def unprocessed_pages(
    pages: DataFrame, processed: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Pages whose domain is not in the static state; batch or stream.

    Busy hosts are split over several tasks by the hash of the URL. A batch
    counts them itself; a stream takes ``hot`` from :func:`busy_domains` of what
    came in before, and splits none without it.
    """
    keyed = pages.withColumn("domain", normalize_domain("url"))
    if hot is None and pages.isStreaming:
        left = keyed.join(processed, "domain", "left_anti")
    else:
        left = salted_join(keyed, processed, "domain", "left_anti", spread=["url"], hot=hot)
    return left.select(*pages.columns)


def busy_domains(pages: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Hot domains of a batch of pages, for the next run of a stream."""
    return hot_keys(pages.select(normalize_domain("url").alias("domain")), "domain", rows_per_task)


def page_contact_rows(pages: DataFrame) -> DataFrame:
    """Contacts of each page, without its html; batch or stream."""
    return with_contacts(pages).drop("hrefs")


def append_new(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Write what arrived since the last call as Parquet, then stop.

    The checkpoint and the file sink's log make every file count once, also
    after a failure in the middle of a batch.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_new_with_state(
    stream: DataFrame, target: str, state: str, checkpoint: str
) -> None:
    """Like :func:`append_new`, and add the domains of what was written to the state lines.

    ``stream`` is a stream of page rows with their contacts. A batch that is
    run again replaces its own two folders, so nothing is doubled: both have a
    subfolder per batch, below one named after the checkpoint, so that a stream
    with a new checkpoint, whose batches count from 0 again, replaces nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        place = f"query={_stream_id(batch.sparkSession, checkpoint)}/batch={number}"
        batch.write.mode("overwrite").parquet(f"{target}/{place}")
        done = handled_domains(batch)
        done.write.mode("overwrite").text(f"{state}/{place}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def append_unhandled(pages: DataFrame, target: str, state: str, checkpoint: str) -> None:
    """Write the contacts of pages whose domain no earlier batch handled, and add their domains to the state.

    ``pages`` is a stream of pages. Each batch is held against the state as it
    is then, so a file that comes late with a domain of an earlier batch adds
    nothing, in this stream or in one with another checkpoint; pages of one
    domain in one batch all count. Rows and domains of a batch are a run that
    one file publishes (``sinks.runs``): a batch that broke off is not read, a
    published one that is run again writes nothing. ``state`` may hold lines
    and runs of :func:`~hailbook.plans.run.run_sites` as well. Streams over one
    state must not run at the same time. Read the rows by :func:`unhandled_rows`.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = f"{_stream_id(spark, checkpoint)}-{number}"
        named = published(spark, state)
        if named is not None and not named.filter(F.col("run") == run).isEmpty():
            return
        todo = unprocessed_pages(batch, load_processed_domains(spark, state))
        page_contact_rows(todo).write.mode("overwrite").parquet(f"{target}/run={run}")
        # the rows of the batch tell its domains, so pages are parsed once
        written = spark.read.parquet(f"{target}/run={run}")
        handled_domains(written).write.mode("overwrite").text(f"{state}/run={run}")
        publish(spark.createDataFrame([(run,)], "value string"), state)

    query = (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def unhandled_rows(spark: SparkSession, target: str, state: str) -> DataFrame:
    """Contact rows of the published batches below ``target``, with the ``run`` of each."""
    rows = spark.read.parquet(target)
    named = published(spark, state)
    return rows.limit(0) if named is None else rows.join(named, "run", "left_semi").select(*rows.columns)


def handled_domains(batch: DataFrame) -> DataFrame:
    """Distinct domains of a batch as lines."""
    found = batch.select(normalize_domain("url").alias("value"))
    return found.filter(F.col("value") != "").distinct()

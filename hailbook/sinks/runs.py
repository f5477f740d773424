"""One commit for the two outputs of a run: its rows and what they add to the state.

Both are written to folders of their own, ``run=<id>``, below the output and the
state. One file in ``_runs`` beside the state then names the run, and only that
makes it count: readers leave out the folders of runs that are not named. So a
run that breaks off anywhere, also with another site list afterwards, neither
loses nor doubles a row. What it left behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from hailbook.sinks.lines import append_processed_domains
from hailbook.sinks.results import append_results
from hailbook.sources.runs import LEDGER, POINTER, ledger_of


def write_run(rows: DataFrame, tried: DataFrame, output_path: str, processed_path: str) -> str:
    """Write result rows and the domains of the sites tried, then publish both. Gives the run's id."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    output_path, processed_path = output_path.rstrip("/"), processed_path.rstrip("/")
    if ledger_of(spark, output_path) != f"{processed_path}/{LEDGER}":
        pointer = spark.createDataFrame([(f"{processed_path}/{LEDGER}",)], "value string")
        pointer.coalesce(1).write.mode("overwrite").text(f"{output_path}/{POINTER}")
    append_results(rows, f"{output_path}/run={run}")
    append_processed_domains(tried, f"{processed_path}/run={run}")
    publish(rows.sparkSession.createDataFrame([(run,)], "value string"), processed_path)
    return run


def publish(run: DataFrame, processed_path: str) -> None:
    """Name the run: one file, which is there or not."""
    run.coalesce(1).write.mode("append").text(f"{processed_path}/{LEDGER}")

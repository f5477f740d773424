"""Which runs count; see ``sinks.runs``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.operators.skew import salted_join

LEDGER, POINTER = "_runs", "_state"


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ledger_of(spark: SparkSession, output_path: str) -> str | None:
    """Where the runs of an output folder are named, None if it has none."""
    pointer = _lines(spark, f"{output_path.rstrip('/')}/{POINTER}")
    return None if pointer is None else pointer.first()["value"]


def published(spark: SparkSession, processed_path: str) -> DataFrame | None:
    """Distinct names (``run``) of the runs that count, None if there is no ledger."""
    runs = _lines(spark, f"{processed_path.rstrip('/')}/{LEDGER}")
    return None if runs is None else runs.select(F.col("value").alias("run")).distinct()


def committed(rows: DataFrame, ledger: str | None, file: str = "file") -> DataFrame:
    """The rows whose ``file`` is in no run folder, or in that of a run that was published."""
    run = F.regexp_extract(file, "/run=([^/]+)/[^/]*$", 1)
    runs = None if ledger is None else _lines(rows.sparkSession, ledger)
    if runs is None:
        return rows.filter(run == "")
    known = runs.select(F.col("value").alias("run")).union(rows.sparkSession.range(1).select(F.lit("").alias("run")))
    spread = [c for c in rows.columns if c != file] or [file]
    named = salted_join(rows.withColumn("run", run), known.distinct(), "run", "left_semi", spread=spread)
    return named.select(*rows.columns)

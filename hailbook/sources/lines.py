"""Line files: site lists and the state of processed domains."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.functions.text import strip
from hailbook.operators.sites import clean_sites, domains
from hailbook.sources.runs import LEDGER, committed

LINES = "position struct<file:string,block:bigint,line:bigint>, value string"


def read_lines(
    spark: SparkSession, path: str, allow_missing: bool = True, nested: bool = False
) -> DataFrame:
    """Stripped, non-blank lines of a file or folder (``nested``: and its subfolders), with their position.

    The position orders by file, block and line without a pass over one task:
    a block is read front to back, so row ids rise within it. Bad UTF-8 becomes
    U+FFFD. A missing path gives no lines, or an error if not allowed.
    """
    try:
        text = spark.read.option("recursiveFileLookup", nested).text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if not allow_missing:
            raise FileNotFoundError(f"File does not exist: {path}") from error
        return spark.createDataFrame([], LINES)
    lines = text.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
        strip(F.make_valid_utf8("value")).alias("value"),
    )
    return lines.filter(F.col("value") != "")


def load_sites(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised sites of a list file, which has to exist."""
    return clean_sites(read_lines(spark, path, allow_missing=False))


def load_processed_domains(spark: SparkSession, path: str) -> DataFrame:
    """Distinct domains of earlier runs that were published, and of plain lines; none if there was no run yet."""
    lines = read_lines(spark, path, nested=True).select("value", F.col("position.file").alias("file"))
    return domains(committed(lines, f"{path.rstrip('/')}/{LEDGER}"))

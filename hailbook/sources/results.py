"""Result files of earlier runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.functions.text import clean_whitespace
from hailbook.schema import RESULTS
from hailbook.sources.runs import committed, ledger_of

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
# A field is quoted only if it starts with a quote; what follows the closing one belongs to it.
_FIELD = r'(?:"(?:[^"]++|"")*+"?+[^,\r\n]*+|[^",\r\n][^,\r\n]*+)?+'
_RECORD = rf"({_FIELD}(?:,{_FIELD})*+)(?:\r\n?|\n|\z)"
_QUOTED = r'(?s)\A"((?:[^"]++|"")*+)"?+(.*)\z'


def records(text: Column) -> Column:
    """The records of a CSV text; a line break within quotes ends none. Blank lines are none."""
    return F.filter(F.regexp_extract_all(text, F.lit(_RECORD), 1), lambda record: record != "")


def fields(record: Column) -> Column:
    """The values of a record, without their quotes."""

    def value(raw: Column) -> Column:
        inner = F.replace(F.regexp_extract(raw, _QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(raw.startswith('"'), F.concat(inner, F.regexp_extract(raw, _QUOTED, 2))).otherwise(raw)

    # With a comma in front no match is empty, so none is skipped.
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_FIELD})"), 1)
    return F.transform(raw, value)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of a CSV file or folder; a missing path gives no rows.

    Columns are taken by the names in the header of each file, in any order;
    missing ones are empty, others are left out, of repeated ones the first
    counts. A file is parsed as a whole where it is read, since only from its
    start can one tell which line breaks stand in quotes. Files in folders of
    runs that were not published are left out.
    """
    try:
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)
    files = files.select(F.col("_metadata.file_path").alias("file"), "value")
    found = committed(files, ledger_of(spark, path)).select(
        records(F.regexp_replace(F.make_valid_utf8("value"), "\\A\ufeff", "")).alias("records")
    )
    # The names first: above the explode they would carry all records of the file along with each.
    headed = found.select(
        fields(F.get("records", F.lit(0))).alias("names"),
        F.slice("records", F.lit(2), F.greatest(F.size("records") - 1, F.lit(0))).alias("records"),
    )
    rows = headed.select("names", F.explode("records").alias("record")).select("names", fields(F.col("record")).alias("values"))

    def named(name: str) -> Column:
        place = F.array_position("names", name).cast("int")
        return F.coalesce(F.when(place > 0, F.get("values", place - 1)), F.lit("")).alias(name)

    return rows.select(*[named(name) for name in RESULTS.names])


def load_existing_result_urls(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty URLs of the rows already saved."""
    urls = read_results(spark, path).select(clean_whitespace("url").alias("url"))
    return urls.filter(F.col("url") != "").distinct()

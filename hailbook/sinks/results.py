"""Result rows as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter

from hailbook.constants import RESULT_COLUMNS
from hailbook.sources.results import CSV_OPTIONS


def _writer(rows: DataFrame, mode: str) -> DataFrameWriter:
    return (
        rows.select(*RESULT_COLUMNS)
        .write.mode(mode)
        .options(
            **CSV_OPTIONS,
            emptyValue="",
            nullValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            lineSep="\r\n",
        )
    )


def append_results(rows: DataFrame, path: str) -> None:
    """Append result rows; every part file has the header.

    Quotes are doubled, empty values stay empty and blanks are kept, as a
    standard CSV writer does.
    """
    _writer(rows, "append").csv(path)

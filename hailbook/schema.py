"""Schemas of the tables that come in and go out; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from hailbook.constants import RESULT_COLUMNS


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# One fetched page per row; stands in for the request a crawler would make.
RESPONSES = T.StructType(
    [
        *_strings("requested_url", "final_url"),
        T.StructField("status_code", T.IntegerType()),
        *_strings("content_type", "html"),
    ]
)

RESULTS = T.StructType(_strings(*RESULT_COLUMNS))

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), *_strings("url", "html")]
)

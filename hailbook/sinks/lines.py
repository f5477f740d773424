"""Line files: cleaned site lists and processed domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailbook.functions.text import clean_whitespace
from hailbook.operators.sites import attempted_domains, ordered_distinct


def _clean(lines: DataFrame, value: str, *keep: str) -> DataFrame:
    cleaned = lines.select(*keep, clean_whitespace(value).alias("value"))
    return cleaned.filter(F.col("value") != "")


def save_lines(lines: DataFrame, path: str, position: str | None = None) -> None:
    """Overwrite ``path`` with the cleaned, non-empty column ``value``.

    With a position column the lines are in its order over all part files.
    """
    if position is None:
        ordered = _clean(lines, "value")
    else:
        ordered = _clean(lines, "value", position).orderBy(position)
    ordered.select("value").write.mode("overwrite").text(path)


def save_cleaned_sites(sites: DataFrame, path: str) -> None:
    """Overwrite ``path`` with the distinct sites in first-seen order."""
    values = ordered_distinct(_clean(sites, "site", "position"), "value", "position")
    save_lines(values, path, "position")


def append_processed_domains(sites: DataFrame, path: str) -> None:
    """Add the domain of every site tried; repeats are dropped when read."""
    domains = attempted_domains(sites).select(F.col("domain").alias("value"))
    domains.write.mode("append").text(path)

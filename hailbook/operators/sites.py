"""Site lists: cleaning, skipping what was handled before, next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailbook.functions.urls import domain_of, normalize_domain, normalize_url
from hailbook.operators.skew import salted_join


def clean_sites(lines: DataFrame) -> DataFrame:
    """Lines ``(position, value)`` to distinct ``(position, site)``.

    Sites are distinct by URL, not by domain; the first position is kept.
    """
    urls = lines.select("position", normalize_url("value").alias("site"))
    return (
        urls.filter(F.col("site") != "")
        .groupBy("site")
        .agg(F.min("position").alias("position"))
        .select("position", "site")
    )


def domains(lines: DataFrame) -> DataFrame:
    """Distinct non-empty domains of a column ``value`` of URL-like lines."""
    found = lines.select(normalize_domain("value").alias("domain"))
    return found.filter(F.col("domain") != "").distinct()


def with_domain(sites: DataFrame) -> DataFrame:
    return sites.withColumn("domain", domain_of("site"))


def unprocessed_sites(sites: DataFrame, processed: DataFrame) -> DataFrame:
    """Sites whose domain is not in the state from earlier runs.

    The state is read once: two URLs of one new domain both stay. Domains that
    very many sites share are split over several tasks.
    """
    keyed = with_domain(sites)
    todo = salted_join(keyed, processed, "domain", "left_anti", spread=["site"])
    return todo.select(*sites.columns)


def attempted_domains(sites: DataFrame) -> DataFrame:
    """What a run adds to the state: every site it tried, successful or not."""
    return with_domain(sites).select("domain").filter(F.col("domain") != "")


def next_processed_state(processed: DataFrame, attempted: DataFrame) -> DataFrame:
    """Distinct domains after the run."""
    return processed.select("domain").union(attempted.select("domain")).distinct()


def ordered_distinct(values: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the first position of each."""
    return values.groupBy(value).agg(F.min(position).alias(position))

"""Response rows: which ones count as pages, and what each page contains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailbook.functions.html import (
    emails_of,
    page_links,
    page_text,
    page_title,
    phones_of,
    telegrams_of,
)
from hailbook.functions.text import text_or_empty
from hailbook.operators.key_filter import key_filter, may_hold

CONTACT_FIELDS = ("site_name", "emails", "telegrams", "phones")


def accepted_pages(responses: DataFrame) -> DataFrame:
    """Successful responses with an html or plain text content type.

    A fetch that failed has no status and no content type and is dropped, and
    so is a row without a requested URL. Without a final URL there was no
    redirect: it is the requested one.
    """
    status = F.col("status_code")
    content_type = F.lower(text_or_empty("content_type"))
    kept = responses.filter(
        F.col("requested_url").isNotNull()
        & status.isNotNull()
        & ~status.between(400, 599)
        & (content_type.contains("html") | content_type.contains("text/plain"))
    )
    return kept.withColumn("final_url", F.coalesce("final_url", "requested_url"))


def page_keys(accepted: DataFrame) -> DataFrame:
    """One ``(requested_url, final_url)`` per URL; html is not read."""
    return accepted.groupBy("requested_url").agg(F.min("final_url").alias("final_url"))


def with_contacts(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by the contact columns and the link targets.

    Runs in the scan stage: html never goes into a shuffle.
    """
    others = [name for name in pages.columns if name != "html"]
    html = text_or_empty("html")
    text, hrefs = F.col("page_text"), F.col("hrefs")
    # Two projections: what the second one reads several times is derived once.
    parsed = pages.select(
        *others,
        html.alias("html"),
        page_title("html").alias("site_name"),
        page_text("html").alias("page_text"),
        page_links("html").alias("hrefs"),
    )
    return parsed.select(
        *others,
        "site_name",
        emails_of(text, hrefs).alias("emails"),
        telegrams_of(text, hrefs, F.col("html")).alias("telegrams"),
        phones_of(text, hrefs).alias("phones"),
        "hrefs",
    )


def parsed_pages(accepted: DataFrame) -> DataFrame:
    """Contacts per requested URL, one row each.

    If a URL was fetched more than once, the row with the least final URL is
    taken, then the least contents: the same choice as :func:`page_keys`, and
    the same on every run.
    """
    parsed = with_contacts(accepted.select("requested_url", "final_url", "html"))
    return (
        parsed.groupBy("requested_url")
        .agg(F.min(F.struct("final_url", *CONTACT_FIELDS)).alias("page"))
        .select("requested_url", "page.*")
    )


def wanted_pages(accepted: DataFrame, wanted: DataFrame) -> DataFrame:
    """The accepted rows whose URL is in ``wanted`` (requested_url, distinct): only they are parsed.

    A filter of the wanted URLs is tested in the scan stage, so hardly any other
    row with its html gets to the shuffle of the join. That is an inner join, as
    the optimizer would move a left semi join below the filter.
    """
    maybe = may_hold(accepted, "requested_url", key_filter(wanted, "requested_url"))
    return maybe.join(wanted, "requested_url").select(*accepted.columns)


def page_hrefs(accepted: DataFrame) -> DataFrame:
    """``(requested_url, hrefs)`` per URL, of the row that the least final URL and links choose."""
    links = accepted.select("requested_url", "final_url", page_links("html").alias("hrefs"))
    least = links.groupBy("requested_url").agg(F.min(F.struct("final_url", "hrefs")).alias("page"))
    return least.select("requested_url", "page.hrefs")

"""Registered queries: every operator over whole tables or derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.derived import table, view
from hailbook.functions import contacts, html, text, urls
from hailbook.functions.entities import decode_text
from hailbook.operators import crawl, pages, report, sites
from hailbook.plans.run import SiteRun, plan_run
from hailbook.schema import PAGES
from hailbook.session import shared_folder
from hailbook.sinks.lines import append_processed_domains, save_cleaned_sites, save_lines
from hailbook.sinks.pages import write_page_store
from hailbook.sinks.results import append_results
from hailbook.sources.lines import load_processed_domains, read_lines
from hailbook.sources.responses import read_page_store, responses_from_pages
from hailbook.sources.results import load_existing_result_urls, read_results
from hailbook.streaming.incremental import (
    append_new,
    page_contact_rows,
    stream_pages,
    unprocessed_pages,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# More than the contact paths, so that links found on the page are visited too.
DEEP = 12


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _column(
    name: str, source: str, keys: list[str], columns: Callable[[], dict[str, Column]]
) -> None:
    """Register a projection of a table or view."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = table if source in ("pages", "documents") else view
        rows = read(spark, sf_dir, source)
        return rows.select(*keys, *[c.alias(alias) for alias, c in columns().items()])

    QUERIES[name] = query


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


def _contact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "contact_pages")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.clean_sites(view(spark, sf_dir, "raw_sites"))


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.domains(view(spark, sf_dir, "processed"))


def _todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.unprocessed_sites(_sites(spark, sf_dir), _processed(spark, sf_dir))


def _run(spark: SparkSession, sf_dir: str, max_pages: int = 10) -> SiteRun:
    return plan_run(
        _sites(spark, sf_dir),
        _processed(spark, sf_dir),
        view(spark, sf_dir, "responses"),
        max_pages,
    )


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = pages.accepted_pages(view(spark, sf_dir, "responses"))
    return crawl.entry_pages(_todo(spark, sf_dir), pages.page_keys(accepted))


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, hrefs)`` of the pages table and of the derived pages."""
    own = table(spark, sf_dir, "pages").select("url", "html")
    derived = _contact_pages(spark, sf_dir).select(F.concat("root", "path").alias("url"), "html")
    return own.union(derived).select("url", html.page_links("html").alias("hrefs"))


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, pos, href)`` of the pages table and of the derived pages."""
    return _hrefs(spark, sf_dir).select("url", F.posexplode("hrefs").alias("pos", "href"))


# --- functions on values ------------------------------------------------------

_column(
    "normalize_url", "pages", ["page_id"], lambda: {"normalized": urls.normalize_url("url")}
)
_column("normalize_domain", "pages", ["page_id"], lambda: {"domain": urls.normalize_domain("url")})
_column("normalize_email", "messy", ["id"], lambda: {"value": contacts.normalize_email("email")})
_column("normalize_telegram", "messy", ["id"], lambda: {"value": contacts.normalize_telegram("telegram")})
_column("normalize_phone", "messy", ["id"], lambda: {"value": contacts.normalize_phone("phone")})
_column("clean_whitespace", "documents", ["doc_id"], lambda: {"cleaned": text.clean_whitespace("text")})
_column(
    "as_array",
    "messy",
    ["id"],
    lambda: {
        "one": _joined(text.as_list(F.nullif(F.col("telegram"), F.lit("")))),
        "size": F.size(text.as_list(F.nullif(F.col("telegram"), F.lit("")))),
        "none": F.size(text.as_array(F.lit(None).cast("array<string>"))),
    },
)
_column("decode_entities", "pages", ["page_id"], lambda: {"decoded": decode_text("html")})
_column("decode_references", "references", ["id"], lambda: {"decoded": decode_text("raw")})
_column("page_title", "pages", ["page_id"], lambda: {"title": html.page_title("html")})
_column("page_text", "pages", ["page_id"], lambda: {"body": html.page_text("html")})

_column(
    "dedupe_emails",
    "messy",
    ["id"],
    lambda: {
        "found": _joined(
            contacts.dedupe_emails(
                F.array(F.col("email"), F.lit(" "), F.lower("email"), F.concat(F.lit("x"), "email"))
            )
        )
    },
)
_column(
    "dedupe_telegrams",
    "messy",
    ["id"],
    lambda: {
        "found": _joined(
            contacts.dedupe_telegrams(
                F.array(F.col("telegram"), F.upper("telegram"), F.lit("t.me/News"), F.lit("@news"))
            )
        )
    },
)
_column(
    "dedupe_phones",
    "messy",
    ["id"],
    lambda: {
        "found": _joined(
            contacts.dedupe_phones(
                F.array(F.lit("8 912 000 11 22"), F.col("phone"), F.lit("+79120001122"))
            )
        )
    },
)


@register
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = report.result_row(
        F.col("title"),
        F.array(F.col("email"), F.lower("email"), F.lit(" ")),
        F.array(F.col("telegram"), F.lit("@Other")),
        F.array(F.col("phone"), F.lit("8 912 000 11 22")),
        F.col("url"),
    )
    return view(spark, sf_dir, "messy").select("id", *row)


# --- text and page extraction ---------------------------------------------------


@register
def emails_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.posexplode(contacts.emails_in_text("text")).alias("pos", "email")
    return table(spark, sf_dir, "documents").select("doc_id", found)


@register
def phones_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.posexplode(contacts.phones_in_text("text")).alias("pos", "phone")
    return table(spark, sf_dir, "documents").select("doc_id", found)


@register
def telegrams_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.posexplode(contacts.telegrams_in_text("note")).alias("pos", "telegram")
    return view(spark, sf_dir, "messy").select("id", found)


@register
def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contact_pages(spark, sf_dir)
    return rows.select("site_id", "pos", _joined(html.page_emails("html")).alias("emails"))


@register
def page_telegrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contact_pages(spark, sf_dir)
    return rows.select("site_id", "pos", _joined(html.page_telegrams("html")).alias("telegrams"))


@register
def page_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contact_pages(spark, sf_dir)
    return rows.select("site_id", "pos", _joined(html.page_phones("html")).alias("phones"))


@register
def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.with_contacts(_contact_pages(spark, sf_dir).select("site_id", "pos", "html"))
    return found.select(
        "site_id", "pos", "site_name", *[_joined(F.col(c)).alias(c) for c in report.LISTS]
    )


@register
def page_contacts_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the table of raw web pages."""
    found = pages.with_contacts(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select(
        "page_id", "site_name", *[_joined(F.col(c)).alias(c) for c in report.LISTS]
    )


# --- links ------------------------------------------------------------------------


@register
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_links(spark, sf_dir)


@register
def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_links(spark, sf_dir).select(
        "url",
        "pos",
        urls.is_http_url("href").alias("is_http"),
        urls.is_relative_url("href").alias("is_relative"),
        urls.is_page_link("href").alias("is_page"),
        html.is_telegram_link("href").alias("is_telegram"),
    )


@register
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = urls.absolute_urls("url", "hrefs")
    return _hrefs(spark, sf_dir).select("url", F.posexplode(targets).alias("pos", "target"))


@register
def same_domain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Filtered within the page: a filter of the rows would be moved below the projection and resolve each link twice.
    links = F.transform(
        urls.absolute_urls("url", "hrefs"),
        lambda target, pos: F.struct(pos.alias("pos"), target.alias("target")),
    )
    own = text.let(
        urls.normalize_domain("url"),
        lambda domain: F.filter(links, lambda link: urls.is_of_domain(link["target"], domain)),
    )
    return _hrefs(spark, sf_dir).select("url", F.inline(own))


def _internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _hrefs(spark, sf_dir)
    found = urls.internal_links("url", "hrefs")
    return links.select("url", F.posexplode(found).alias("pos", "link"))


@register
def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _internal(spark, sf_dir)


@register
def link_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _internal(spark, sf_dir)
    return links.withColumn("likely", urls.has_contact_keyword("link"))


# --- sources and sinks ------------------------------------------------------------


@register
def read_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "raw-sites")
    view(spark, sf_dir, "raw_sites").select("value").write.text(path)
    return read_lines(spark, path).select("value")


@register
def clean_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir)


@register
def saved_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned sites written as lines and read back."""
    path = shared_folder(spark, "sites-cleaned")
    save_cleaned_sites(_sites(spark, sf_dir), path)
    return read_lines(spark, path).select("value")


@register
def saved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "lines")
    rows = view(spark, sf_dir, "messy").select("id", F.col("title").alias("value"))
    save_lines(rows, path, "id")
    return read_lines(spark, path).select("value")


@register
def processed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(spark, sf_dir)


@register
def appended_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State written by two runs and read back."""
    path = shared_folder(spark, "processed")
    earlier = view(spark, sf_dir, "processed").select(urls.normalize_url("value").alias("site"))
    append_processed_domains(earlier, path)
    append_processed_domains(_todo(spark, sf_dir), path)
    return load_processed_domains(spark, path)


@register
def next_processed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempted = sites.attempted_domains(_todo(spark, sf_dir))
    return sites.next_processed_state(_processed(spark, sf_dir), attempted)


def _saved_results(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "results")
    rows = result_rows(spark, sf_dir)
    append_results(rows.filter("id % 2 = 0"), path)
    append_results(rows.filter("id % 2 = 1"), path)
    return path


@register
def saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows appended twice as CSV and read back."""
    return read_results(spark, _saved_results(spark, sf_dir))


@register
def existing_result_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_existing_result_urls(spark, _saved_results(spark, sf_dir))


@register
def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses_from_pages(table(spark, sf_dir, "pages"))


@register
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sites.ordered_distinct(rows, "source", "doc_id")


# --- site visits --------------------------------------------------------------------


@register
def sites_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _todo(spark, sf_dir)


@register
def accepted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = pages.accepted_pages(view(spark, sf_dir, "responses"))
    return accepted.select("requested_url", "final_url", "status_code", "content_type")


@register
def entry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


def _with_deep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = pages.accepted_pages(view(spark, sf_dir, "responses"))
    wanted = _entries(spark, sf_dir).select("requested_url").distinct()
    hrefs = pages.page_hrefs(pages.wanted_pages(accepted, wanted))
    return crawl.with_candidates(_entries(spark, sf_dir), hrefs, DEEP)


@register
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _with_deep_candidates(spark, sf_dir)
    return found.select("site", F.posexplode("candidates").alias("pos", "url"))


@register
def checked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = crawl.with_candidates(_entries(spark, sf_dir))
    checked = crawl.checked_urls(entries)
    return checked.select("site", _joined(F.col("checked_urls")).alias("checked_urls"))


@register
def crawl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = crawl.with_candidates(_entries(spark, sf_dir))
    status = crawl.crawl_status(_todo(spark, sf_dir), entries)
    return status.select(
        "position", "site", "site_url", F.size("checked_urls").alias("checked"), "success"
    )


@register
def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _run(spark, sf_dir, DEEP).site_pages
    return kept.select("site", "pos", "url", "site_name", _joined(F.col("emails")).alias("emails"))


@register
def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = report.site_contacts(_run(spark, sf_dir).site_pages)
    return folded.select(
        "site", "site_url", "site_name", *[_joined(F.col(c)).alias(c) for c in report.LISTS]
    )


@register
def site_contact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.site_contact_counts(_run(spark, sf_dir).site_pages)


@register
def site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: site list, earlier state and pages to result rows."""
    return _run(spark, sf_dir).report()


@register
def site_report_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over pages that were written by URL before."""
    path = shared_folder(spark, "page-store")
    write_page_store(view(spark, sf_dir, "responses"), path)
    stored = read_page_store(spark, path)
    return plan_run(_sites(spark, sf_dir), _processed(spark, sf_dir), stored).report()


@register
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = crawl.with_candidates(_entries(spark, sf_dir))
    status = crawl.crawl_status(_todo(spark, sf_dir), entries)
    return report.run_summary(_sites(spark, sf_dir), status)


# --- streaming ----------------------------------------------------------------------


@register
def incremental_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages outside ``.org`` hosts, streamed twice into one table."""
    done = table(spark, sf_dir, "pages").select(F.col("url").alias("value"))
    done = sites.domains(done.filter(urls.normalize_domain("value").endswith(".org")))
    target = shared_folder(spark, "stream")
    for _ in range(2):
        # the table may be a file or a folder of files; a stream takes a file only by a pattern
        stream = stream_pages(spark, f"{sf_dir}/pages.parque[t]", schema=PAGES)
        rows = page_contact_rows(unprocessed_pages(stream, done))
        append_new(rows, f"{target}/rows", f"{target}/checkpoint")
    rows = spark.read.parquet(f"{target}/rows")
    return rows.select("page_id", "url", "site_name", _joined(F.col("emails")).alias("emails"))

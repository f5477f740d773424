"""Title, visible text, anchors and contacts of an HTML page.

One left-to-right token pattern decides what is markup: comments, elements
whose content is not text, declarations and tags. What lies between the tokens
is text, and the anchors are among them. Everything is a Column expression, so
pages are parsed where they are scanned, with no Python and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hailbook.constants import WS
from hailbook.functions.contacts import (
    dedupe_emails,
    dedupe_phones,
    dedupe_telegrams,
    emails_in_text,
    normalize_email,
    normalize_phone,
    normalize_telegram,
    phones_in_text,
    telegrams_in_text,
)
from hailbook.functions.entities import REPLACEMENT, decode_attribute, decode_text
from hailbook.functions.text import StrCol, clean_whitespace, let, strip, text_or_empty

# Stands for a < behind the last > of a page. No tag can end there, so nothing
# has to be searched from it to the end of the page, over and over.
OPEN = "\ufdd0"

_VALUE = r"""(?:'[^']*+'|"[^"]*+"|(?!['"])[^>\s]*+)"""
# Everything up to the end of a start tag; > inside a quoted value is skipped.
_ATTRIBUTES = rf"(?:[^>=]++|=++\s*+{_VALUE})*+"
# All without the < in front of them: a pattern of several has it once, so that
# a scan tries the alternatives only where one stands.
_TAG = rf"[a-zA-Z]{_ATTRIBUTES}>"
# What ends one of them is looked for where its first character stands.
_COMMENT = r"!--(?:[^-]++|-(?!-\s*+>))*+(?:--\s*+>|\z)"
_CODE = (
    rf"(script|style)(?=[\s/>]){_ATTRIBUTES}(?<!/)>"
    r"(?:[^<]++|<(?!/\s*+\1\s*+>))*+(?:</\s*+\1\s*+>|\z)"
)
_END_OR_DECLARATION = r"/[^>]*+>|[!?][^>]*+>"
# Ruby annotations end with their own tag or with the ruby element.
_HIDDEN = (
    rf"(template|r[tp])(?=[\s/>]){_ATTRIBUTES}(?<!/)>"
    r"(?:[^<]++|<(?!/\s*+(?:\2|ruby)\s*+>))*+(?:</\s*+(?:\2|ruby)\s*+>|\z)"
)
# An anchor attribute by attribute; the group ends up with the last href.
_ANCHOR = (
    rf"a(?=[\s/>])(?:[\s/]++|href(?=[\s=/>])(?:\s*+=++\s*+({_VALUE}))?+"
    rf"|[^\s/>][^\s/=>]*+(?:\s*+=++\s*+{_VALUE})?+)*+>"
)

# Markup without text between is one match. The first character of an alternative
# rules out the others, so that few of them are begun.
MARKUP = (
    rf"(?is)(?:<(?:/[^>]*+>|(?=[a-z])(?:(?=s){_CODE}|(?=[rt]){_HIDDEN}|{_TAG})"
    rf"|{_COMMENT}|[!?][^>]*+>)[ \t\r\n]*+)++"
)
# Group 2 keeps the start tags outside comments, scripts and styles.
KEEP_TAGS = rf"(?is)<(?:{_COMMENT}|{_CODE})|(<{_TAG})"
# Group 2 is the raw href of an anchor.
HREFS = rf"(?is)<(?=[a-z!])(?:{_COMMENT}|(?=s){_CODE}|{_ANCHOR}|{_TAG})"
# Group 2 is an anchor with all up to the next anchor tag, looked at ahead of
# the tag, so that the scan goes on right behind it.
ANCHORS = (
    rf"(?is)(?=<)(?:<(?:{_COMMENT}|{_CODE})"
    rf"|(?=(<a(?=[\s/>]){_ATTRIBUTES}>(?:[^<{OPEN}]++|[<{OPEN}](?!/?a[\s/>]))*+))?+<{_TAG})"
)
# Group 2 is the content of the first title outside comments and scripts.
TITLE = (
    rf"(?is)\A(?:[^<]++|<(?!title[\s/>])(?:{_COMMENT}|{_CODE}|{_TAG}|{_END_OR_DECLARATION})?+)*+"
    rf"<title(?=[\s/>]){_ATTRIBUTES}>(.*?)(?=[<{OPEN}]/\s*+(?:title|head)\b|\z)"
)
# A page is cut in front of these; the piece after one starts with it.
_TEMPLATE_EDGE = r"(?i)(?=<template[\s/>]|</template\s*+>)"
# Stands for removed markup, so that the text on both sides stays apart.
CUT = "<!>"
# NUL is no legal character of a page; it marks the borders of text nodes.
BORDER = "\x00"
_BORDERS = rf"(?:\x00|{WS}(?=\x00|{WS})(?<!{WS}{WS}){WS}*+\x00)(?:{WS}|\x00)*+"


def _closed(html: StrCol) -> Column:
    """The page with a harmless ``OPEN`` for every < in its tail, behind the last >.

    A comment that starts in the tail hides the rest of it.
    """

    def mark(page: Column) -> Column:
        tail = F.substring_index(page, ">", -1)
        head = F.substring(page, F.lit(1), F.length(page) - F.length(tail))
        seen = F.translate(F.substring_index(tail, "<!--", 1), "<", OPEN)
        return F.when(tail.contains("<"), F.concat(head, seen)).otherwise(page)

    return let(text_or_empty(html), mark)


def _opened(text: Column) -> Column:
    """Undo the mark of :func:`_closed`."""
    return let(text, lambda t: F.when(t.contains(OPEN), F.translate(t, OPEN, "<")).otherwise(t))


def _open_cdata(html: Column) -> Column:
    """The content of a CDATA section is text; only up to the last end of one can there be any."""
    head = F.regexp_extract(html, r"(?s)\A.*\]\s*+\]\s*+>", 0)
    opened = F.concat(
        F.regexp_replace(head, r"(?s)<!\[CDATA\[(.*?)\]\s*+\]\s*+>", CUT + "$1" + CUT),
        F.substring(html, F.length(head) + 1, F.length(html)),
    )
    return F.when(html.contains("<![CDATA["), opened).otherwise(html)


def _drop_templates(html: Column) -> Column:
    """Cut templates, for pages where they may nest, in one pass that counts the open ones."""
    pieces = F.split(F.regexp_replace(html, KEEP_TAGS, CUT + "$2"), _TEMPLATE_EDGE, -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        opens = piece.rlike(r"(?i)\A<template[\s/>]")
        closes = piece.rlike(r"(?i)\A</template\s*+>")
        depth = state["depth"]
        after = F.when(opens, depth + 1).when(closes, F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        shown = F.when(closes, F.regexp_replace(piece, r"(?i)\A</template\s*+>", CUT)).otherwise(piece)
        kept = F.when(after == 0, F.concat(state["kept"], shown)).otherwise(state["kept"])
        return F.struct(after.alias("depth"), kept.alias("kept"))

    inner = F.aggregate(pieces, start, step, lambda state: state["kept"])
    # Cheap test first: most pages have no template at all.
    nested = F.lower(html).contains("<template") & html.rlike(r"(?is)<template\b.*<template\b")
    return F.when(nested, inner).otherwise(html)


def _nodes_text(html: Column) -> Column:
    """Decoded text nodes, stripped, without the empty ones, joined by a blank."""
    clean = let(
        html, lambda h: F.when(h.contains(BORDER), F.translate(h, BORDER, REPLACEMENT)).otherwise(h)
    )
    nodes = decode_text(F.regexp_replace(clean, MARKUP, BORDER))
    joined = F.regexp_replace(F.concat(F.lit(BORDER), nodes, F.lit(BORDER)), _BORDERS, " ")
    return F.trim(joined)


def page_text(html: StrCol) -> Column:
    """Visible text: stripped text nodes joined by one blank."""
    page = let(_closed(html), _open_cdata)
    return _opened(_nodes_text(let(page, _drop_templates)))


def page_title(html: StrCol) -> Column:
    """First title, whitespace-clean; empty when there is none."""
    return clean_whitespace(_opened(_nodes_text(F.regexp_extract(_closed(html), TITLE, 2))))


def _href(raw: Column) -> Column:
    """Attribute value without its quotes, decoded and stripped."""
    quoted = raw.startswith('"') | raw.startswith("'")
    bare = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return strip(decode_attribute(bare))


def page_links(html: StrCol) -> Column:
    """Href of every anchor that has one, in document order."""
    raw = F.regexp_extract_all(_closed(html), F.lit(HREFS), 2)
    return F.transform(F.filter(raw, lambda value: value != ""), _href)


def _with_prefix(hrefs: Column, scheme: str) -> Column:
    """What follows ``scheme`` in the hrefs that start with it."""
    matching = F.filter(hrefs, lambda h: F.lower(F.substring(h, 1, len(scheme))) == scheme)
    return F.transform(matching, lambda h: F.substring(h, len(scheme) + 1, 1 << 30))


def is_telegram_link(href: StrCol) -> Column:
    return let(
        F.lower(text_or_empty(href)),
        lambda h: h.contains("t.me/") | h.contains("telegram.me/") | h.startswith("@"),
    )


def emails_of(text: Column, hrefs: Column) -> Column:
    """Addresses in the text, then those of mailto links."""
    linked = F.transform(_with_prefix(hrefs, "mailto:"), normalize_email)
    return dedupe_emails(F.concat(emails_in_text(text), linked))


def phones_of(text: Column, hrefs: Column) -> Column:
    """Mobile numbers in the text, then the numbers of tel links."""
    return dedupe_phones(F.concat(phones_in_text(text), _with_prefix(hrefs, "tel:")))


def _linked_telegrams(html: Column) -> Column:
    """Per Telegram link: its target, then what its own text names."""

    def names(anchor: Column) -> Column:
        return let(
            _href(F.regexp_extract(anchor, "(?is)^<" + _ANCHOR, 1)),
            lambda href: F.when(
                is_telegram_link(href),
                F.concat(
                    F.array(normalize_telegram(href)),
                    let(_opened(_nodes_text(anchor)), telegrams_in_text),
                ),
            ).otherwise(F.array().cast("array<string>")),
        )

    # Cheap test first: no Telegram link goes without one of these.
    anchors = F.filter(
        F.regexp_extract_all(_closed(html), F.lit(ANCHORS), 2), lambda a: a.rlike("(?i)me/|[@&]")
    )
    return F.flatten(F.transform(anchors, names))


def telegrams_of(text: Column, hrefs: Column, html: Column) -> Column:
    """Names in the text, then those of Telegram links.

    What an anchor names is visible text too, unless a template or a ruby
    annotation hides it. So if the text names nothing and nothing is hidden,
    the targets of the links are all there is, and the anchors are not searched.
    """
    no_names = F.array().cast("array<string>")

    def all_of(named: Column, links: Column) -> Column:
        hidden = html.rlike(r"(?i)<(?:template|r[tp])[\s/>]")
        targets = F.transform(links, normalize_telegram)
        linked = F.when((F.size(named) > 0) | hidden, _linked_telegrams(html)).otherwise(targets)
        return F.concat(named, F.when(F.size(links) > 0, linked).otherwise(no_names))

    found = F.struct(telegrams_in_text(text).alias("named"), F.filter(hrefs, is_telegram_link).alias("links"))
    return dedupe_telegrams(let(found, lambda v: all_of(v["named"], v["links"])))


def _from_page(html: StrCol, read: Callable[[Column, Column, Column], Column]) -> Column:
    """``read(text, hrefs, html)`` of a page, with each of the three derived once."""
    return let(
        F.struct(
            page_text(html).alias("text"),
            page_links(html).alias("hrefs"),
            text_or_empty(html).alias("html"),
        ),
        lambda p: read(p["text"], p["hrefs"], p["html"]),
    )


def page_emails(html: StrCol) -> Column:
    return _from_page(html, lambda text, hrefs, _: emails_of(text, hrefs))


def page_telegrams(html: StrCol) -> Column:
    return _from_page(html, telegrams_of)


def page_phones(html: StrCol) -> Column:
    return _from_page(html, lambda text, hrefs, _: phones_of(text, hrefs))


def page_contacts(html: StrCol) -> Column:
    """Struct of site name, emails, telegrams and phones of a page.

    For a table of pages ``operators.pages.with_contacts`` does the same in
    steps of columns, which Spark compiles to better code.
    """
    return F.struct(
        page_title(html).alias("site_name"),
        page_emails(html).alias("emails"),
        page_telegrams(html).alias("telegrams"),
        page_phones(html).alias("phones"),
    )

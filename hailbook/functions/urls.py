"""URL columns: normalising, classifying and resolving links.

``parse_url`` is not used: it is strict and gives NULL for blanks, pipes and
other characters that real site lists and hrefs contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hailbook.constants import (
    CONTACT_KEYWORDS,
    CONTACT_PATHS,
    DEFAULT_MAX_LINKS,
    DEFAULT_MAX_PAGES,
    LINKS_PER_PAGE,
)
from hailbook.functions.text import StrCol, col, let, strings_or_empty, strip, text_or_empty

# RFC 3986, appendix B, with the scheme limited to legal scheme characters.
URL_PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
)
LAST_PARAMS = r";[^/]*\z"
# No dot or empty segments, parameters, query or fragment.
PLAIN_FOLDER = r"^https?://[^/?#\s]+(?:/[^/?#;.\s][^/?#;\s]*)*/\z"
NOT_A_PAGE = r"^(?:mailto:|tel:|javascript:|#)"

# References that a base only stands in front of: no dot segments, none of the
# marks without anything behind them, which get lost, no tabs or line breaks.
_CHARS = r"[^/?#;\t\r\n]"
_NO_DOTS = r"(?!\.\.?(?:[/?#;]|\z))"
_PARAMS = rf"(?:;{_CHARS}++)*+"
_REST = r"(?:\?[^#\t\r\n]++)?+(?:#[^\t\r\n]++)?+\z"
PLAIN_ROOTED = rf"\A(?!//)(?:/{_NO_DOTS}{_CHARS}*+{_PARAMS})++{_REST}"
PLAIN_NETLOC = rf"\A//[^/?#\t\r\n]++(?:/{_CHARS}*+{_PARAMS})*+{_REST}"
# A colon in the first segment may end a scheme; inner segments are not empty.
PLAIN_RELATIVE = (
    rf"\A{_NO_DOTS}[^/?#:;\x00-\x20][^/?#:;\t\r\n]*+{_PARAMS}"
    rf"(?:/{_NO_DOTS}{_CHARS}++{_PARAMS})*+/?+{_REST}"
)
PLAIN_FRAGMENT = r"\A#[^\t\r\n]*+\z"
FOREIGN_SCHEME = r"(?i)\A(?!https?:)[a-z][a-z0-9+.-]*+:"
# The path of a base whose folder has no dot or empty segments.
PLAIN_PATH = r"\A(?:/(?:(?!\.\.?/)[^/]++/)*+[^/]*+)?+\z"
# Group 1 is the address of a URL without parameters and brackets.
PLAIN_ADDRESS = r"\A(https?://[^?#;\[\]\t\r\n]*+)(?:[?#]|\z)"


def _drop_unsafe(url: Column) -> Column:
    """URL parsers ignore tabs and line breaks wherever they stand."""
    return let(
        url,
        lambda u: F.when(
            u.contains("\t") | u.contains("\r") | u.contains("\n"), F.translate(u, "\t\r\n", "")
        ).otherwise(u),
    )


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, group)


def _bad_brackets(netloc: Column) -> Column:
    return netloc.contains("[") != netloc.contains("]")


# Optional scheme, then a host in which brackets are either both there or not.
_HOST = (
    r"(?is)\A(?:https?://)?+"
    r"(?:(?=[^/?#\[\]]*+(?:[/?#]|\z))|(?=[^/?#]*\[)(?=[^/?#]*\]))([^/?#]*)"
)


def normalize_url(raw: StrCol) -> Column:
    """Lowercase scheme and host, https by default, path only, ``/`` dropped."""
    value = strip(raw)
    path = _drop_unsafe(F.regexp_extract(value, _HOST + "([^?#]*)", 2))
    return F.when(
        value.rlike(_HOST.replace(r"\A", r"\A(?=.)")),
        F.concat(
            F.when(value.rlike("(?i)^http://"), F.lit("http://")).otherwise(F.lit("https://")),
            normalize_domain(raw),
            # Parameters of the last segment go, and a path that is only "/".
            F.regexp_replace(path, r"\A/(?:;[^/]*)?\z|;[^/]*\z", ""),
        ),
    ).otherwise(F.lit(""))


def domain_of(url: StrCol) -> Column:
    """Host part, lowercased, of a URL that is already normalised."""
    return F.lower(F.regexp_extract(col(url), "^[a-z]+://([^/?#]*)", 1))


def normalize_domain(raw: StrCol) -> Column:
    """Host (with port and ``www.``) of the normalised URL."""
    return F.lower(_drop_unsafe(F.regexp_extract(strip(raw), _HOST, 1)))


def is_http_url(url: StrCol) -> Column:
    return text_or_empty(url).rlike(r"(?i)^https?://")


def is_relative_url(url: StrCol) -> Column:
    """True unless the value starts with one of six non-relative prefixes."""
    return ~text_or_empty(url).rlike(r"(?i)^(?:https?://|mailto:|tel:|javascript:|#)")


def is_page_link(href: StrCol) -> Column:
    """Non-empty and not a mail, phone, script or same-page link."""
    return let(strip(href), lambda h: (h != "") & ~F.lower(h).rlike(NOT_A_PAGE))


def is_of_domain(url: StrCol, domain: Column) -> Column:
    """For many URLs against one ``domain``, which is normalised once."""
    return normalize_domain(url) == domain


def is_same_domain(left: StrCol, right: StrCol) -> Column:
    return is_of_domain(right, normalize_domain(left))


def has_contact_keyword(url: StrCol) -> Column:
    return F.lower(text_or_empty(url)).rlike("|".join(CONTACT_KEYWORDS))


def url_parts(url: Column) -> Column:
    """Struct of scheme, netloc, path, params, query and fragment."""

    def of_path(u: Column, full_path: Column) -> Column:
        has_params = full_path.contains(";")
        return F.struct(
            F.lower(_part(u, 1)).alias("scheme"),
            _part(u, 2).alias("netloc"),
            F.when(has_params, F.regexp_replace(full_path, LAST_PARAMS, ""))
            .otherwise(full_path)
            .alias("path"),
            F.when(
                has_params,
                F.substring(F.regexp_extract(full_path, "(" + LAST_PARAMS + ")", 1), 2, 1 << 30),
            )
            .otherwise(F.lit(""))
            .alias("params"),
            _part(u, 4).alias("query"),
            _part(u, 5).alias("fragment"),
        )

    cleaned = _drop_unsafe(F.regexp_replace(url, r"\A[\x00-\x20]+", ""))
    return let(cleaned, lambda u: let(_part(u, 3), lambda full_path: of_path(u, full_path)))


def _optional(mark: str, value: Column) -> Column:
    return F.when(value == "", F.lit("")).otherwise(F.concat(F.lit(mark), value))


def _assemble(
    scheme: Column,
    netloc: Column,
    path: Column,
    params: Column,
    query: Column,
    fragment: Column,
) -> Column:
    rooted = F.when((path == "") | path.startswith("/"), path).otherwise(
        F.concat(F.lit("/"), path)
    )
    return F.concat(
        scheme,
        F.lit("://"),
        netloc,
        rooted,
        _optional(";", params),
        _optional("?", query),
        _optional("#", fragment),
    )


def _is_dot(segment: Column) -> Column:
    return segment.isin(".", "..")


def _joined_without_dots(segments: Column) -> Column:
    """RFC 3986 dot-segment removal over an array of path segments, which come back joined.

    What is kept is a string with a slash in front of every segment: appending
    to an array in each step takes several times as long.
    """

    def parent(kept: Column) -> Column:
        last = F.length(F.substring_index(kept, "/", -1))
        return F.substring(kept, F.lit(1), F.length(kept) - last - 1)

    kept = F.aggregate(
        segments,
        F.lit(""),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", parent(acc)).otherwise(F.concat(acc, F.lit("/"), s)),
    )
    closed = F.when(_is_dot(F.element_at(segments, -1)), F.concat(kept, F.lit("/"))).otherwise(kept)
    return F.when(F.exists(segments, _is_dot), F.substring(closed, 2, 1 << 30)).otherwise(
        F.array_join(segments, "/")
    )


def _merge_path(base_path: Column, path: Column) -> Column:
    """Resolve a non-empty reference path against the path of its base."""

    def relative(parts: Column) -> Column:
        # Empty segments inside a relative result are dropped; the first and
        # the last element carry the leading and the trailing slash.
        last = F.size(parts) - 1
        return F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == last))

    directory = F.regexp_replace(base_path, r"[^/]+\z", "")
    base_segments = F.when(
        base_path.contains("/") | (base_path == ""),
        F.when(base_path.endswith("/") | (base_path == ""), F.split(base_path, "/", -1)).otherwise(
            let(F.split(directory, "/", -1), lambda d: F.slice(d, 1, F.size(d) - 1))
        ),
    ).otherwise(F.array().cast("array<string>"))
    own = F.split(path, "/", -1)
    segments = F.when(path.startswith("/"), own).otherwise(
        let(F.concat(base_segments, own), relative)
    )
    return let(
        let(segments, _joined_without_dots),
        lambda joined: F.when(joined == "", F.lit("/")).otherwise(joined),
    )


def resolve(base: Column, href: Column) -> Column:
    """RFC 3986 reference resolution; ``base`` is a :func:`url_parts` struct."""

    def against(ref: Column) -> Column:
        foreign = (ref["scheme"] != "") & (ref["scheme"] != base["scheme"])
        no_path = (ref["path"] == "") & (ref["params"] == "")
        return (
            F.when(foreign | ~base["scheme"].isin("http", "https"), href)
            .when(
                ref["netloc"] != "",
                _assemble(
                    base["scheme"],
                    ref["netloc"],
                    ref["path"],
                    ref["params"],
                    ref["query"],
                    ref["fragment"],
                ),
            )
            .when(
                no_path,
                _assemble(
                    base["scheme"],
                    base["netloc"],
                    base["path"],
                    base["params"],
                    F.when(ref["query"] == "", base["query"]).otherwise(ref["query"]),
                    ref["fragment"],
                ),
            )
            .otherwise(
                _assemble(
                    base["scheme"],
                    base["netloc"],
                    _merge_path(base["path"], ref["path"]),
                    ref["params"],
                    ref["query"],
                    ref["fragment"],
                )
            )
        )

    return let(url_parts(href), against)


def _base(url: Column) -> Column:
    """What the references of one page share: the parts of its URL, and what plain references go behind.

    ``root`` ends before the path, ``folder`` behind its last slash, ``page``
    before the fragment. They only count when ``is_http``, which is never NULL.
    """

    def of_parts(parts: Column) -> Column:
        root = F.concat(parts["scheme"], F.lit("://"), parts["netloc"])
        folder = F.when(
            parts["path"].rlike(PLAIN_PATH),
            F.concat(root, F.lit("/"), F.regexp_replace(parts["path"], r"\A/|[^/]+\z", "")),
        ).otherwise(
            # All plain references get the same in front of them as this one.
            let(resolve(parts, F.lit("x")), lambda u: F.substring(u, F.lit(1), F.length(u) - 1))
        )
        page = _assemble(*[parts[name] for name in ("scheme", "netloc", "path", "params", "query")], F.lit(""))
        is_http = F.coalesce(parts["scheme"].isin("http", "https"), F.lit(False))
        return F.struct(
            parts.alias("parts"),
            is_http.alias("is_http"),
            root.alias("root"),
            F.when(is_http, folder).alias("folder"),
            page.alias("page"),
        )

    return let(url_parts(url), of_parts)


def _absolute(base: Column, href: Column) -> Column:
    """A stripped href joined to its :func:`_base`; only hrefs that are not plain are taken apart."""

    def plain(pattern: str) -> Column:
        return base["is_http"] & href.rlike(pattern)

    return (
        F.when(href == "", F.lit(""))
        .when(is_http_url(href), href)
        .when(plain(PLAIN_ROOTED), F.concat(base["root"], href))
        .when(plain(PLAIN_RELATIVE), F.concat(base["folder"], href))
        .when(plain(FOREIGN_SCHEME), href)
        .when(plain(PLAIN_FRAGMENT), F.when(href == "#", base["page"]).otherwise(F.concat(base["page"], href)))
        .when(plain(PLAIN_NETLOC), F.concat(base["parts"]["scheme"], F.lit(":"), href))
        .otherwise(resolve(base["parts"], href))
    )


def absolute_urls(base_url: StrCol, hrefs: StrCol) -> Column:
    """:func:`absolute_url` of every href of one page; the base is taken apart once."""
    return let(_base(col(base_url)), lambda base: F.transform(col(hrefs), lambda h: let(strip(h), lambda v: _absolute(base, v))))


def absolute_url(base_url: StrCol, href: StrCol) -> Column:
    """An absolute http(s) href as it is, anything else joined to the base."""
    return F.get(absolute_urls(base_url, F.array(col(href))), F.lit(0))


def page_address(url: Column) -> Column:
    """``scheme://host/path`` of an http(s) URL, the empty string for others."""

    def address(p: Column) -> Column:
        return F.when(
            p["scheme"].isin("http", "https") & ~_bad_brackets(p["netloc"]),
            F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"]),
        ).otherwise(F.lit(""))

    def of_url(u: Column) -> Column:
        return let(
            F.regexp_extract(u, PLAIN_ADDRESS, 1),
            lambda found: F.when(found != "", found).otherwise(let(url_parts(u), address)),
        )

    return let(url, of_url)


def internal_links(
    base_url: StrCol, hrefs: StrCol, max_links: int = DEFAULT_MAX_LINKS
) -> Column:
    """First ``max_links`` distinct pages of the base's own domain."""
    base_url = col(base_url)

    def of_base(base: Column) -> Column:
        pages = F.transform(
            F.filter(F.transform(strings_or_empty(hrefs), strip), is_page_link),
            lambda h: page_address(_absolute(base["base"], h)),
        )
        own = F.filter(F.array_distinct(pages), lambda u: (u != "") & is_of_domain(u, base["domain"]))
        return F.slice(own, 1, max_links)

    return let(
        F.struct(_base(base_url).alias("base"), normalize_domain(base_url).alias("domain")),
        of_base,
    )


def contact_path_urls(base_url: StrCol) -> Column:
    """The usual contact paths, placed below the path of ``base_url``."""
    folder = F.concat(F.rtrim(col(base_url), F.lit("/")), F.lit("/"))
    # One reference is resolved; the others differ in the last segment only.
    # Below a plain folder there is nothing to resolve.
    prefix = F.when(folder.rlike(PLAIN_FOLDER), folder).otherwise(
        F.regexp_replace(absolute_url(folder, F.lit("x")), r"x\z", "")
    )
    return let(
        prefix, lambda p: F.array(*[F.concat(p, F.lit(path)) for path in CONTACT_PATHS])
    )


def _not_the_page(urls: Column, base_url: Column) -> Column:
    return let(
        F.rtrim(base_url, F.lit("/")),
        lambda base: F.filter(urls, lambda u: F.rtrim(u, F.lit("/")) != base),
    )


def candidate_urls(
    base_url: StrCol, hrefs: StrCol | None, max_pages: int = DEFAULT_MAX_PAGES
) -> Column:
    """Pages worth a visit: contact paths, likely links, then other links.

    The contact paths lie below the base, so none of them is the base itself
    and they fill every list of up to ``len(CONTACT_PATHS)`` entries. Links
    found on the page are only read for longer lists; pass ``hrefs=None`` when
    the list is not longer.
    """
    base_url = col(base_url)
    paths = contact_path_urls(base_url)
    if max_pages <= len(CONTACT_PATHS):
        return F.slice(paths, 1, max_pages)
    links = internal_links(base_url, hrefs, max_pages * LINKS_PER_PAGE)
    ranked = let(
        links,
        lambda found: F.concat(
            F.filter(found, has_contact_keyword),
            F.filter(found, lambda u: ~has_contact_keyword(u)),
        ),
    )
    every = F.array_distinct(F.concat(paths, ranked))
    return F.slice(_not_the_page(every, base_url), 1, max_pages)

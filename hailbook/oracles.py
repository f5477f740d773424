"""The registered queries once more, as DuckDB SQL over the same tables.

Written from the meaning of each operator, not from the Spark code: regular
expressions here are RE2, lists are DuckDB lists, and pages are read with
simpler patterns that are enough for well-formed html.
"""

from __future__ import annotations

from hailbook.constants import CONTACT_KEYWORDS, CONTACT_PATHS
from hailbook.derived import view_sql

# --- SQL snippets ---------------------------------------------------------------


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def decode(x: str) -> str:
    for found, char in (("&#64;", "@"), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"')):
        x = f"replace({x}, '{found}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def trim_edges(x: str) -> str:
    return rf"""regexp_replace({strip(x)}, '^[.,;:()\[\]{{}}<>"'']+|[.,;:()\[\]{{}}<>"'']+$', '', 'g')"""


def url(x: str) -> str:
    full = (
        f"(case when regexp_matches(lower({strip(x)}), '^https?://') then {strip(x)} "
        f"else concat('https://', {strip(x)}) end)"
    )
    head = r"^([A-Za-z]+://[^/?#]*)"
    path = (
        rf"regexp_replace(regexp_extract({full}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), "
        rf"';[^/]*$', '')"
    )
    return (
        f"(case when {strip(x)} = '' then '' else concat(lower(regexp_extract({full}, '{head}', 1)), "
        f"case when {path} = '/' then '' else {path} end) end)"
    )


def domain(x: str) -> str:
    return f"regexp_extract({url(x)}, '^[a-z]+://([^/?#]*)', 1)"


def email(x: str) -> str:
    return f"lower({trim_edges(x)})"


def phone(x: str) -> str:
    digits = rf"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (
        f"(case when length({digits}) = 11 and left({digits}, 1) in ('7', '8') "
        f"then concat('+7', substr({digits}, 2)) else '' end)"
    )


def telegram(x: str) -> str:
    raw = trim_edges(x)
    name = (
        f"(case when regexp_matches({raw}, '(?i)^https?://(www\\.)?(t\\.me|telegram\\.me)[/?#]') "
        f"then regexp_replace(regexp_extract({raw}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') "
        f"when regexp_matches({raw}, '(?i)^https?://') then '' "
        f"when regexp_matches({raw}, '(?i)^(t|telegram)\\.me/') "
        f"then substr({raw}, strpos({raw}, '/') + 1) else {raw} end)"
    )
    word = rf"regexp_replace({name}, '[^\pL\pN_]', '', 'g')"
    return f"(case when {word} = '' then '' else concat('@', lower({word})) end)"


def each(values: str, function) -> str:
    return f"list_transform({values}, lambda v: {function('v')})"


def unique(values: str) -> str:
    """First-seen order without empty strings, through an ordered aggregate."""
    return (
        f"list_reduce(list_filter({values}, lambda v: v <> ''), "
        f"lambda acc, v: case when list_contains(acc, v) then acc else list_append(acc, v) end, "
        f"[]::varchar[])"
    )


def text_of(html: str) -> str:
    markup = "(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>"
    nodes = f"string_split(regexp_replace({html}, '{markup}', chr(1), 'g'), chr(1))"
    parts = f"list_transform({nodes}, lambda n: {strip(decode('n'))})"
    return f"array_to_string(list_filter({parts}, lambda n: n <> ''), ' ')"


def hrefs_of(html: str) -> str:
    opaque = "(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
    shown = f"regexp_replace({html}, '{opaque}', '', 'g')"
    raw = f"""regexp_extract_all({shown}, '(?is)<a\\s[^>]*?href="([^"]*)"', 1)"""
    return f"list_transform({raw}, lambda h: {strip(decode('h'))})"


def title_of(html: str) -> str:
    inner = f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title', 1)"
    return clean(decode(inner))


# The patterns and paths that decide results.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+7|8)\s*\(?\s*9\d{2}\s*\)?[\s-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}"
LINK = r"(?i)https?://(?:www\.)?(?:t\.me|telegram\.me)/([A-Za-z0-9_]{3,32})"
CONTEXT = (
    r"(?i)(?:telegram(?:\s+(?:channel|group))?\s*:?\s*|tg\s*:?\s*)"
    r"@([A-Za-z][A-Za-z0-9_]{2,31})\b"
)


def emails_in(text: str) -> str:
    return each(f"regexp_extract_all({text}, '{EMAIL}')", email)


def phones_in(text: str) -> str:
    return each(f"regexp_extract_all({text}, '{PHONE}')", phone)


def telegrams_in(text: str) -> str:
    found = (
        f"list_concat(regexp_extract_all({text}, '{LINK}', 1), "
        f"regexp_extract_all({text}, '{CONTEXT}', 1))"
    )
    return f"list_transform({found}, lambda v: concat('@', lower(v)))"


def linked(hrefs: str, scheme: str) -> str:
    matching = f"list_filter({hrefs}, lambda h: starts_with(lower(h), '{scheme}'))"
    return f"list_transform({matching}, lambda h: substr(h, {len(scheme) + 1}))"


def joined(values: str) -> str:
    return f"array_to_string({values}, '|')"


def listed(values: str) -> str:
    return f"array_to_string({values}, '; ')"


def is_telegram(h: str) -> str:
    return (
        f"(contains(lower({h}), 't.me/') or contains(lower({h}), 'telegram.me/') "
        f"or starts_with({h}, '@'))"
    )


def found_contacts(source: str, keys: str) -> str:
    """Contacts of each page of ``source`` as lists, next to ``keys``."""
    # Anchors whose own text names a handle all link to Telegram here, and what
    # they name is part of the page text already, so order alone is at stake.
    targets = each(f"list_filter(hrefs, lambda h: {is_telegram('h')})", telegram)
    return f"""
      select {keys}, title as site_name,
        {unique(f"list_concat({emails_in('body')}, {each(linked('hrefs', 'mailto:'), email)})")} as emails,
        {unique(f"list_concat({telegrams_in('body')}, {targets})")} as telegrams,
        {unique(f"list_concat({phones_in('body')}, {each(linked('hrefs', 'tel:'), phone)})")} as phones
      from (select {keys}, {text_of('html')} as body, {hrefs_of('html')} as hrefs,
        {title_of('html')} as title from {source}) parsed_{source}"""


def lists(separator=joined) -> str:
    return ", ".join(f"{separator(c)} as {c}" for c in ("emails", "telegrams", "phones"))


# --- named parts ------------------------------------------------------------------


def _absolute(base: str, href: str) -> str:
    """Reference resolution for the links of the test tables."""
    root = f"regexp_extract({base}, '^([a-z]+://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    folder = f"concat({root}, regexp_replace(case when {path} = '' then '/' else {path} end, '[^/]*$', ''))"
    target = (
        f"(case when {href} = '' then '' "
        f"when regexp_matches({href}, '(?i)^https?://') then {href} "
        f"when regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {href} "
        f"when starts_with({href}, '//') then concat(regexp_extract({base}, '^([a-z]+:)', 1), {href}) "
        f"when starts_with({href}, '/') then concat({root}, {href}) "
        f"when starts_with({href}, '#') then concat(regexp_replace({base}, '#.*$', ''), {href}) "
        f"else concat({folder}, {href}) end)"
    )
    return rf"regexp_replace(regexp_replace({target}, '/[a-z]+/\.\./', '/'), '/\./', '/')"


def _page(target: str) -> str:
    return (
        f"regexp_replace(regexp_replace({target}, '[?#].*$', ''), ';[^/]*$', '')"
    )


def _internal(base: str, hrefs: str, limit: int) -> str:
    kept = f"list_filter({hrefs}, lambda h: h <> '' and not regexp_matches(lower(h), '^(mailto:|tel:|javascript:|#)'))"
    pages = f"list_transform({kept}, lambda h: {_page(_absolute(base, 'h'))})"
    own = f"list_filter({pages}, lambda u: starts_with(u, 'http') and {domain('u')} = {domain(base)})"
    return f"list_slice({unique(own)}, 1, {limit})"


def _folder(base: str) -> str:
    slashed = f"concat(rtrim({base}, '/'), '/')"
    return f"regexp_replace(regexp_replace({slashed}, '[?#].*$', ''), '[^/]*$', '')"


def _candidates(base: str, hrefs: str | None, limit: int) -> str:
    fixed = "[" + ", ".join(f"concat({_folder(base)}, '{p}')" for p in CONTACT_PATHS) + "]"
    if hrefs is None:
        return f"list_slice({fixed}, 1, {limit})"
    links = _internal(base, hrefs, 3 * limit)
    likely = f"regexp_matches(lower(u), '{'|'.join(CONTACT_KEYWORDS)}')"
    every = unique(
        f"list_concat({fixed}, list_filter({links}, lambda u: {likely}), "
        f"list_filter({links}, lambda u: not {likely}))"
    )
    return (
        f"list_slice(list_filter({every}, lambda u: rtrim(u, '/') <> rtrim({base}, '/')), 1, {limit})"
    )


PARTS: dict[str, str] = {
    name: view_sql(name) for name in ("contact_pages", "responses", "messy", "raw_sites", "processed")
}
PARTS["sites"] = f"""
  select min(position) as position, site from (
    select position, {url('value')} as site from raw_sites) s where site <> '' group by site"""
PARTS["done"] = f"select distinct {domain('value')} as domain from processed"
PARTS["todo"] = f"select * from sites where {domain('site')} not in (select domain from done)"
PARTS["accepted"] = """
  select * replace (coalesce(final_url, requested_url) as final_url) from responses where status_code < 400 and (contains(lower(content_type), 'html')
    or contains(lower(content_type), 'text/plain'))"""
PARTS["attempts"] = """
  select site, 0 as attempt, site as requested_url from todo
  union all
  select site, 1, concat('http://', substr(site, 9)) from todo where starts_with(site, 'https://')"""
PARTS["entries"] = """
  select site, requested_url, final_url as site_url from (
    select site, a.requested_url, final_url,
      row_number() over (partition by site order by attempt) as nth
    from attempts a join accepted r on a.requested_url = r.requested_url) t where nth = 1"""
PARTS["links"] = f"""
  select url, unnest(hrefs) as href, generate_subscripts(hrefs, 1) - 1 as pos from (
    select url, {hrefs_of('html')} as hrefs from (
      select url, html from pages
      union all select concat(root, path), html from contact_pages) p) h"""
PARTS["internal"] = f"""
  select url, unnest(found) as link, generate_subscripts(found, 1) - 1 as pos from (
    select url, {_internal('url', 'hrefs', 20)} as found from (
      select url, {hrefs_of('html')} as hrefs from (
        select url, html from pages
        union all select concat(root, path), html from contact_pages) p) h) f"""
PARTS["candidates"] = f"select *, {_candidates('site_url', None, 10)} as candidates from entries"
PARTS["deep"] = f"""
  select site, requested_url, site_url, {_candidates('site_url', 'hrefs', 12)} as candidates from (
    select e.*, {hrefs_of('html')} as hrefs from entries e
    join accepted r on e.requested_url = r.requested_url) h"""


def _visited(source: str) -> str:
    return f"""
  select site, pos, r.final_url as url, html,
    row_number() over (partition by site, r.final_url order by pos) as nth
  from (select site, 0 as pos, requested_url from {source}
    union all
    select site, generate_subscripts(candidates, 1) as pos, unnest(candidates) from {source}) l
  join accepted r on l.requested_url = r.requested_url"""


PARTS["visited"] = f"select * from ({_visited('candidates')}) v where nth = 1"
PARTS["deep_visited"] = f"select * from ({_visited('deep')}) v where nth = 1"
PARTS["contacts"] = found_contacts("visited", "site, pos, url")
PARTS["deep_contacts"] = found_contacts("deep_visited", "site, pos, url")
PARTS["folded"] = """
  select site, first(url order by pos) as site_url,
    coalesce(first(site_name order by pos) filter (where site_name <> ''), '') as site_name,
    flatten(list(emails order by pos)) as emails,
    flatten(list(telegrams order by pos)) as telegrams,
    flatten(list(phones order by pos)) as phones
  from contacts group by site"""

USES = {
    "responses": ("contact_pages",),
    "sites": ("raw_sites",),
    "done": ("processed",),
    "todo": ("sites", "done"),
    "accepted": ("responses",),
    "attempts": ("todo",),
    "entries": ("attempts", "accepted"),
    "links": ("contact_pages",),
    "internal": ("contact_pages",),
    "candidates": ("entries",),
    "deep": ("entries",),
    "visited": ("candidates",),
    "deep_visited": ("deep",),
    "contacts": ("visited",),
    "deep_contacts": ("deep_visited",),
    "folded": ("contacts",),
}


def _with(select: str, *parts: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for used in USES.get(name, ()):
            add(used)
        if name not in needed:
            needed.append(name)

    for name in parts:
        add(name)
    if not needed:
        return select
    return "with " + ",\n".join(f"{n} as {'materialized ' * (n == 'deep')}({PARTS[n]})" for n in needed) + "\n" + select


def _exploded(name: str, key: str, values: str, source: str) -> str:
    return (
        f"select {key}, generate_subscripts(found, 1) - 1 as pos, unnest(found) as {name} "
        f"from (select {key}, {values} as found from {source}) t"
    )


def _result_row() -> str:
    emails = unique(each("[email, lower(email), ' ']", email))
    telegrams = unique(each("[telegram, '@Other']", telegram))
    phones = unique(each("[phone, '8 912 000 11 22']", phone))
    return (
        f"{clean('title')} as site_name, {listed(emails)} as emails, "
        f"{listed(telegrams)} as telegrams, {listed(phones)} as phones, {clean('url')} as url"
    )


def _report() -> str:
    columns = ", ".join(
        f"{listed(unique(each(c, f)))} as {c}"
        for c, f in (("emails", email), ("telegrams", telegram), ("phones", phone))
    )
    return f"select site, {clean('site_name')} as site_name, {columns}, site_url as url from folded"


def _page_contacts(column: str) -> str:
    return (
        f"select site_id, pos, {joined(column)} as {column} "
        f"from ({found_contacts('contact_pages', 'site_id, pos')}) c"
    )


# --- one statement per query --------------------------------------------------------

ORACLES: dict[str, str] = {
    "normalize_url": f"select page_id, {url('url')} as normalized from pages",
    "normalize_domain": f"select page_id, {domain('url')} as domain from pages",
    "normalize_email": _with(f"select id, {email('email')} as value from messy", "messy"),
    "normalize_telegram": _with(f"select id, {telegram('telegram')} as value from messy", "messy"),
    "normalize_phone": _with(f"select id, {phone('phone')} as value from messy", "messy"),
    "clean_whitespace": f"select doc_id, {clean('text')} as cleaned from documents",
    "as_array": _with(
        "select id, telegram as one, case when telegram = '' then 0 else 1 end as size, "
        "0 as none from messy",
        "messy",
    ),
    "decode_entities": f"select page_id, {decode('html')} as decoded from pages",
    "decode_references": """select o_orderkey as id,
        concat('n', chr((65 + o_orderkey % 26)::int), ' h', chr((97 + o_custkey % 26)::int), ' ',
        ['é', '…', 'Ω', '«'][o_orderkey % 4 + 1], ' &none', o_custkey % 10, ' &lt; R & D') as decoded
        from orders""",
    "page_title": f"select page_id, {title_of('html')} as title from pages",
    "page_text": f"select page_id, {text_of('html')} as body from pages",
    "dedupe_emails": _with(
        f"select id, {joined(unique(each(chr(91) + 'email, lower(email), concat(chr(120), email)' + chr(93), email)))}"
        " as found from messy",
        "messy",
    ),
    "dedupe_telegrams": _with(
        f"select id, {joined(unique(each('[telegram, upper(telegram), ' + repr('@news') + ']', telegram)))}"
        " as found from messy",
        "messy",
    ),
    "dedupe_phones": _with(
        f"select id, {joined(unique(each('[' + repr('89120001122') + ', phone]', phone)))}"
        " as found from messy",
        "messy",
    ),
    "result_rows": _with(f"select id, {_result_row()} from messy", "messy"),
    "saved_results": _with(f"select {_result_row()} from messy", "messy"),
    "existing_result_urls": _with(f"select distinct {clean('url')} as url from messy", "messy"),
    "emails_text": _exploded("email", "doc_id", unique(emails_in("text")), "documents"),
    "phones_text": _exploded("phone", "doc_id", unique(phones_in("text")), "documents"),
    "telegrams_text": _with(
        _exploded("telegram", "id", unique(telegrams_in("note")), "messy"), "messy"
    ),
    "page_emails": _with(_page_contacts("emails"), "contact_pages"),
    "page_telegrams": _with(_page_contacts("telegrams"), "contact_pages"),
    "page_phones": _with(_page_contacts("phones"), "contact_pages"),
    "page_contacts": _with(
        f"select site_id, pos, site_name, {lists()} "
        f"from ({found_contacts('contact_pages', 'site_id, pos')}) c",
        "contact_pages",
    ),
    "page_contacts_web": f"select page_id, site_name, {lists()} "
    f"from ({found_contacts('pages', 'page_id')}) c",
    "page_links": _with("select url, pos, href from links", "links"),
    "link_classes": _with(
        f"""select url, pos, regexp_matches(href, '(?i)^https?://') as is_http,
        not regexp_matches(href, '(?i)^(https?://|mailto:|tel:|javascript:|#)') as is_relative,
        href <> '' and not regexp_matches(href, '(?i)^(mailto:|tel:|javascript:|#)') as is_page,
        {is_telegram('href')} as is_telegram from links""",
        "links",
    ),
    "absolute_links": _with(
        f"select url, pos, {_absolute('url', 'href')} as target from links", "links"
    ),
    "same_domain_links": _with(
        f"""select * from (select url, pos, {_absolute('url', 'href')} as target from links) t
        where {domain('url')} = {domain('target')}""",
        "links",
    ),
    "internal_links": _with("select url, pos, link from internal", "internal"),
    "link_priority": _with(
        "select url, pos, link, regexp_matches(lower(link), "
        f"'{'|'.join(CONTACT_KEYWORDS)}') as likely from internal",
        "internal",
    ),
    "read_site_lines": _with(
        f"select {strip('value')} as value from raw_sites where {strip('value')} <> ''", "raw_sites"
    ),
    "clean_sites": _with("select position, site from sites", "sites"),
    "saved_sites": _with("select site as value from sites", "sites"),
    "saved_lines": _with(f"select {clean('title')} as value from messy", "messy"),
    "processed_domains": _with("select domain from done", "done"),
    "appended_domains": _with(
        f"select domain from done union select {domain('site')} from todo", "todo"
    ),
    "next_processed_state": _with(
        f"select domain from done union select {domain('site')} from todo", "todo"
    ),
    "page_source": "select url as requested_url, url as final_url, 200 as status_code, "
    "'text/html' as content_type, html from pages",
    "ordered_distinct": "select source, min(doc_id) as doc_id from documents group by source",
    "sites_to_process": _with("select position, site from todo", "todo"),
    "accepted_pages": _with(
        "select requested_url, final_url, status_code, content_type from accepted", "accepted"
    ),
    "entry_pages": _with("select site, requested_url, site_url from entries", "entries"),
    "frontier": _with(
        "select site, generate_subscripts(candidates, 1) - 1 as pos, unnest(candidates) as url "
        "from deep",
        "deep",
    ),
    "checked_urls": _with(
        f"select site, {joined('list_concat([site_url], candidates)')} as checked_urls "
        "from candidates",
        "candidates",
    ),
    "crawl_status": _with(
        """select position, t.site, coalesce(site_url, '') as site_url,
        coalesce(len(candidates) + 1, 0) as checked, site_url is not null as success
        from todo t left join candidates c on t.site = c.site""",
        "candidates",
    ),
    "site_pages": _with(
        f"select site, pos, url, site_name, {joined('emails')} as emails from deep_contacts",
        "deep_contacts",
    ),
    "site_contacts": _with(
        f"select site, site_url, site_name, {lists()} from folded", "folded"
    ),
    "site_contact_counts": _with(
        """select site, count(*) as pages, sum(len(emails)) as emails,
        sum(len(telegrams)) as telegrams, sum(len(phones)) as phones
        from contacts group by site""",
        "contacts",
    ),
    "site_report": _with(_report(), "folded"),
    "site_report_from_store": _with(_report(), "folded"),
    "run_summary": _with(
        """select (select count(*) from sites) as total_sites,
        (select count(*) from entries) as success_sites,
        (select count(*) from sites) - (select count(*) from todo) as skipped_sites,
        (select count(*) from todo) - (select count(*) from entries) as failed_sites""",
        "entries",
    ),
    "incremental_pages": f"""select page_id, url, site_name, {joined('emails')} as emails
        from ({found_contacts('pages', 'page_id, url')}) c
        where not ends_with({domain('url')}, '.org')""",
}

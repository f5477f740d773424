"""Emails, Telegram handles and Russian mobile numbers: normalise and find.

Patterns are written for Java regex with explicit Unicode classes, so that
results do not hang on regex flags. Possessive quantifiers and run-start
anchors keep the scan linear on long junk runs without changing any match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hailbook.constants import EDGE_PUNCTUATION, TELEGRAM_HOSTS, WORD, WS
from hailbook.functions.text import StrCol, let, strip, text_or_empty, unique_non_empty
from hailbook.functions.urls import LAST_PARAMS

_LOCAL = r"[A-Za-z0-9._%+-]"

# local@domain.tld between word boundaries. A run of local-part characters is
# entered once, at its start (or where the last match ended); from there the
# first boundary inside the run is where the address begins.
EMAIL = (
    rf"(?:\G|(?<!{_LOCAL}))"
    rf"(?:(?<={WORD})[A-Za-z0-9_]*+(?=[.%+-])|(?<!{WORD})[.%+-]*+(?=[A-Za-z0-9_]))"
    rf"({_LOCAL}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?!{WORD}))"
)

TELEGRAM_LINK = r"(?iu)https?://(?:www\.)?(?:t\.me|telegram\.me)/([A-Za-z0-9_]{3,32})"

TELEGRAM_CONTEXT = (
    rf"(?iu)(?:telegram(?:{WS}++(?:channel|group))?{WS}*+:?+{WS}*+|tg{WS}*+:?+{WS}*+)"
    rf"(@[A-Za-z][A-Za-z0-9_]{{2,31}}+)(?!{WORD})"
)

_GAP = rf"(?:{WS}|-)*+"
MOBILE_PHONE = (
    rf"((?:\+7|8){WS}*+\(?+{WS}*+9\p{{Nd}}{{2}}{WS}*+\)?+{_GAP}"
    rf"\p{{Nd}}{{3}}{_GAP}\p{{Nd}}{{2}}{_GAP}\p{{Nd}}{{2}})"
)


def _trim_edges(value: StrCol) -> Column:
    return F.btrim(strip(value), F.lit(EDGE_PUNCTUATION))


def normalize_email(value: StrCol) -> Column:
    """Trim blanks, then punctuation, and lowercase; nothing is validated."""
    return F.lower(_trim_edges(value))


def normalize_telegram(value: StrCol) -> Column:
    """A handle, a Telegram link or a bare word as ``@name``; else empty."""
    link_pattern = r"(?i)^https?://([^/?#]*)([^?#]*)"

    def of_link(link: Column) -> Column:
        host = F.lower(F.regexp_extract(link, link_pattern, 1))
        path = F.regexp_replace(F.regexp_extract(link, link_pattern, 2), LAST_PARAMS, "")
        return F.when(host.isin(*TELEGRAM_HOSTS), path).otherwise(F.lit(""))

    def name(raw: Column) -> Column:
        return (
            # Tabs and line breaks inside a link do not count.
            F.when(raw.rlike(r"(?i)^https?://"), let(F.translate(raw, "\t\r\n", ""), of_link))
            .when(
                raw.rlike(r"(?i)^(?:t|telegram)\.me/"), F.regexp_replace(raw, r"^[^/]*/", "")
            )
            .otherwise(raw)
        )

    # Deleting every non-word character also removes leading @ and slashes.
    word = F.lower(F.regexp_replace(let(_trim_edges(value), name), rf"[^\p{{L}}\p{{N}}_]+", ""))
    return let(word, lambda w: F.when(w == "", F.lit("")).otherwise(F.concat(F.lit("@"), w)))


def normalize_phone(value: StrCol) -> Column:
    """Eleven digits starting with 7 or 8 as ``+7…``; anything else empty."""
    digits = F.regexp_replace(text_or_empty(value), r"[^\p{Nd}]+", "")
    return let(
        digits,
        lambda d: F.when(
            (F.length(d) == 11) & d.rlike("^[78]"), F.concat(F.lit("+7"), F.substring(d, 2, 10))
        ).otherwise(F.lit("")),
    )


def dedupe_emails(values: StrCol) -> Column:
    return unique_non_empty(values, normalize_email)


def dedupe_telegrams(values: StrCol) -> Column:
    return unique_non_empty(values, normalize_telegram)


def dedupe_phones(values: StrCol) -> Column:
    return unique_non_empty(values, normalize_phone)


def _find(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def _find_if(text: Column, sign: Column, found: Column) -> Column:
    """Skip the regex when a sign that every match needs is not there."""
    return F.when(sign, found).otherwise(F.array().cast("array<string>"))


def emails_in_text(text: StrCol) -> Column:
    text = text_or_empty(text)
    return _find_if(text, text.contains("@"), dedupe_emails(_find(text, EMAIL)))


def telegrams_in_text(text: StrCol) -> Column:
    """All link matches first, then all handles named in Telegram context."""
    text = text_or_empty(text)

    def found(low: Column) -> Column:
        # A link needs "://" and ".me/", a handle in context "@" and one of two words.
        links = _find_if(text, low.contains("://") & low.contains(".me/"), _find(text, TELEGRAM_LINK))
        context = low.contains("@") & (low.contains("tg") | low.contains("telegram"))
        return F.concat(links, _find_if(text, context, _find(text, TELEGRAM_CONTEXT)))

    sign = text.contains("@") | text.contains("://")
    names = F.transform(let(F.lower(text), found), lambda v: F.concat(F.lit("@"), v))
    return _find_if(text, sign, dedupe_telegrams(names))


def phones_in_text(text: StrCol) -> Column:
    text = text_or_empty(text)
    sign = text.contains("8") | text.contains("+7")
    return _find_if(text, sign, dedupe_phones(_find(text, MOBILE_PHONE)))

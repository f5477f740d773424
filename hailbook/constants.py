"""They decide results, so they are stated here as plain text."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

TELEGRAM_HOSTS = ("t.me", "www.t.me", "telegram.me", "www.telegram.me")

CONTACT_PATHS = (
    "contacts",
    "contact",
    "about",
    "about-us",
    "company",
    "support",
    "help",
    "customer-service",
    "feedback",
    "team",
)

CONTACT_KEYWORDS = ("contact", "about", "support", "help", "team", "company")

RESULT_COLUMNS = ("site_name", "emails", "telegrams", "phones", "url")

# Characters trimmed from both ends of an email address or a Telegram value.
EDGE_PUNCTUATION = ".,;:()[]{}<>\"'"

LIST_SEPARATOR = "; "
DEFAULT_MAX_PAGES = 10
DEFAULT_MAX_LINKS = 20
# Links read from an entry page before ranking: this many per page to visit.
LINKS_PER_PAGE = 3

# --- end of fixed values ----------------------------------------------------

# Unicode whitespace, once as the characters for btrim and once as a Java class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
# A word character as Unicode letters, numbers and underscore. Java's (?U)\w
# also takes combining marks, so it is not used.
WORD = r"[\p{L}\p{N}_]"

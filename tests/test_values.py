"""Value functions: golden rows, and the standard library on odd ones."""

import random

import pytest
from pyspark.sql import functions as F

from hailbook.functions import contacts, text, urls
from tests import page_model as model

GOLDEN = [
    (urls.normalize_url, "example.com", "https://example.com"),
    (urls.normalize_url, " HTTPS://Example.COM/test ", "https://example.com/test"),
    (urls.normalize_domain, "https://WWW.Example.com/test", "www.example.com"),
    (contacts.normalize_email, " INFO@Example.COM, ", "info@example.com"),
    (contacts.normalize_telegram, "@Example_Channel", "@example_channel"),
    (contacts.normalize_telegram, "https://t.me/Example_Channel/", "@example_channel"),
    (contacts.normalize_telegram, "https://example.com/contact", ""),
    (contacts.normalize_telegram, "https://t.me/joinchat/AA", "@joinchataa"),
    (contacts.normalize_telegram, "//t.me/foo", "@tmefoo"),
    (contacts.normalize_telegram, "t.me/foo?start=1", "@foostart1"),
    (contacts.normalize_phone, "+7 999 123 45 67", "+79991234567"),
    (contacts.normalize_phone, "8 (999) 123-45-67", "+79991234567"),
    (contacts.normalize_phone, "+7 495 123 45 67", "+74951234567"),
    (contacts.normalize_phone, "12345", ""),
    (text.clean_whitespace, "  Hello   world \n\x1d test  ", "Hello world test"),
]

ODD_URLS = [
    *("", "  ", "x", "x/", "/", "//h/p", "http://", "https:///p", "HTTP://A.b/C?d#e", "a.b;p", "a.b/;p"),
    *("a.b/c;p/d;q", "a.b/c/", "u:P@H.com:80/x", "https://ex ample.com/a b", "https://h.com/a|b"),
    *("ht\ttp://x/y", "http://x/a\tb\n", " http://x ", "ftp://h/x", "mailto:a@b", "é.рф/Ж"),
    *("http:/x", "https:x", "x?y/z", "x#y/z", "https://www.X.com/", "http://[::1]/a"),
]


@pytest.mark.parametrize("function", dict.fromkeys(f for f, _, _ in GOLDEN))
def test_golden(evaluate, function):
    cases = [(value, wanted) for f, value, wanted in GOLDEN if f is function]
    assert evaluate(lambda: function("value"), [v for v, _ in cases]) == [w for _, w in cases]


@pytest.mark.parametrize(
    ("function", "expected"),
    [(urls.normalize_url, model.url), (urls.normalize_domain, model.domain)],
)
def test_urls_equal_the_model(evaluate, function, expected):
    rng = random.Random(3)
    pieces = ["http://", "HTTPS://", "/", "?", "#", ";", "a.B", ":8", "@", " ", "\t", "..", "é", "x"]
    values = ODD_URLS + ["".join(rng.choices(pieces, k=rng.randrange(8))) for _ in range(2000)]
    found = evaluate(lambda: function("value"), values)
    assert list(zip(values, found)) == [(v, expected(v)) for v in values]


def test_bad_brackets_and_null_are_empty(evaluate):
    assert evaluate(lambda: urls.normalize_url("value"), ["http://[x/y", (None,)]) == ["", ""]
    assert evaluate(lambda: urls.normalize_domain("value"), ["http://x]/y", (None,)]) == ["", ""]


@pytest.mark.parametrize(
    ("function", "expected"),
    [
        (contacts.normalize_email, model.email),
        (contacts.normalize_telegram, model.telegram),
        (contacts.normalize_phone, model.phone),
    ],
)
def test_values_equal_the_model(evaluate, function, expected):
    rng = random.Random(5)
    pieces = [*" .,;()<>\"'@/?#;\t_é²٣", "http://", "HTTPS://", "t.me", "www.telegram.me/", "Ab", "8", "912345", "6789"]
    values = ["".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(3000)]
    found = evaluate(lambda: function("value"), values)
    assert list(zip(values, found)) == [(v, expected(v)) for v in values]


BASES = ["https://h.com", "https://h.com/", "http://h.com/a/b;p?q#f", "https://H.com/a//b/", "https://h.com/x/../y/."]
HREFS = [
    *("", " ", "x", "x/y", "/x", "/", "./x", "../x", "../../../x", "x/../y", "x/..", ".", "..", "/../x", "a//b", "/a//b"),
    *("?q", "?", "#f", "#", ";p", "x;p?q#f", "//o.com/z", "//o.com", "http://o.com/a/../b", "HTTP://O.com"),
    *("https:z", "http:z", "ftp://f/x", "mailto:a@b", "javascript:0", "data:x", "x:y", "a b", "a\tb", "é", "x?a=../b", "./", "../"),
]


def test_links_resolve_as_the_standard_library_does(evaluate):
    pairs = [(base, href) for base in BASES for href in HREFS]
    found = evaluate(lambda: urls.absolute_url("base", "href"), pairs, "base string, href string")
    assert list(zip(pairs, found)) == [(p, model.absolute(*p)) for p in pairs]


@pytest.mark.parametrize("limit", [1, 10, 12, 40])
def test_candidates_equal_the_model(evaluate, limit):
    contact = ["/Contact-us", "help/x", "https://h.com/about", "//H.com/P;v", "https://h.com", "y/"]
    rows = [(base, HREFS + contact) for base in [*BASES, "https://h.com/team/", "https://h.com/en?x=/1"]]
    schema = "base string, hrefs array<string>"
    found = evaluate(lambda: urls.candidate_urls("base", "hrefs", limit), rows, schema)
    assert found == [model.candidates(base, [h.strip() for h in hrefs], limit) for base, hrefs in rows]


def test_arrays(evaluate):
    values = [(["b", " a ", "b", "", None, "a"],), (None,)]
    schema = "v array<string>"
    assert evaluate(lambda: text.join_unique("v"), values, schema) == ["b; a", ""]
    assert evaluate(lambda: text.as_array("v"), values[1:], schema) == [[]]
    assert evaluate(lambda: text.as_list("value"), ["abc", (None,)]) == [["abc"], []]
    assert evaluate(lambda: text.unique_in_order("v"), [(["a", "b", "a"],)], schema) == [["a", "b"]]


def test_dedupe_keeps_first_seen_order(evaluate):
    rows = [(["+7 999 123 45 67", "8 (999) 123-45-67", "+7 912 000 11 22"],)]
    assert evaluate(lambda: contacts.dedupe_phones("v"), rows, "v array<string>") == [
        ["+79991234567", "+79120001122"]
    ]
    rows = [(["@Example", "https://t.me/example", "t.me/another_one", "https://x.com/y"],)]
    assert evaluate(lambda: contacts.dedupe_telegrams("v"), rows, "v array<string>") == [
        ["@example", "@another_one"]
    ]


def test_link_predicates(evaluate):
    hrefs = ["HTTP://x", "ftp://x", "Mailto:a", "tel:1", "javascript:0", "#a", "", "/x"]
    assert evaluate(lambda: F.struct(
        urls.is_http_url("value"), urls.is_relative_url("value"), urls.is_page_link("value")
    ), hrefs) == [
        (True, False, True), (False, True, True), (False, False, False), (False, False, False),
        (False, False, False), (False, False, False), (False, True, False), (False, True, True),
    ]


def test_the_links_of_a_page_resolve_as_each_alone_does(evaluate):
    """Plain references go behind a part of the base as they are, all others are taken apart."""
    base = "http://x.org/a/../b/c;p?q=1#f"
    expected = {
        "": "", "HTTP://y": "HTTP://y", "/d/e;v?x#y": "http://x.org/d/e;v?x#y", "d/": "http://x.org/b/d/",
        "d//e": "http://x.org/b/d/e", "../d/./..": "http://x.org/", "/d/../e/.": "http://x.org/e/", "d;?#": "http://x.org/b/d",
        "..;p": "http://x.org/;p", "//Y.org/d?": "http://Y.org/d", "//Y.org/../d": "http://Y.org/../d",
        "mailto:d": "mailto:d", "http:d": "http://x.org/b/d", "1:d": "http://x.org/b/1:d", "?z": "http://x.org/a/../b/c;p?z",
        "#": "http://x.org/a/../b/c;p?q=1", "#z": "http://x.org/a/../b/c;p?q=1#z", "/d\t/e": "http://x.org/d/e", " d ": "http://x.org/b/d",
    }
    rows = [(base, [*expected]), ("mailto:x", ["a", "/b"]), (None, ["", "a", "#b"])]
    found = evaluate(lambda: urls.absolute_urls("base", "hrefs"), rows, "base string, hrefs array<string>")
    assert dict(zip(expected, found[0], strict=True)) == expected
    assert found[1:] == [["a", "/b"], ["", None, None]]
    pairs = [(base, href) for href in expected]
    assert evaluate(lambda: urls.absolute_url("base", "href"), pairs, "base string, href string") == found[0]


def test_a_bound_value_makes_no_array(spark):
    bound = spark.range(1).select(text.let(F.col("id") + 1, lambda v: v * v).alias("out"))
    assert "array(" not in bound._jdf.queryExecution().optimizedPlan().toString()
    assert bound.first()["out"] == 1

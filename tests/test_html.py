"""Page functions against golden values and the standard library model."""

import html as stdlib
import random
import time

import pytest
from pyspark.sql import functions as F

from hailbook.functions import contacts, entities, html
from tests import page_model as model

PAGES = [
    "",
    "plain text 8 912 345 67 89",
    "<title>  Example   Site  </title>",
    "<title></title><title>second</title>",
    "<p>no title</p>",
    "<title>A &amp; B<br>C</title>x",
    "<!-- <title>no</title> --><script><title>no</title></script><title>yes</title>",
    "<b>info</b>@x.com and <i>a@b.org</i>",
    "info&#64;x.com &#x40; &copy; &nbsp;x&nbsp; &unknown; &amp;lt; &#150; &#0; & && &;",
    "&copy2020 &amp&lt x &notit; &euro; &#1114112; &#xD800; &NotEqualTilde; a",
    "<p>a<!-- c@d.com -->b<script>e@f.com</script><style>g@h.com</style></p>",
    "<SCRIPT type='a>b'>x@y.com</SCRIPT >after",
    "<img alt='<script>'>shown<img alt=\"<!-- \">too",
    "<template><p>hid@x.com</p><a href='/in-template'>t</a></template>shown",
    "a<template>x<template>y</template>z</template>b",
    "<ruby>k<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>ji",
    "<![CDATA[in@cdata.com]]> <?php no@php.com ?><!DOCTYPE html>",
    "1 < 2 and 3 > 2 <3 </p> </ p>end",
    '<a href="mailto:Sales@Example.org?subject=Hi">m</a><a href=" MAILTO: (x@y.com) ">m</a>',
    "<a href='tel:8 (912) 345-67-89'>c</a><A HREF=TEL:+79120001122>d</A>",
    '<a href="https://t.me/Chan_1/">x</a><a href="/about.me/y">z</a><a href="https://about.me/q">w</a>',
    '<a href="https://t.me/joinchat/AA">tg: @inside</a><a href="/x">Telegram: @outside_1</a>',
    '<a href="@handle">h</a><a name="n">no href</a><a href>empty</a><a href="">none</a>',
    '<a title="a > b" data-href="/no" href="/yes">y</a><a href=/bare>b</a><a href="/1" href="/2">d</a>',
    '<a href="?a=1&copy=2&amp;b=3&lt&#x41;&notit;">e</a><a\nhref\n=\n"/nl">n</a>',
    "<a href='/x'>one<a href='/y'>two</a>three</a>",
    "<area href='/no'><abbr href='/no'>x</abbr><a/href='/slash'>s</a>",
    "Telegram: @one1, telegram channel @two2 tg:@thr TG @four_4! telegram group : @five5",
    "mention @nobody and t.me/bare https://t.me/ab https://telegram.me/abcé http://www.t.me/Xyz123",
    "8 912 345 67 89 +7(912)345-67-89 189991234567 8 912 345 67 8",
    "éinfo@x.com info@x.comé .a-b@c.org -x@y.com a@b.c@d.com a@b.com-x@y.org a@b.com.",
    "<p>unclosed <b>tag\n\n  spread </p>   <div>x </div> ",
    "<svg><title>svg</title></svg><title>late</title>",
]


@pytest.mark.parametrize(
    ("function", "expected"),
    [
        (html.page_text, model.text),
        (html.page_title, model.title),
        (html.page_links, model.links),
        (html.page_emails, model.emails),
        (html.page_telegrams, model.telegrams),
        (html.page_phones, model.phones),
    ],
)
def test_pages_equal_the_model(evaluate, function, expected):
    found = evaluate(lambda: function("value"), PAGES)
    # NUL and lone surrogates are no characters of a Spark string.
    legal = [p.replace("&#0;", "\ufffd").replace("&#xD800;", "\ufffd") for p in PAGES]
    wanted = [expected(page) for page in legal]
    # Hrefs that are present but empty are no links.
    found = [[h for h in f if h] if expected is model.links else f for f in found]
    assert list(zip(PAGES, found)) == list(zip(PAGES, wanted))


def test_whole_page(evaluate):
    page = (
        "<title>\n Kiln &amp; Clay\tLtd </title><ul><li>Orders: Orders@Kiln.test;<li>"
        '<a href="mailto:glaze@kiln.test">Glaze desk</a><li><a href="https://t.me/kiln_news">news</a>'
        '<li><a href="tel:8 (921) 000-11-22">ring</a></ul>'
    )
    (row,) = evaluate(lambda: html.page_contacts("value"), [page])
    assert row.asDict() == {
        "site_name": "Kiln & Clay Ltd",
        "emails": ["orders@kiln.test", "glaze@kiln.test"],
        "telegrams": ["@kiln_news"],
        "phones": ["+79210001122"],
    }


def test_null_page_is_empty(evaluate):
    (row,) = evaluate(lambda: html.page_contacts("value"), [(None,)])
    assert row.asDict() == {"site_name": "", "emails": [], "telegrams": [], "phones": []}


def test_unclosed_code_and_comment_hide_the_rest(evaluate):
    found = evaluate(lambda: html.page_text("value"), ["a<script>b", "a<style>b<p>c", "a<!-- b"])
    assert found == ["a", "a", "a"]


def test_tail_without_a_closing_bracket_is_text(evaluate):
    pages = ["x<b y", "x</b", "<p>a</p>b<a href='/x", "a<!-- b", "<b>1</b><!x <?y", "<title>T</title", "<script>s</script>t<u"]
    found = evaluate(lambda: F.struct(html.page_text("value"), html.page_title("value")), pages)
    assert [tuple(f) for f in found] == [
        ("x<b y", ""), ("x</b", ""), ("a b<a href='/x", ""), ("a", ""), ("1 <!x <?y", ""),
        ("T</title", "T"), ("t<u", ""),
    ]


@pytest.mark.parametrize("depth", range(1, 13))
def test_templates_of_any_depth_equal_the_model(evaluate, depth):
    nested = "<template>" * depth + "in" + "</template>" * (depth - 1)
    pages = [f"a{nested}</template>b", f"a{nested}late</template>end", f"a{nested}open", f"</template>{nested}</template></template>z"]
    assert evaluate(lambda: html.page_text("value"), pages) == [model.text(p) for p in pages]


JUNK = ["<b ", "</x ", "<a ", "<!x ", "<?x ", "<![CDATA[", '<a b="', "<template>", "<title", "<!--", "a-", ". "]


def test_junk_takes_time_in_proportion(evaluate):
    def read():
        found = html.page_text("value"), html.page_title("value"), html.page_links("value"), html.page_telegrams("value")
        return F.array(*[F.length(F.concat_ws("", f)) for f in found])

    def seconds(page):
        start = time.perf_counter()
        evaluate(read, [(page,)])
        return time.perf_counter() - start

    seconds("<p>warm</p>")
    for piece in JUNK:
        # some seconds for the four functions; where time grew with the square, 90 KB took over a minute
        assert seconds(piece * ((1 << 20) // len(piece))) < 40, piece


def test_long_junk_has_no_contacts(evaluate):
    junk = ["a-" * 50_000, "8" + " " * 50_000, "<a " * 20_000, "." * 50_000 + "@", "<!--" * 90_000]
    assert evaluate(lambda: F.size(html.page_emails("value")), junk) == [0] * len(junk)
    assert evaluate(lambda: F.size(html.page_phones("value")), junk) == [0] * len(junk)


def test_telegram_links_on_random_pages_equal_the_model(evaluate):
    pieces = [
        *("<a href='https://t.me/one_1'>", "<a href='@two'>", "<a href='/x'>", "</a>", "<b>", "</b>", " ", "tg", "tg: "),
        *("@name1", "@name1tg @name2", "Telegram:", "https://t.me/inner_3", "text", "<template>", "</template>", "<i>"),
    ]
    pages = random_strings(pieces, 3000, 12)
    found = evaluate(lambda: html.page_telegrams("value"), pages)
    def hidden_link(page):  # a link inside a template is a link all the same, but what it says is not seen
        return "<template>" in page
    same = [(p, f) for p, f in zip(pages, found) if not hidden_link(p)]
    assert same == [(p, model.telegrams(p)) for p, _ in same]


def random_strings(pieces, count, longest):
    rng = random.Random(7)
    return ["".join(rng.choices(pieces, k=rng.randrange(longest))) for _ in range(count)]


@pytest.mark.parametrize(
    ("function", "expected"),
    [
        (contacts.emails_in_text, model.text_emails),
        (contacts.telegrams_in_text, model.text_telegrams),
        (contacts.phones_in_text, model.text_phones),
    ],
)
def test_text_extraction_on_random_text(evaluate, function, expected):
    pieces = [*"aZé9_.%+-@ \n\u00a0()", "x.com", "tg", "telegram", "@abc", "https://t.me/"]
    texts = random_strings([*pieces, "8", "+7", "912", "345", "67"], 5000, 24)
    found = evaluate(lambda: function("value"), texts)
    assert list(zip(texts, found)) == [(t, expected(t)) for t in texts]


def test_attribute_references_equal_unescape(evaluate):
    pieces = "& # x 65 41 ; amp lt copy notit euro 128 a = &# &#x nbsp".split() + [" "]
    values = random_strings(pieces, 5000, 10)
    found = evaluate(lambda: entities.decode_attribute("value"), values)
    assert list(zip(values, found)) == [(v, stdlib.unescape(v)) for v in values]


@pytest.mark.parametrize(
    ("function", "expected"),
    [
        (html.page_text, model.text),
        (html.page_links, model.links),
        (html.page_title, model.title),
        (html.page_emails, model.emails),
    ],
)
def test_random_markup_equals_the_model(evaluate, function, expected):
    pieces = [
        *("<p>", "</p>", "<b>", "<br>", "<br/>", "<a href='/x'>", "<a href=y>", "</a>", "<td>"),
        *("<!--c-->", "<script>s</script>", "<style>t</style>", "<title>T</title>", "&amp;"),
        *("&#64;", "x@y.com", "tg:@name1", "<i a='>'>", "<img src=x>", " ", "\n", "text", "a < b"),
        *("<a href='mailto:M@y.com'>", '<a class="k" href="/q?a=1&amp;b=2">', "<!DOCTYPE html>"),
    ]
    pages = random_strings(pieces, 2000, 14)
    found = evaluate(lambda: function("value"), pages)
    assert list(zip(pages, found)) == [(p, expected(p)) for p in pages]


def test_unknown_names_cost_little(evaluate):
    page = "".join(f"&zz{n};" for n in range(16_000))
    evaluate(lambda: F.length(entities.decode_text("value")), ["&amp;"])
    start = time.perf_counter()
    (size,) = evaluate(lambda: F.length(entities.decode_text("value")), [(page,)])
    assert size == len(page) - 16_000 and time.perf_counter() - start < 4


def test_markup_without_text_between_is_one_border(spark):
    """Fewer matches, the same text: blanks around markup never count."""
    page = "<p>a <b>b</b> <!-- c - -- > \n<script>d</ script><i></script>\t<RT>e</ruby></p>f g  <template>h</template>"
    row = spark.createDataFrame([(page,)], "html string").select(
        F.regexp_count("html", F.lit(html.MARKUP)).alias("n"), html.page_text("html").alias("text")
    ).first()
    assert (row["n"], row["text"]) == (4, "a b f g")


def test_values_without_references_are_not_split(evaluate):
    values = ["a", "", None, "a&amp;b", "&", "&copy2"]
    assert evaluate(lambda: entities.decode_text("value"), values) == ["a", "", "", "a&b", "&", "&copy2"]
    assert evaluate(lambda: entities.decode_attribute("value"), values) == ["a", "", "", "a&b", "&", "©2"]

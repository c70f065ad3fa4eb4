"""Inputs whose length alone once cost hours, and pages whose frame is a form."""

import time

from parcelwise.llm import htmltext, secrets


def test_unmatched_end_tags_take_seconds():
    start = time.monotonic()
    lines, marked = htmltext.read_lines("<div>" * 100_000 + "</x>" * 100_000 + "<p>a  b</p>" + "<form>" * 50_000)
    assert lines == ["a b"] and not marked and time.monotonic() - start < 20


def test_forms_and_unseen_elements():
    page = (
        "<body><form id=aspnetForm><nav>menu</nav><article><h1>T</h1><p>a<script>x</script>b<style>y</style> c</p>"
        "<form><p>Leave a reply</p><input></form></article><button>go</button></form></body>"
    )
    assert htmltext.read_lines(page) == (["T", "ab c"], True)
    assert htmltext.read_lines("<p>x</p><form><p>Your name</p><input></form><p>y</p>")[0] == ["x", "y"]


def test_furniture_by_all_its_parts():
    bad = ["ad-slot", "wp-block-advert", "post-comments", "comments-section", "reader-comments", "cookie-bar", "newsletter-signup", "comment_form"]
    good = ["elementor-widget-text-editor", "post-content", "content no-sidebar", "has-share", "article-header", "widget", "post"]
    page = "<article><p>text</p>" + "".join(f'<div class="{c}">bad</div>' for c in bad) + "".join(f'<div class="{c}">{c}</div>' for c in good)
    assert htmltext.read_lines(page) == (["text", *good], True)


def test_words_of_many_marks(spark):
    word = "1" + "." * 200_000 + "a"
    rows = [(1, word), (2, f"token={word}"), (3, "token=abc.def..."), (4, 'key = "ab12cd34ef56ab78"),'), (5, "." * 200_000 + "1")]
    start = time.monotonic()
    found = secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc", "name", "value").collect()
    assert time.monotonic() - start < 60
    assert sorted(tuple(r) for r in found) == [(1, "", word), (2, "token", word), (3, "token", "abc.def"), (4, "", "ab12cd34ef56ab78"), (5, "", rows[4][1])]

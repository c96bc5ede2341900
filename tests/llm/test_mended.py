"""Rows and paragraphs that were once lost."""

import pytest

from featloom.llm import html_text, language, simhash


def test_a_repeated_id_does_not_lose_a_text(spark):
    rows = [
        (1, "alpha beta gamma delta", 1, "a"), (1, "completely other words in here", 2, "b"),
        (2, "completely other words in here", 3, "c"), (2, "completely other words in here", 3, "c"),
        (None, "alpha beta gamma delta", 4, "d"), (None, None, 5, "e"), (3, None, 6, "f"), (4, "", 7, "g"),
        (5, "stands alone among them all", 8, "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, __kept int, `text.key` string")
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted((r[0] is not None, r[0] or 0, r[1] or "", r[2]) for r in out.collect())
    assert got == [
        (False, 0, "", 5), (False, 0, "alpha beta gamma delta", 4), (True, 1, "alpha beta gamma delta", 1),
        (True, 1, "completely other words in here", 2), (True, 3, "", 6), (True, 5, "stands alone among them all", 8),
    ]


def test_ids_that_are_no_numbers_group(spark):
    rows = [("x", "one two three four"), ("a", "one two three four"), ("b", "nothing like it at all")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.group(docs).collect()) == [
        ("a", "a"), ("b", "b"), ("x", "a")
    ]


@pytest.mark.parametrize(("page", "text"), [
    ("<p title=it's>First paragraph.</p><p>We don't go.</p><p>End.</p>", "First paragraph. We don't go. End."),
    ("<article><h2 class='section-header'>Methods</h2><p>Body.</p><div class='related-work'>Others.</div></article>",
     "Methods Body. Others."),
    ("<article><p>Body.</p><div data-id='menu'>Dish of the day.</div></article>", "Body. Dish of the day."),
    ("<article><p>Body.</p><div class='wide comments'>I agree.</div></article><div class='page-footer'>Foot.</div>", "Body."),
    ('<p title="a > b">One</p><a href="x\'y">two</a> <b class=>three</b>', "One two three"),
    ("<p>5 < 6 and <em id='x\">y'>so on", "5 < 6 and so on"),
])
def test_text_of_a_page(spark, page, text):
    pages = spark.createDataFrame([(1, "http://h/x", page)], "page_id bigint, url string, html string")
    assert html_text.extract(pages).first().text == text


def test_numbers_are_no_letters():
    assert [language.letter_words(t) for t in ("² ½ Ⅷ 12", "x² and Ⅷ", "été")] == [[], ["x", "and"], ["été"]]

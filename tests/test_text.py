"""Scalar expressions: exact outputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.functions import dates, text, urls, variants
from gleanery.plans import views
from gleanery.sources import pages


def value(spark, column, given="", kind="string"):
    frame = spark.createDataFrame([(given,)], f"x {kind}")
    return frame.select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>First article description &amp; details.</p><p>Second&nbsp;paragraph.</p>",
         "First article description & details.\n\nSecond paragraph."),
        ("&amp;lt;b&gt;", "<b>"),
        ("a<BR/>b<h2 class='x'>c</h2>d", "a\n\nb\n\nc\n\nd"),
        ("<pre>no block</pre>", "no block"),
        ("x\r\n\r\n  y \t z\n", "x\n\ny z"),
        ("  　", None),
        ("<p> </p>", None),
        (None, None),
        ("don&#39;t &QUOT;x&quot;", "don't \"x\""),
    ],
)
def test_html_to_text(spark, html, expected):
    assert value(spark, text.html_to_text(F.col("x")), html) == expected


def test_white_space_is_unicode(spark):
    assert value(spark, text.collapse(F.col("x")), "﻿a   b　") == "a b"
    assert value(spark, text.strip(F.col("x")), "  a  b ") == "a  b"
    assert value(spark, text.is_present(F.col("x")), " \t") is False


def test_words_and_tokens(spark):
    assert value(spark, text.word_count(F.col("x")), "-- Élan 3 ... a-b _") == 3
    assert value(spark, text.title_prefix(F.col("x")), "A Primary AI item: follow-up") == "primary ai item"
    assert value(spark, text.title_prefix(F.col("x")), "Two words a") is None
    assert value(spark, text.slugify(F.col("x")), " How-to: Élan! ") == "how-to-lan"
    assert value(spark, text.slugify(F.col("x")), "日本") == ""


def test_first_group_number_needs_whole_ascii_words(spark):
    groups = [("report",), ("guide", "how to")]
    assert value(spark, text.first_group_number(F.col("x"), groups), "éreport") == 0
    assert value(spark, text.first_group_number(F.col("x"), groups), "reports how to") == 1
    assert value(spark, text.first_group_number(F.col("x"), groups), "guided") is None
    assert value(spark, text.first_group_number(F.col("x"), groups), "guide report") == 0


def test_sentences(spark):
    assert value(spark, text.sentences(F.col("x")), "One.  Two! three?\nFour.five ") == [
        "One.", "Two!", "three?", "Four.five",
    ]


def test_titles_ignore_case_but_not_accents(spark):
    assert value(spark, text.same_text(F.col("x"), F.lit("RESUME")), "resume") is True
    assert value(spark, text.same_text(F.col("x"), F.lit("resume")), "résumé") is False
    assert value(spark, text.labelled_by(F.col("x"), F.lit("My (title)")), "my (TITLE) — more") is True
    assert value(spark, text.labelled_by(F.col("x"), F.lit("My title")), "My titles: more") is False


def test_cuts(spark):
    assert value(spark, text.cut_at_word(F.col("x")), "a" * 100 + " " + "b" * 100) == "a" * 100 + "…"
    assert value(spark, text.cut_at_word(F.col("x")), "a " + "b" * 200) == "a " + "b" * 178 + "…"
    assert value(spark, text.cut_at_word(F.col("x")), "b" * 180) == "b" * 180
    assert value(spark, text.shorten_error(F.col("x")), "e" * 501) == "e" * 497 + "..."
    assert value(spark, text.shorten_error(F.col("x")), "e" * 500) == "e" * 500


def test_markdown_preview_drops_first_heading_only(spark):
    body = "intro\n# One\n\ntext [link](http://x) *b*\n# Two\nend"
    assert value(spark, text.markdown_preview(F.col("x")), body) == "intro text link b Two end"
    assert len(value(spark, text.markdown_preview(F.col("x")), "word " * 100)) <= 220


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Sun, 12 Apr 2026 10:30:00 GMT", "2026-04-12T10:30:00.000Z"),
        ("Fri, 12 Apr 2026 10:30:00 EST", "2026-04-12T15:30:00.000Z"),
        ("12 Apr 2026 10:30 +0200", "2026-04-12T08:30:00.000Z"),
        ("2026-04-14T03:00:00+02:00", "2026-04-14T01:00:00.000Z"),
        ("2026-04-14", "2026-04-14T00:00:00.000Z"),
        ("yesterday", None),
        (None, None),
    ],
)
def test_parse_date(spark, given, expected):
    assert value(spark, dates.iso_utc(dates.parse_date(F.col("x"))), given) == expected


def test_date_label(spark):
    when = dt.datetime(2024, 1, 3, 21, 5)
    assert value(spark, dates.label(F.col("x")), when, "timestamp") == "Jan 3, 2024, 9:05 PM"


@pytest.mark.parametrize(
    ("url", "normalized", "problem"),
    [
        (" HTTPS://Example.com/A?b=1#top ", "https://example.com/A?b=1", None),
        ("http://example.com:80", "http://example.com/", None),
        ("https://example.com:8443/a/../b/./c", "https://example.com:8443/b/c", None),
        ("https://example.com/a b", "https://example.com/a%20b", None),
        ("ftp://example.com/x", None, "scheme"),
        ("mailto:a@example.com", None, "scheme"),
        ("not a url", None, "bad"),
        ("https://", None, "bad"),
        ("https://exa mple.com", None, "bad"),
        ("https://example.com:99999/", None, "bad"),
        (None, None, "bad"),
    ],
)
def test_urls(spark, url, normalized, problem):
    assert value(spark, urls.normalize(F.col("x")), url) == normalized
    assert value(spark, urls.problem(F.col("x"), "bad", "scheme"), url) == problem


def test_variant_reads_are_typed(spark):
    doc = F.parse_json("x")
    given = '{"s":" a ","n":5,"z":null,"b":" ","d":1.5}'
    assert value(spark, variants.string(doc, "$.s"), given) == "a"
    assert value(spark, variants.string(doc, "$.n"), given) is None
    assert value(spark, variants.string(doc, "$.b"), given) is None
    assert value(spark, variants.number(doc, "$.d"), given) == 1.5
    assert value(spark, variants.number(doc, "$.s"), given) is None
    assert value(spark, variants.kind(doc, "$.z"), given) == "VOID"


def test_rounding_and_clamping(spark):
    assert value(spark, text.round_places(F.col("x"), 3), 0.8245, "double") == 0.825
    assert value(spark, text.unit_interval(F.col("x")), 1.4, "double") == 1.0
    assert value(spark, text.unit_interval(F.col("x")), None, "double") is None
    assert value(spark, text.two_decimals(F.col("x")), None, "double") is None
    assert value(spark, text.number_or(F.col("x"), F.lit(0.0)), float("nan"), "double") == 0.0


def test_preview_label(spark):
    label = views.preview_label(F.col("x"), F.lit(None), F.lit("t"))
    assert value(spark, label, "primary AI-feed") == "PA"
    assert value(spark, label, "/") == "IN"


def test_content_types(spark):
    assert value(spark, pages.is_html(F.col("x")), "text/html; charset=utf-8") is True
    assert value(spark, pages.is_html(F.col("x")), None) is False
    assert value(spark, pages.is_text(F.col("x")), "text/plain") is True

"""What a reader would see of an item: is it worth showing?

All texts are expected collapsed (text.collapse, null as empty); they are used
several times, so collapse them into a column first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.functions import text


def collapsed(value: Column) -> Column:
    return text.collapse(F.coalesce(value, F.lit("")))


def body_is_meaningful(content: Column) -> Column:
    """At least 280 characters, and 40 words in the first 360."""
    return (F.length(content) >= 280) & (text.word_count(F.substring(content, 1, 360)) >= 40)


def repeats_title(summary: Column, title: Column) -> Column:
    return (summary != "") & (title != "") & text.same_text(summary, title)


def echoes_title(summary: Column, title: Column) -> Column:
    """The title again, or the title as a label."""
    return (title != "") & (text.same_text(summary, title) | text.labelled_by(summary, title))


def summary_is_meaningful(summary: Column, title: Column) -> Column:
    """Long enough, and neither the title again, a greeting nor a promotion."""
    return (
        (F.length(summary) >= 40)
        & (text.word_count(summary) >= 6)
        & ~echoes_title(summary, title)
        & ~text.is_greeting(summary)
        & ~text.is_promotion(summary)
    )


def why_is_meaningful(value: Column) -> Column:
    return (F.length(value) >= 24) & (text.word_count(value) >= 4)


def is_standalone(summary: Column, title: Column) -> Column:
    """A summary that says more than the title."""
    return (summary != "") & ~echoes_title(summary, title)


def first_standalone_sentence(value: Column, title: Column) -> Column:
    """First sentence of 12 characters or more that fits as a summary."""

    def fits(part: Column) -> Column:
        return (
            (F.length(part) >= 12)
            & ~text.is_greeting(part)
            & ~text.is_promotion(part)
            & is_standalone(part, title)
        )

    return F.get(F.filter(text.sentences(value), fits), F.lit(0))

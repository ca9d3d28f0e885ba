"""String and number expressions shared by the operators (all JVM side)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from gleanery import fixed_values as V


# ---------------------------------------------------------------- white space
def strip(value: Column) -> Column:
    """Trim every kind of Unicode white space, not just U+0020."""
    return F.btrim(value, F.lit(V.SPACE_TEXT))


def strip_end(value: Column) -> Column:
    return F.rtrim(value, F.lit(V.SPACE_TEXT))


# White-space runs other than one plain space; those need no replacement.
_WIDE_SPACE = f"(?: {V.SPACE}|[{V.SPACE_CHARS}&&[^ ]]){V.SPACE}*"


def collapse(value: Column) -> Column:
    """White-space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(value, _WIDE_SPACE, " "))


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def first_present(*values: Column) -> Column:
    """First value that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(value) for value in values])


def is_present(value: Column) -> Column:
    return F.coalesce(value.rlike(V.NOT_SPACE), F.lit(False))


# ---------------------------------------------------------------- words
def slugify(value: Column) -> Column:
    dashed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def word_count(collapsed: Column) -> Column:
    """Space-separated parts that hold a letter or digit (input is collapsed)."""
    return F.regexp_count(collapsed, F.lit(r"[^ \p{L}\p{N}]*[\p{L}\p{N}][^ ]*"))


def title_tokens(title: Column) -> Column:
    """Lower-case letter or digit runs longer than one character."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(runs, lambda token: F.length(token) > 1)


def title_prefix(title: Column) -> Column:
    """First three title tokens, or null for shorter titles."""
    tokens = title_tokens(title)
    return F.when(F.size(tokens) >= 3, F.array_join(F.slice(tokens, 1, 3), " "))


def sentences(value: Column) -> Column:
    parts = F.split(value, f"(?<=[.!?]){V.SPACE}+")
    return F.filter(F.transform(parts, collapse), lambda part: part != "")


def distinct_present(values: Column) -> Column:
    """Collapsed, non-blank, first occurrence wins, order kept."""
    cleaned = F.transform(values, collapse)
    return F.array_distinct(F.filter(cleaned, lambda value: F.coalesce(value != "", F.lit(False))))


def contains_any(value: Column, words: tuple[str, ...]) -> Column:
    """One of the words occurs anywhere, also inside other words."""
    found = [F.contains(value, F.lit(word)) for word in words]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def first_group_number(value: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Number of the first group with a whole word in the text, null if none.

    The pattern is costly on long texts, so it runs only for groups of which some word
    occurs anywhere at all, in order until one is found.
    """

    def whole(words: Sequence[str]) -> Column:
        return value.rlike(V.WORD_START + "(?:" + "|".join(words) + ")" + V.WORD_END)

    numbers = [F.when(contains_any(value, tuple(words)) & whole(words), F.lit(number)) for number, words in enumerate(groups)]
    return F.coalesce(*numbers)


# ---------------------------------------------------------------- titles
def same_text(left: Column, right: Column) -> Column:
    """Equal when case is ignored and accents count."""
    return F.collate(left, "UNICODE_CI") == F.collate(right, "UNICODE_CI")


def labelled_by(text: Column, title: Column) -> Column:
    """Text is the title, a colon or dash, then more."""
    rest = F.substring(text, F.length(title) + 1, F.length(text))
    return F.startswith(F.lower(text), F.lower(title)) & rest.rlike(
        f"^{V.SPACE}*[:\\-–—]{V.SPACE}+"
    )


def is_greeting(text: Column) -> Column:
    return text.rlike(V.GREETING)


def is_promotion(text: Column) -> Column:
    return text.rlike(V.PROMOTION)


def is_roundup(title: Column) -> Column:
    return title.rlike(V.ROUNDUP_TITLE)


# ---------------------------------------------------------------- markup
def decode_entities(value: Column) -> Column:
    decoded = reduce(
        lambda text, entity: F.regexp_replace(text, "(?i)" + entity[0], entity[1]), V.ENTITIES, value
    )
    return F.when(F.contains(value, F.lit("&")), decoded).otherwise(value)


def html_to_text(html: Column) -> Column:
    """Readable text: blocks become paragraphs, other tags a space."""
    block = f"(?i)</?(?:{'|'.join(V.BLOCK_TAGS)}){V.WORD_END}[^>]*>"
    text = F.regexp_replace(strip(html), block, "\n")
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    text = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), "[ \t]+", " ")
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    return F.nullif(F.array_join(lines, "\n\n"), F.lit(""))


def has_markup(value: Column) -> Column:
    return F.coalesce(value.rlike("<[^>]+>"), F.lit(False))


def markdown_preview(body: Column, limit: int = 220) -> Column:
    heading = rf"(?s)\A(.*?)(?<![^{V.LINE_END_CHARS}])# [^{V.LINE_END_CHARS}]+\n+"
    text = F.regexp_replace(body, heading, "$1")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\(([^)]+)\)", "$1")
    text = collapse(F.regexp_replace(text, "[*_`>#-]", " "))
    return cut_with_ellipsis(text, limit)


def cut_with_ellipsis(text: Column, limit: int) -> Column:
    short = strip_end(F.substring(text, 1, limit - 1))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(short, F.lit(V.ELLIPSIS)))


def cut_at_word(text: Column, limit: int = 180, least: int = 80) -> Column:
    """Cut at the last space inside the limit when it lies far enough in."""
    head = F.substring(text, 1, limit + 1)
    last_space = F.length(head) - F.instr(F.reverse(head), " ")
    last_space = F.when(F.instr(head, " ") > 0, last_space).otherwise(F.lit(-1))
    kept = F.when(last_space < least, F.substring(text, 1, limit)).otherwise(
        F.substring(text, F.lit(1), last_space)
    )
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(strip_end(kept), F.lit(V.ELLIPSIS)))


def shorten_error(message: Column, limit: int = 500) -> Column:
    return F.when(F.length(message) <= limit, message).otherwise(
        F.concat(F.substring(message, 1, limit - 3), F.lit("..."))
    )


# ---------------------------------------------------------------- numbers
def unit_interval(value: Column) -> Column:
    """Clamp to 0..1; null stays null."""
    return F.when(value < 0, F.lit(0.0)).when(value > 1, F.lit(1.0)).otherwise(value)


def round_places(value: Column, places: int) -> Column:
    """Half up on the scaled double, the same on every engine."""
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def two_decimals(value: Column) -> Column:
    """Decimal label with two places."""
    return F.when(value.isNotNull(), F.format_string("%.2f", value))


def number_or(value: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(value), value), fallback)

"""Typed reads from JSON held as VARIANT: a value of another type is no value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.functions import text

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column, path: str) -> Column:
    return kind_of(at(value, path))


def is_number(kind_name: Column) -> Column:
    return F.coalesce(kind_name.isin(*_NUMBERS), F.lit(False))


def string(value: Column, path: str) -> Column:
    """Trimmed text, null when blank or not a text."""
    raw = F.try_variant_get(value, path, "string")
    return F.when(kind(value, path) == "STRING", text.blank_to_null(raw))


def raw_string(value: Column, path: str) -> Column:
    """Text as it is, null when not a text."""
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def number(value: Column, path: str) -> Column:
    return F.when(is_number(kind(value, path)), F.try_variant_get(value, path, "double"))


def duplicate_of(metadata: Column) -> Column:
    """The item a processing record nested in item metadata names as original; only a text counts."""
    return raw_string(metadata, "$.knowledgeProcessing.duplicateOfItemId")

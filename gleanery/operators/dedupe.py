"""Duplicate items by URL or title fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import text
from gleanery.operators.skew import lookup


def dedupe_key(*, empty_slug: str = "keep") -> Column:
    """``url:`` key of the canonical or conflicting URL, else ``text:`` key.

    Titles without Latin letters or digits have an empty slug and share one
    key. ``empty_slug="id"`` gives each such item its own key instead.
    """
    item = F.col("item_id").cast("string")
    url = text.first_present(F.col("canonical_url"), F.col("canonical_url_conflict"))
    fingerprint = text.first_present(F.col("title"), F.substring(F.col("content_text"), 1, 120))
    slug = text.slugify(text.collapse(F.coalesce(fingerprint, item)))
    if empty_slug == "id":
        slug = F.when(slug == "", item).otherwise(slug)
    return F.coalesce(F.concat(F.lit("url:"), F.lower(url)), F.concat(F.lit("text:"), slug))


def key_holders(items: DataFrame, *, empty_slug: str = "keep") -> DataFrame:
    """(dedupe_key, created_at, item_id): the first item of every key."""
    keyed = items.select(dedupe_key(empty_slug=empty_slug).alias("dedupe_key"), F.struct("created_at", "item_id").alias("h"))
    return keyed.groupBy("dedupe_key").agg(F.min("h").alias("h")).select("dedupe_key", "h.created_at", "h.item_id")


def find_duplicates(items: DataFrame, *, empty_slug: str = "keep", holders: DataFrame | None = None) -> DataFrame:
    """item_id, dedupe_key, key_copies, duplicate_of_item_id.

    The first item of a key (by created_at, then id) is the original. Matches
    of an item are the earlier items of its key; as a relation that is
    (dedupe_key, created_at, item_id), never a list per item, whose total size
    would be quadratic in the group. ``holders`` (see ``key_holders``) are the first
    items of keys outside ``items``; copies are counted in ``items`` alone.
    """
    keyed = items.select("item_id", "created_at", dedupe_key(empty_slug=empty_slug).alias("dedupe_key"))
    groups = keyed.groupBy("dedupe_key").agg(
        F.count("*").alias("key_copies"), F.min(F.struct("created_at", "item_id")).alias("first")
    )
    if holders is None:
        groups = groups.where("key_copies > 1")
    else:
        earlier = holders.select("dedupe_key", F.struct("created_at", "item_id").alias("_held"))
        groups = groups.join(earlier, "dedupe_key", "left").withColumn("first", F.least("first", "_held"))
    shared = groups.select("dedupe_key", "key_copies", F.col("first.item_id").alias("first_item_id"))
    found = lookup(
        keyed, shared, "dedupe_key", ["key_copies", "first_item_id"], weight="key_copies", spread=["item_id"]
    )
    original = F.col("first_item_id")
    return found.select(
        "item_id",
        "created_at",
        "dedupe_key",
        F.coalesce("key_copies", F.lit(1)).alias("key_copies"),
        F.when(original != F.col("item_id"), original).alias("duplicate_of_item_id"),
    )


def matched_items(found: DataFrame) -> DataFrame:
    """Members of every shared key in order; linear in the number of items."""
    return found.where("key_copies > 1").select("dedupe_key", "created_at", "item_id")


def settle_duplicates(items: DataFrame) -> DataFrame:
    """Duplicates carry no novelty and are not worth keeping."""
    copy = F.col("duplicate_of_item_id").isNotNull()
    return items.withColumn(
        "novelty_score", F.when(copy, F.lit(0.0)).otherwise(F.col("novelty_score"))
    ).withColumn(
        "preserve_recommendation",
        F.when(copy, F.lit("discard")).otherwise(F.col("preserve_recommendation")),
    )

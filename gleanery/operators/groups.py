"""Topic groups and memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import text
from gleanery.operators.skew import first_per_key


def group_id(tag: Column) -> Column:
    """Repeatable id of a topic group."""
    return F.sha2(F.concat(F.lit("topic:"), tag), 256)


def _assignments(enriched: DataFrame) -> DataFrame:
    """enriched: item_id, topic, at (when the topic was assigned)."""
    topic = text.blank_to_null(F.col("topic"))
    return enriched.select("item_id", "at", topic.alias("topic"), text.slugify(topic).alias("tag"))


def topic_groups(enriched: DataFrame) -> DataFrame:
    """One group per tag; the last title wins."""
    assigned = _assignments(enriched).where("topic is not null")
    groups = assigned.groupBy("tag").agg(
        F.max(F.struct("at", "item_id", "topic")).alias("last"), F.min("at").alias("created_at")
    )
    return groups.select(
        group_id(F.col("tag")).alias("group_id"),
        F.lit("topic").alias("group_type"),
        "tag",
        F.col("last.topic").alias("title"),
        F.concat(F.lit("Items related to "), F.col("last.topic"), F.lit(".")).alias("summary"),
        "created_at",
        F.col("last.at").alias("updated_at"),
    )


def topic_members(enriched: DataFrame) -> DataFrame:
    """The one membership of each item: its latest topic, none when blank."""
    latest = first_per_key(_assignments(enriched), ["item_id"], F.desc("at"), F.desc("topic"))
    return latest.where("topic is not null").select(group_id(F.col("tag")).alias("group_id"), "item_id", "tag")


def replace_memberships(members: DataFrame, enriched: DataFrame) -> DataFrame:
    """Drop memberships of touched items, then add their new ones."""
    untouched = members.join(enriched.select("item_id").distinct(), "item_id", "left_anti")
    new = topic_members(enriched).select(*members.columns)
    return untouched.select(*members.columns).unionByName(new)


def topic_titles(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Group title per item, null when the item sits in several groups."""
    titles = groups.where("group_type = 'topic'").select("group_id", F.col("title").alias("group_title"))
    return (
        members.select("item_id", "group_id")
        .join(titles, "group_id")
        .groupBy("item_id")
        .agg(F.when(F.count("*") == 1, F.min("group_title")).alias("topic_group_title"))
    )

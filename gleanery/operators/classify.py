"""Rule classification, topics and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery import fixed_values as V
from gleanery.functions import text
from gleanery.functions.staging import with_once


def topic_from_title(title: Column) -> Column:
    """Title up to the first bar or colon followed by white space, 80 characters."""
    line = "[^" + V.LINE_END_CHARS + "]"
    cut = text.strip(F.regexp_replace(title, rf"[|:]{V.SPACE}{line}+\z", ""))
    return F.when(F.length(cut) > 80, text.strip_end(F.substring(cut, 1, 80))).otherwise(cut)


def classify(items: DataFrame, rules=V.CLASSIFICATION_RULES) -> DataFrame:
    """Add classification, topic and tags from an ordered rule list."""
    parts = [F.col(name) for name in ("source_topic", "title", "content_text")]
    haystack = F.lower(F.concat_ws(" ", *[F.when(text.is_present(part), part) for part in parts]))
    words = [rule[3] for rule in rules]
    found = with_once(items, _text=haystack).withColumn("_rule", text.first_group_number(F.col("_text"), words)).drop("_text")

    def of_rule(values: list[Column]) -> Column:
        return F.get(F.array(*values), F.col("_rule"))

    source_topic = text.blank_to_null(F.col("source_topic"))
    found = found.withColumn(
        "topic",
        F.coalesce(
            of_rule([F.lit(rule[1]) for rule in rules]),
            source_topic,
            F.nullif(topic_from_title(F.col("title")), F.lit("")),
        ),
    )
    rule_tags = of_rule([F.array(*[F.lit(tag) for tag in rule[2]]) for rule in rules])
    topic_tag = F.replace(text.slugify(F.col("topic")), F.lit("-"), F.lit("_"))
    language_tag = F.when(
        text.is_present(F.col("language")), F.concat(F.lit("lang_"), F.lower(F.col("language")))
    )
    tags = F.array_distinct(
        F.array_compact(
            F.concat(
                F.coalesce(rule_tags, F.array().cast("array<string>")), F.array(topic_tag, language_tag)
            )
        )
    )
    label = F.coalesce(
        of_rule([F.lit(rule[0]) for rule in rules]),
        F.when(source_topic.isNotNull(), F.lit("topic-tracked")),
        F.lit("general"),
    )
    return found.withColumn("classification", label).withColumn("tags", tags).drop("_rule")

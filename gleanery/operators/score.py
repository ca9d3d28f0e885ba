"""Rule scores for importance and novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery import fixed_values as V
from gleanery.functions import dates, text


def with_rule_scores(items: DataFrame, as_of: Column) -> DataFrame:
    """Add importance_score, novelty_score and the rationale list.

    Points are whole hundredths, so sums are exact on every engine.
    """
    length = F.coalesce(F.length(text.strip(F.col("content_text"))), F.lit(0))
    names = ("title", "content_text", "source_topic")
    lowered = [F.col(f"_lower_{name}") for name in names]
    items = items.select("*", *[F.lower(name).alias(f"_lower_{name}") for name in names])

    def mentions(words, columns):
        found = F.lit(False)
        for column in columns:
            found = found | text.contains_any(column, words)
        return found

    rules = [  # name, holds, importance points, novelty points
        ("title_present", text.is_present(F.col("title")), 10, 0),
        ("substantive_content", length >= 280, 15, 0),
        ("long_form", length >= 1200, 10, 0),
        ("recent", F.coalesce(dates.age_in_days(F.col("published_at"), as_of) <= 7, F.lit(False)), 10, 0),
        ("source_topic_present", text.is_present(F.col("source_topic")), 10, 0),
        ("high_signal_ai_topic", mentions(V.AI_WORDS, lowered), 10, 0),
        ("aggregated_content_penalty", mentions(V.AGGREGATION_WORDS, lowered[:2]), 0, -15),
    ]
    checked = items.withColumn(
        "_checks", F.struct(*[holds.alias(name) for name, holds, _, _ in rules])
    )

    def points(start, index):
        total = F.lit(start)
        for rule in rules:
            if rule[index]:
                total = total + F.when(F.col(f"_checks.{rule[0]}"), rule[index]).otherwise(0)
        return text.unit_interval(total.cast("double") / F.lit(100.0))

    rationale = F.array_compact(
        F.array(*[F.when(F.col(f"_checks.{name}"), F.lit(name)) for name, *_ in rules])
    )
    return (
        checked.withColumn("importance_score", points(30, 2))
        .withColumn("novelty_score", points(75, 3))
        .withColumn("rationale", rationale)
        .drop("_checks", *[f"_lower_{name}" for name in names])
    )

"""Reader-facing views: inbox rows, counters, note rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import dates, quality, text
from gleanery.operators.context import item_context
from gleanery.operators.skew import Narrow


def score_breakdown(stored: Column, relevance: Column) -> Column:
    """Breakdown with gaps filled: 0, and the relevance as total."""
    return F.struct(
        *[
            text.number_or(stored[name], F.lit(0.0)).alias(name)
            for name in ("importance_score", "novelty_score", "quality_adjustment")
        ],
        text.number_or(stored["total_score"], relevance).alias("total_score"),
    )


def preview_label(source_name: Column, topic: Column, title: Column) -> Column:
    """Up to two initials of the source, topic or title."""
    seed = F.coalesce(source_name, topic, title)
    initials = F.array_join(F.transform(F.split(seed, r"[\s/\-]+"), lambda p: F.substring(p, 1, 1)), "")
    return F.coalesce(F.nullif(F.upper(F.substring(initials, 1, 2)), F.lit("")), F.lit("IN"))


def selected_items(
    selections: DataFrame,
    items: DataFrame,
    enrichments: DataFrame,
    assets: DataFrame,
    entries: DataFrame,
    sources: DataFrame,
    titles: DataFrame,
) -> DataFrame:
    """Current, selected decisions with item, enrichment and source columns.

    ``selections`` is a stored table: its selected ids are counted, and the large
    tables reduced to them before any wide join.
    """
    chosen = selections.where("is_current and selected").select(
        "item_id", "relevance_score", "score_breakdown", "selection_reasons", "policy_version", "metadata"
    )
    current = enrichments.where("is_current").drop("is_current", "created_at", "superseded_at", "dedupe_key")
    picked = Narrow(chosen.select("item_id"))
    joined = chosen.join(picked.rows(items, "item_id"), "item_id").join(
        picked.rows(current, "item_id"), "item_id"
    )
    own = picked.rows(items.select("item_id", "raw_asset_id"), "item_id").select("raw_asset_id")
    near = assets.join(F.broadcast(own) if picked.small else own, "raw_asset_id", "left_semi")
    joined = item_context(joined, near, entries, sources)
    joined = joined.join(picked.rows(titles, "item_id"), "item_id", "left")
    return joined.withColumn(
        "score_breakdown", score_breakdown(F.col("score_breakdown"), F.col("relevance_score"))
    )


def inbox_rows(selected: DataFrame) -> DataFrame:
    """Display columns of selected items."""
    title = F.coalesce(text.blank_to_null(F.col("title")), F.lit("Untitled item"))
    source = text.blank_to_null(F.col("source_name"))
    names = {"_title": "title", "_short": "summary_short", "_long": "summary_long", "_content": "content_text"}
    staged = selected.select("*", *[quality.collapsed(F.col(c)).alias(n) for n, c in names.items()])
    head = F.col("_title")
    staged = staged.withColumn(
        "_fallback",
        F.coalesce(
            quality.first_standalone_sentence(F.col("_long"), head),
            quality.first_standalone_sentence(F.col("_content"), head),
        ),
    )
    summary = F.when(quality.is_standalone(F.col("_short"), head), F.col("_short")).otherwise(
        text.cut_at_word(F.col("_fallback"))
    )
    return staged.select(
        "item_id",
        "audience",
        title.alias("title"),
        F.col("canonical_url").alias("url"),
        source.alias("source_name"),
        text.blank_to_null(F.col("source_topic")).alias("source_topic"),
        F.when(F.col("source_type") == "rss", "RSS").otherwise(F.col("source_type")).alias("source_type_label"),
        summary.alias("summary_short"),
        dates.label(F.col("published_at")).alias("published_at_label"),
        preview_label(source, F.col("topic"), title).alias("preview_label"),
        "classification",
        "topic",
        "topic_group_title",
        "duplicate_of_item_id",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "relevance_score",
        "score_breakdown",
        F.coalesce("selection_reasons", F.array().cast("array<string>")).alias("selection_reasons"),
        "policy_version",
        "published_at",
        "created_at",
    )


def inbox_order() -> list[Column]:
    return [
        F.desc("relevance_score"),
        F.desc_nulls_first("published_at"),
        F.desc("created_at"),
        F.asc("item_id"),
    ]


def inbox_counters(rows: DataFrame) -> DataFrame:
    topic = F.nullif(F.coalesce("topic", "classification"), F.lit(""))
    return rows.agg(
        F.count("*").alias("visible"),
        F.count("duplicate_of_item_id").alias("duplicates"),
        F.count("topic_group_title").alias("grouped"),
        F.count_distinct(topic).alias("topics"),
    )


def knowledge_rows(
    notes: DataFrame, items: DataFrame, assets: DataFrame, entries: DataFrame, sources: DataFrame
) -> DataFrame:
    """Notes with source, labels, preview and destination statuses.

    ``items`` carries ``item_topic``, the topic of its last processing.
    """
    held = items.select("item_id", "raw_asset_id", "published_at", "item_topic")
    joined = item_context(notes.join(held, "item_id"), assets, entries, sources)
    return joined.select(
        "note_id",
        "item_id",
        "title",
        F.when(F.col("note_type") == "summary", "Summary note").otherwise("Reference note").alias("type_label"),
        text.markdown_preview(F.col("body_md")).alias("body_preview"),
        F.coalesce(text.two_decimals(F.col("review_weight")), F.lit("n/a")).alias("review_weight_label"),
        dates.label(F.col("published_at")).alias("published_at_label"),
        text.blank_to_null(F.col("source_name")).alias("source_name"),
        F.col("item_topic").alias("topic"),
        "tags",
        F.map_values("destinations").alias("destination_statuses"),
        "created_at",
    )


def note_order() -> list[Column]:
    return [F.desc("created_at"), F.asc("note_id")]


def destination_list(destinations: DataFrame) -> DataFrame:
    return destinations.select("destination_id", "name", "status", "target_ref", "destination_type").orderBy(
        "destination_type", "destination_id"
    )

"""Joins that give an item its source context, and the work still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F



def entry_sources(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Source columns per capture entry; entries without a source keep nulls."""
    named = sources.select(
        "source_id",
        F.col("name").alias("source_name"),
        F.col("topic").alias("source_topic"),
        "source_type",
    )
    return entries.select("capture_entry_id", "source_id").join(named, "source_id", "left").drop("source_id")


def item_context(
    items: DataFrame, assets: DataFrame, entries: DataFrame, sources: DataFrame
) -> DataFrame:
    """items with capture_entry_id, source_name, source_topic, source_type.

    Wide item rows are joined once, by their own unique id. The chain behind
    them runs on narrow id rows; where one entry or source owns most assets,
    adaptive execution splits its partition (both joins are plain equi-joins).
    """
    chain = assets.select("raw_asset_id", "capture_entry_id").join(
        entry_sources(entries, sources), "capture_entry_id", "left"
    )
    return items.join(chain, "raw_asset_id", "left")


def pending_items(items: DataFrame, enrichments: DataFrame, *, reprocess: DataFrame | None = None) -> DataFrame:
    """Items to process: not yet processed with a current enrichment, or asked for."""
    current = enrichments.where("is_current").select("item_id").distinct()
    done = items.where("status = 'processed'").select("item_id").join(current, "item_id", "left_semi")
    if reprocess is not None:
        done = done.join(reprocess.select("item_id"), "item_id", "left_anti")
    return items.join(done, "item_id", "left_anti")

"""Versioned tables: enrichment history, selection runs, keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery import fixed_values as V
from gleanery.operators.skew import first_per_key


def enrichment_history(versions: DataFrame) -> DataFrame:
    """Close every version at the next one's time; the newest is current.

    ``versions``: item_id, version_id, created_at, ... valid outputs only, so
    an invalid output leaves the earlier version current.
    """
    # An item has few versions, so one window per item reads the input once.
    following = Window.partitionBy("item_id").orderBy("created_at", "version_id")
    closed = versions.withColumn("superseded_at", F.lead("created_at").over(following))
    return closed.withColumn("is_current", F.col("superseded_at").isNull())


def rewrite_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """History after appending new valid versions.

    Only items with a new version are recomputed; the rest pass through.
    """
    versions = [name for name in history.columns if name not in ("superseded_at", "is_current")]
    touched = new.select("item_id").distinct()
    untouched = history.join(touched, "item_id", "left_anti")
    reopened = history.join(touched, "item_id", "left_semi").select(*versions)
    redone = enrichment_history(reopened.unionByName(new.select(*versions)))
    return untouched.unionByName(redone.select(*history.columns))


def selection_history(runs: DataFrame) -> DataFrame:
    """Decisions of all runs; those of the newest run are current."""
    newest = runs.agg(F.max("run_id")).scalar()
    return runs.withColumn("is_current", F.col("run_id") == newest)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Base with the delta's latest row per key written over it.

    Only the delta is ranked; the base is passed through an anti-join.
    """
    latest = first_per_key(delta, keys, *order)
    kept = base.join(latest.select(*keys), list(keys), "left_anti")
    return kept.select(*base.columns).unionByName(latest.select(*base.columns))


def insert_missing(base: DataFrame, delta: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Base plus the delta rows whose key it lacks (insert or ignore)."""
    fresh = first_per_key(delta, keys, *order).join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def processing_record(generation: dict[str, object] | None = None) -> Column:
    """Provenance of one processing pass as a struct.

    Reads item, enrichment and duplicate columns, group_id, and note_id and
    synced_destination_count where a note was made.
    """
    settings = generation or {"model": "rules", "prompt_version": "v1", "provider": "local"}
    duplicate = F.col("duplicate_of_item_id")
    kept = duplicate.isNull() & F.coalesce(F.col("preserve_recommendation") == "keep", F.lit(False))
    note_status = F.when(kept, "created").otherwise("skipped")
    return F.struct(
        F.array(*[F.lit(step) for step in V.PROCESSING_ORDER]).alias("order"),
        F.lit(V.PROCESSING_VERSION).alias("version"),
        F.lit("preserve").alias("last_completed_step"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit("processed").alias("status"),
        note_status.alias("note_status"),
        F.struct(*[F.lit(value).alias(name) for name, value in settings.items()]).alias("generation"),
        F.struct(
            F.struct("importance_score", "novelty_score", "rationale").alias("score"),
            F.struct("dedupe_key", duplicate.alias("duplicate_of_item_id")).alias("dedupe"),
            F.struct("summary_short", F.size("key_points").alias("key_point_count")).alias("summarize"),
            F.struct("classification", "topic", "tags").alias("classify"),
            F.struct("group_id", "topic").alias("group"),
            F.struct(
                "preserve_recommendation",
                F.when(kept, F.col("note_id")).alias("note_id"),
                F.when(kept, F.coalesce("synced_destination_count", F.lit(0))).otherwise(0).alias("synced_count"),
            ).alias("preserve"),
        ).alias("steps"),
    )

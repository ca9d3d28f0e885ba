"""Raw assets to items, canonical URL ownership, capture-entry completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.functions import text, variants
from gleanery.operators.skew import first_per_key


def normalize_assets(assets: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One item per usable asset that has none yet.

    ``assets``: raw_asset_id, capture_entry_id, asset_type, external_id, title,
    author, url, published_at, raw_content, raw_metadata (JSON text), status.
    """
    todo = assets.where("status <> 'failed'")
    if items is not None:
        todo = todo.join(items.select("raw_asset_id"), "raw_asset_id", "left_anti")
    todo = todo.withColumn("meta", F.try_parse_json("raw_metadata")).withColumn(
        "content_text", text.html_to_text(F.col("raw_content"))
    )
    meta = F.col("meta")
    feed_language = variants.string(meta, "$.feed.language")
    has_content = F.coalesce(F.col("raw_content") != "", F.lit(False))
    return todo.select(
        F.col("raw_asset_id").alias("item_id"),
        "raw_asset_id",
        F.lit("article").alias("item_type"),
        "title",
        F.col("url").alias("canonical_url"),
        "author",
        "published_at",
        F.coalesce(variants.string(meta, "$.language"), feed_language).alias("language"),
        "content_text",
        F.lit("new").alias("status"),
        F.struct(
            "capture_entry_id",
            variants.string(meta, "$.connectorType").alias("connector_type"),
            "external_id",
            F.col("asset_type").alias("raw_asset_type"),
            variants.string(meta, "$.sourceUrl").alias("source_url"),
            variants.string(meta, "$.submittedUrl").alias("submitted_url"),
            F.struct(
                F.coalesce(F.length("content_text"), F.lit(0)).alias("content_length"),
                F.when(has_content, "raw_content").otherwise("metadata_only").alias("content_source"),
                variants.string(meta, "$.extractor").alias("extractor"),
                variants.string(meta, "$.extractorVersion").alias("extractor_version"),
                variants.string(meta, "$.fetchTimestamp").alias("fetch_timestamp"),
                variants.string(meta, "$.finalUrl").alias("final_url"),
                variants.number(meta, "$.httpStatus").alias("http_status"),
                variants.number(meta, "$.redirectCount").alias("redirect_count"),
                variants.string(meta, "$.extractionStatus").alias("status"),
                F.when(text.has_markup(F.col("raw_content")), "html").otherwise("text").alias("text_format"),
            ).alias("extraction"),
            F.struct(
                feed_language.alias("feed_language"),
                variants.string(meta, "$.feed.title").alias("feed_title"),
                variants.string(meta, "$.feed.siteUrl").alias("feed_url"),
            ).alias("rss"),
        ).alias("metadata"),
    )


def assign_canonical_urls(new: DataFrame, order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """The first item keeps a canonical URL; later ones record a conflict.

    Owners are found with at most one row per URL and task, then joined back by
    item id, so a URL shared by a third of the items moves no more data.
    """
    owners = first_per_key(
        new.where("canonical_url is not null").select("item_id", "canonical_url", *order),
        ["canonical_url"],
        *[F.col(name) for name in order],
        F.col("item_id"),
    )
    if stored is not None:
        taken = stored.where("canonical_url is not null").select("canonical_url")
        owners = owners.join(taken, "canonical_url", "left_anti")
    owners = owners.select("item_id", F.lit(True).alias("_owner"))
    url = F.col("canonical_url")
    joined = new.join(owners, "item_id", "left").withColumn(
        "canonical_url_conflict", F.when(F.col("_owner").isNull(), url)
    )
    return joined.withColumn("canonical_url", F.when(F.col("_owner"), url)).drop("_owner")


def apply_asset_outcomes(assets: DataFrame, failures: DataFrame) -> DataFrame:
    """Mark assets normalized, or failed with a message."""
    failed = failures.select("raw_asset_id", F.col("message").alias("failure_message"))
    joined = assets.join(failed, "raw_asset_id", "left")
    status = F.when(F.col("failure_message").isNotNull() | (F.col("status") == "failed"), "failed").otherwise(
        "normalized"
    )
    return joined.withColumn("status", status)


def entry_completion(assets: DataFrame) -> DataFrame:
    """Entry status: normalized when every asset is, failed when one failed."""
    counts = assets.groupBy("capture_entry_id").agg(
        F.count("*").alias("asset_count"),
        F.count_if(F.col("status") == "normalized").alias("normalized_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.min("failure_message").alias("failure_message"),
    )
    status = (
        F.when(F.col("normalized_count") == F.col("asset_count"), "normalized")
        .when(F.col("failed_count") > 0, "failed")
        .otherwise("captured")
    )
    phase = F.when(status == "normalized", "completed").when(status == "failed", "failed")
    return counts.withColumn("entry_status", status).withColumn("phase", phase)


def annotate_item_failures(items: DataFrame, failures: DataFrame) -> DataFrame:
    """A processing failure only annotates the item; its status stays."""
    notes = failures.select(
        "item_id",
        F.col("message").alias("last_error"),
        F.col("failed_at").alias("failed_at"),
        F.lit("failed").alias("processing_status"),
    )
    return items.join(notes, "item_id", "left")

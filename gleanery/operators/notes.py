"""Preservation notes and their destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery import fixed_values as V
from gleanery.functions import text


def excerpt(content: Column) -> Column:
    """First two sentences, at most 320 characters."""
    body = text.blank_to_null(content)
    start = text.collapse(F.array_join(F.slice(text.sentences(body), 1, 2), " "))
    return text.cut_with_ellipsis(F.coalesce(F.nullif(start, F.lit("")), text.collapse(body)), 320)


def _with_title(draft: Column, title: Column) -> Column:
    body = text.strip(draft)
    head = F.concat(F.lit("# "), title)
    return (
        F.when(body == "", head)
        .when(F.startswith(body, F.lit("# ")), body)
        .otherwise(F.concat(head, F.lit("\n\n"), body))
    )


def _fallback_body(title: Column) -> Column:
    """Markdown body of a note without a draft; null lines are left out."""
    col = F.col

    def line(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    def item(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {label}: "), value)

    def with_excerpt(value: str) -> Column:
        return F.when(col("_excerpt").isNotNull(), F.lit(value))

    # fixed values: the texts below must be these, in this order
    top = [
        F.concat(F.lit("# "), title), "", col("summary_short"), "",
        F.when(text.is_present(col("summary_long")), F.lit("## Summary")), col("summary_long"), "",
        "## Why it matters", "", col("why_it_matters"), "", "## Key points", "",
    ]
    bottom = [
        "", "## Preservation context", "",
        item("Importance score", text.two_decimals(col("importance_score"))),
        item("Novelty score", text.two_decimals(col("novelty_score"))),
        item("Baseline score heuristic", text.two_decimals(col("baseline_score"))),
        item("Deduped as duplicate", F.when(col("duplicate_of_item_id").isNull(), "no").otherwise("yes")),
        item("Classification", col("classification")),
        item("Topic", col("topic")), "",
        with_excerpt("## Source excerpt"), with_excerpt(""), col("_excerpt"), "",
        F.when(
            text.is_present(col("canonical_url")),
            F.concat(F.lit("[Original source]("), col("canonical_url"), F.lit(")")),
        ),
    ]
    points = F.transform(
        F.coalesce(col("key_points"), F.array().cast("array<string>")),
        lambda point: F.concat(F.lit("- "), point),
    )
    lines = F.concat(
        F.array(*[line(value) for value in top]), points, F.array(*[line(value) for value in bottom])
    )
    return F.array_join(F.array_compact(lines), "\n")


def build_notes(enriched: DataFrame) -> DataFrame:
    """A note for every kept item that is no duplicate.

    ``enriched``: item and current enrichment columns, duplicate_of_item_id and
    baseline_score (the rule importance).
    """
    worth = enriched.where("duplicate_of_item_id is null and preserve_recommendation = 'keep'")
    worth = worth.withColumn("_excerpt", excerpt(F.col("content_text"))).withColumn(
        "_title",
        F.coalesce(
            text.first_present(F.col("title"), F.col("summary_short"), F.col("topic")),
            F.lit("Preserved note"),
        ),
    )
    points = F.coalesce(F.col("key_points"), F.array().cast("array<string>"))
    highlights = text.distinct_present(
        F.concat(
            F.array("summary_short", "why_it_matters"), points, F.array("_excerpt", "topic")
        )
    )
    hundredths = [
        F.floor(F.col(name) * 100 + 0.5).cast("bigint") for name in ("importance_score", "novelty_score")
    ]
    weight = F.floor((hundredths[0] + hundredths[1] + 1) / 2).cast("double") / F.lit(100.0)
    return worth.select(
        F.sha2(F.concat(F.lit("note:"), F.col("item_id").cast("string")), 256).alias("note_id"),
        "item_id",
        F.col("_title").alias("title"),
        F.when(F.col("classification").isin("research", "tutorial"), "summary")
        .otherwise("reference")
        .alias("note_type"),
        F.when(
            F.col("note_draft").isNotNull(), _with_title(F.col("note_draft"), F.col("_title"))
        )
        .otherwise(_fallback_body(F.col("_title")))
        .alias("body_md"),
        F.slice(highlights, 1, 4).alias("highlights"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        text.unit_interval(weight).alias("review_weight"),
        F.struct(
            F.lit("processed_item").alias("created_from"),
            "importance_score",
            "novelty_score",
            F.lit(V.PROCESSING_VERSION).alias("version"),
            F.col("preserve_recommendation").alias("recommendation"),
            F.lit("model-backed-preserve-recommendation").alias("rule"),
        ).alias("preservation"),
        F.col("created_at"),
    )


# ------------------------------------------------------------------ destinations
def default_destinations(spark: SparkSession) -> DataFrame:
    rows = [
        (f"default-{kind}", kind, name, target, "active") for kind, name, target in V.DEFAULT_DESTINATIONS
    ]
    return spark.createDataFrame(
        rows, "destination_id string, destination_type string, name string, target_ref string, status string"
    )


def with_missing_defaults(existing: DataFrame) -> DataFrame:
    """Existing destinations plus a default for every type that has none."""
    defaults = default_destinations(existing.sparkSession)
    types = [kind for kind, _, _ in V.DEFAULT_DESTINATIONS]
    # At most one value per destination type, so the set is bounded.
    held = existing.where(F.col("destination_type").isin(types)).agg(F.collect_set("destination_type")).scalar()
    missing = defaults.where(~F.array_contains(held, F.col("destination_type")))
    return existing.select(*defaults.columns).unionByName(missing)


PAGE = 64      # destinations a note row meets at once
SPREAD = 64    # copies of a page, so that its notes are not one join key


def _active(destinations: DataFrame) -> DataFrame:
    return destinations.where("status = 'active'").select(
        "destination_type", "destination_id", "name", "target_ref"
    )


def _slug() -> Column:
    return F.coalesce(F.nullif(text.slugify(F.col("title")), F.lit("")), F.col("note_id"))


def _result(to: Column) -> Column:
    """What one note has at one destination."""
    notion = to["destination_type"] == "notion"
    kind = F.when(notion, F.lit("Notion page")).otherwise(F.lit("Obsidian note"))
    return F.struct(
        to["destination_id"].alias("destination_id"),
        to["destination_type"].alias("destination_type"),
        to["target_ref"].alias("target_ref"),
        F.when(notion, F.concat(to["target_ref"], F.lit("/page/"), F.col("_slug")))
        .otherwise(F.concat(to["target_ref"], F.lit("/"), F.col("_slug"), F.lit(".md")))
        .alias("external_ref"),
        F.concat(F.lit("Prepared "), kind, F.lit(" payload for "), F.col("title"), F.lit(".")).alias("message"),
        F.lit("success").alias("status"),
        F.col("created_at").alias("synced_at"),
    )


def sync_notes(notes: DataFrame, destinations: DataFrame) -> DataFrame:
    """One row per note and active destination, however many there are.

    Destinations are dealt into pages by a hash; notes equi-join the page numbers.
    """
    active = _active(destinations)
    pages = active.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PAGE)).cast("int")).scalar()
    fields = F.struct(*active.columns)
    listed = (
        active.withColumn("_page", F.pmod(F.xxhash64("destination_type", "destination_id", "target_ref"), pages).cast("int"))
        .groupBy("_page")
        .agg(F.collect_list(fields).alias("_to"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    )
    dealt = notes.select(
        "note_id", "item_id", "title", "created_at", _slug().alias("_slug"),
        F.pmod(F.xxhash64("note_id"), F.lit(SPREAD)).cast("int").alias("_copy"),
        F.explode(F.sequence(F.lit(0), pages - 1)).alias("_page"),
    )
    results = dealt.join(listed, ["_page", "_copy"]).withColumn("_one", F.explode("_to"))
    return results.select("note_id", "item_id", _result(F.col("_one")).alias("r")).select("note_id", "item_id", "r.*")


def sync_rollup(notes: DataFrame, destinations: DataFrame) -> DataFrame:
    """Notes with result map by destination type (the last wins), count and time.

    Only the last destination of each type, a closed set, and the number of all are
    needed, so both are scalars and notes are neither joined nor shuffled.
    """
    active = _active(destinations)
    by_type = active.groupBy("destination_type").agg(
        F.max(F.struct(*active.columns)).alias("last"), F.count("*").alias("n")
    )
    known = by_type.agg(
        F.struct(F.array_sort(F.collect_list("last")).alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    ).scalar()
    listed = notes.withColumn("_known", known).withColumn("_slug", _slug())
    entries = F.transform("_known.last", lambda to: F.struct(to["destination_type"], _result(to)))
    return listed.select(
        *notes.columns,
        F.map_from_entries(entries).alias("destinations"),
        F.col("_known.n").cast("int").alias("synced_destination_count"),
        F.col("created_at").alias("last_succeeded_at"),
    )


def destination_status(rollup: DataFrame) -> DataFrame:
    """Rows of the result map that carry a reference and a message."""
    rows = rollup.select("note_id", "item_id", F.explode("destinations").alias("kind", "r"))
    return rows.where("r.external_ref is not null and r.message is not null").select(
        "note_id",
        "item_id",
        F.when(F.col("kind") == "notion", "notion").otherwise("obsidian").alias("destination_type"),
        "r.external_ref",
        "r.message",
        F.coalesce("r.status", F.lit("unknown")).alias("status"),
        "r.synced_at",
    )

"""Registered sources: registration, commands, sync eligibility, status view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import dates, text, urls
from gleanery.operators.skew import first_per_key
from gleanery.operators.timeline import with_previous_value

# Rejection texts.
NAME_REQUIRED = "Source name is required."
URL_INVALID = "Enter a valid RSS URL."
URL_SCHEME = "RSS URLs must use http or https."
ALREADY_REGISTERED = "That RSS source is already registered."
ID_REQUIRED = "Source id is required."
NOT_FOUND = "Source not found."


def source_id(source_ref: Column) -> Column:
    """Repeatable id of a source."""
    return F.sha2(F.concat(F.lit("rss:"), source_ref), 256)


def register_sources(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Requests with normalized values and ``rejection`` (null when accepted).

    ``requests``: request_id, name, source_url, topic, requested_at. The first
    request for a URL wins; a registered URL is a conflict.
    """
    checked = requests.select(
        "request_id",
        "requested_at",
        text.blank_to_null(F.col("name")).alias("name"),
        urls.normalize(F.col("source_url")).alias("source_ref"),
        text.blank_to_null(F.col("topic")).alias("topic"),
        urls.problem(F.col("source_url"), URL_INVALID, URL_SCHEME).alias("_url_problem"),
    )
    checked = checked.withColumn(
        "_problem", F.coalesce("_url_problem", F.when(F.col("name").isNull(), NAME_REQUIRED))
    )
    winners = first_per_key(
        checked.where("_problem is null").select("request_id", "source_ref", "requested_at"),
        ["source_ref"],
        F.col("requested_at"),
        F.col("request_id"),
    )
    if existing is not None:
        winners = winners.join(existing.select("source_ref"), "source_ref", "left_anti")
    joined = checked.join(winners.select("request_id", F.lit(True).alias("_won")), "request_id", "left")
    rejection = F.coalesce("_problem", F.when(F.col("_won").isNull(), ALREADY_REGISTERED))
    return joined.select(
        "request_id",
        "requested_at",
        "name",
        "source_ref",
        "topic",
        F.when(rejection.isNull(), source_id(F.col("source_ref"))).alias("source_id"),
        rejection.alias("rejection"),
    )


def accepted_sources(registered: DataFrame) -> DataFrame:
    """Source rows of accepted registrations."""
    return registered.where("rejection is null").select(
        "source_id",
        F.lit("rss").alias("source_type"),
        "source_ref",
        F.col("source_ref").alias("source_url"),
        "name",
        "topic",
        F.lit("active").alias("status"),
        F.col("requested_at").alias("created_at"),
        F.col("requested_at").alias("updated_at"),
    )


def check_commands(commands: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Commands with ``rejection``: null when the command takes effect.

    ``commands``: command_id, source_id, action (register, pause, reactivate,
    delete), at. A source exists before a command when the last earlier
    register or delete was a register, or, without one, when it is in
    ``existing``; rejected ones leave existence as it would be anyway.
    """
    given = commands.withColumn("source_id", text.blank_to_null(F.col("source_id")))
    named = given.where("source_id is not null").withColumn(
        "_makes", F.when(F.col("action") == "register", True).when(F.col("action") == "delete", False)
    )
    walked = with_previous_value(named, ["source_id"], "at", ["command_id"], "_makes", "_before")
    if existing is not None:
        start = existing.select("source_id").distinct().withColumn("_start", F.lit(True))
        walked = walked.join(start, "source_id", "left")
    else:
        walked = walked.withColumn("_start", F.lit(None).cast("boolean"))
    exists = F.coalesce("_before", "_start", F.lit(False))
    rejection = F.when((F.col("action") == "register") & exists, ALREADY_REGISTERED).when(
        (F.col("action") != "register") & ~exists, NOT_FOUND
    )
    columns = commands.columns
    unnamed = given.where("source_id is null").withColumn("rejection", F.lit(ID_REQUIRED))
    return walked.select(*columns, rejection.alias("rejection")).unionByName(unnamed.select(*columns, "rejection"))


def apply_commands(checked: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Sources left after the effective commands, with status and times."""
    order = F.struct("at", "command_id")
    status = F.when(F.col("action") == "pause", "paused").when(
        F.col("action").isin("register", "reactivate"), "active"
    )
    effective = checked.where("rejection is null").withColumn("_status", status)
    latest = effective.groupBy("source_id").agg(
        F.max_by("action", order).alias("action"),
        F.max_by("_status", order).alias("status"),
        F.max("at").alias("updated_at"),
        F.max(F.when(F.col("action") == "register", F.col("at"))).alias("created_at"),
    )
    if existing is None:
        return latest.where("action <> 'delete'").select("source_id", "status", "created_at", "updated_at")
    base = existing.select(
        "source_id",
        F.col("status").alias("_status"),
        F.col("created_at").alias("_created"),
        F.col("updated_at").alias("_updated"),
    )
    both = base.join(latest, "source_id", "full").where("action is null or action <> 'delete'")
    return both.select(
        "source_id",
        F.coalesce("status", "_status").alias("status"),
        F.coalesce("created_at", "_created").alias("created_at"),
        F.coalesce("updated_at", "_updated").alias("updated_at"),
    )


def cascade_deletes(table: DataFrame, sources: DataFrame, *, keep_rows: bool) -> DataFrame:
    """Follow deleted sources: drop their rows, or clear their source_id."""
    if not keep_rows:
        return table.join(sources.select("source_id"), "source_id", "left_semi")
    alive = sources.select(F.col("source_id").alias("_alive"))
    joined = table.join(alive, table["source_id"] == alive["_alive"], "left")
    return joined.withColumn("source_id", F.col("_alive")).drop("_alive").select(*table.columns)


def backfill_sync_state(sources: DataFrame, state: DataFrame) -> DataFrame:
    """State plus an empty row for every source that has none."""
    missing = sources.where("source_type = 'rss'").select("source_id").join(state, "source_id", "left_anti")
    return state.unionByName(missing, allowMissingColumns=True)


def sync_eligibility(sources: DataFrame) -> DataFrame:
    """Add ``refusal``: why a source cannot be synced now, or null."""
    return sources.withColumn(
        "refusal",
        F.when(F.col("status") == "paused", "Paused RSS sources cannot be synced.").when(
            F.coalesce("source_url", F.lit("")) == "", "RSS source URL is required for sync."
        ),
    )


def source_status(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Badge, tone and detail text of every source, newest first."""
    held = state.withColumn("_has_state", F.lit(True))
    joined = sync_eligibility(sources).join(held, "source_id", "left")
    status = F.col("status")
    success, error = F.col("last_success_at"), F.col("last_error_at")

    def at(prefix: str, time: Column) -> Column:
        return F.concat(F.lit(prefix), dates.label(time))

    message = F.col("last_error_message")
    error_end = F.when(
        F.coalesce(message, F.lit("")) != "", F.concat(F.lit(": "), message)
    ).otherwise(F.lit("."))
    # fixed values: the texts below must be these, in this order
    detail = (
        F.when(F.col("_has_state").isNull(), "Sync state has not been initialized yet.")
        .when(
            status == "paused",
            F.when(success.isNotNull(), F.concat(at("Paused. Last successful sync ", success), F.lit(".")))
            .otherwise("Paused before the first sync."),
        )
        .when(
            status == "error",
            F.when(error.isNotNull(), F.concat(at("Last sync error ", error), error_end)).otherwise(
                "An error state is recorded for this source."
            ),
        )
        .when(success.isNotNull(), F.concat(at("Last successful sync ", success), F.lit(".")))
        .when(
            F.col("last_synced_at").isNotNull(),
            F.concat(at("Last sync attempt ", F.col("last_synced_at")), F.lit(".")),
        )
        .otherwise("Awaiting first sync.")
    )
    tone = F.when(status == "active", "active").when(status == "paused", "muted").otherwise("error")
    label = F.when(status == "active", "Active").when(status == "paused", "Paused").otherwise("Error")
    return joined.select(
        "source_id", "name", "status", "refusal", "created_at", "updated_at",
        label.alias("badge_label"), tone.alias("badge_tone"), detail.alias("detail"),
    )


def newest_first(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("created_at"), F.desc("updated_at"), "source_id")

"""Queries that run a table through micro-batches and return the state after the last."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gleanery.operators import capture
from gleanery.plans import fixtures as fx
from gleanery.plans.catalog import instant, later_versions, query, topic_times, versions
from gleanery.session import ensure_checkpoint_dir
from gleanery.streaming import microbatch
from gleanery.streaming.versions import VersionTable

BATCHES = 3


def _store(spark) -> microbatch.Store:
    return microbatch.Store(spark, f"{ensure_checkpoint_dir(spark)}/batches-{uuid.uuid4().hex}")


def _batches(store, rows, number):
    """(batch, stored rows) of each micro-batch; ``number`` deals the rows to them, in one pass over all."""
    path = store.path("_given")
    given = rows.withColumn("_batch", number.cast("int"))
    given.write.partitionBy("_batch").parquet(path)
    stored = store.spark.read.schema(given.schema).parquet(path)
    for batch_id in range(BATCHES):
        yield batch_id, stored.where(F.col("_batch") == batch_id).drop("_batch")


@query
def capture_batches(spark, d):
    """Feed entries in three micro-batches: known by an earlier one, kept, or blocked inside their own."""
    store = _store(spark)
    entries = fx.feed_entries(spark, d).select("row_id", "source_id", "pos", "external_id", "url")
    number = F.pmod(F.floor(F.col("row_id") / 16), F.lit(BATCHES))
    for batch_id, own in _batches(store, entries, number):
        ranked = own.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        known, log = microbatch.known_identities(store, ranked, batch_id)
        decided = store.stage("decided", capture.capture_dedupe(ranked, known), batch_id)
        log.write(microbatch.identities(decided.where("decision = 'kept'")), batch_id)
        store.write("decided", decided.select("row_id", "source_id", "decision"), batch_id)
    return store.read("decided")


@query
def dedupe_batches(spark, d):
    """Items in three micro-batches; the original is the first item of the key among those seen so far."""
    store = _store(spark)
    items = fx.items(spark, d).select("item_id", "created_at", "title", "canonical_url", "canonical_url_conflict", "content_text")
    for batch_id, own in _batches(store, items, F.col("item_id") % BATCHES):
        found, _ = microbatch.batch_duplicates(store, "dedupe_keys", own, batch_id)
        store.write("found", found, batch_id)
    return store.read("found").drop("batch_id")


def _grouped(spark, d):
    store = _store(spark)
    assigned = topic_times(spark, d)
    for batch_id, own in _batches(store, assigned, F.pmod(F.unix_seconds("at"), F.lit(BATCHES))):
        microbatch.write_groups(store, own, batch_id)
    return store


@query
def group_batches(spark, d):
    """Topic groups after three micro-batches that bring assignments in no order of time."""
    found = microbatch.stored_groups(_grouped(spark, d), BATCHES - 1, LongType())
    return found.select("tag", "title", "summary", instant("created_at"), instant("updated_at"))


@query
def member_batches(spark, d):
    """Memberships after the same batches: an item that changed topic has left its old group."""
    found = microbatch.stored_members(_grouped(spark, d), BATCHES - 1)
    return found.select(F.col("item_id").cast("bigint").alias("item_id"), "tag")


def _versioned(spark, d):
    """Versions in three micro-batches that bring them in no order of time."""
    store = _store(spark)
    every = versions(spark, d).unionByName(later_versions(spark, d))
    table = VersionTable(spark, store.path("versions"), every.schema, buckets=16)
    for batch_id, own in _batches(store, every, F.pmod(F.col("item_id") - F.col("version_id"), F.lit(BATCHES))):
        table.retire(batch_id)
        table.add(own, batch_id)
    return table


@query
def history_batches(spark, d):
    """All versions after the last batch, closed at the next one's time."""
    found = _versioned(spark, d).history(BATCHES)
    return found.select(
        "item_id", "version_id", "importance_score", instant("created_at"), instant("superseded_at"), "is_current"
    )


@query
def current_batches(spark, d):
    """The current version of every item after the same batches, without a window or the closed rows."""
    return _versioned(spark, d).current(BATCHES).select("item_id", "version_id", "importance_score", instant("created_at"))


@query
def sync_state_batches(spark, d):
    """Sync state after three micro-batches that bring outcomes in no order of time, some of them twice."""
    store = _store(spark)
    run = microbatch.sync_state_batch(store)
    outcomes = fx.outcomes(spark, d)
    first = outcomes.withColumn("batch", F.pmod(F.xxhash64("seq"), F.lit(BATCHES)))
    again = first.where("batch = 0 and seq % 5 = 0").withColumn("batch", F.lit(BATCHES - 1).cast("bigint"))
    every = first.unionByName(again)
    for batch_id, own in _batches(store, every, F.col("batch")):
        run(own.drop("batch"), batch_id)
    found = microbatch.stored_sync_state(store, LongType())
    return found.select(
        "source_id", instant("last_synced_at"), instant("last_success_at"), instant("last_error_at"),
        "last_error_message", "source_status",
    )

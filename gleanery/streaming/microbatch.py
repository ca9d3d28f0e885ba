"""Incremental runs: feed payloads and fetch outcomes as micro-batches.

Tables are folders of Parquet files partitioned by batch_id. A micro-batch
overwrites only its own folder and reads only earlier ones, so replaying it
after a failure gives the same tables, also where it now has no rows. What a batch
must know of all earlier ones lies in keyed logs (see ``keyed``) and in the stored
best candidates, so its work follows the batch and not the history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType, StringType, StructType

from gleanery.functions import text
from gleanery.operators import capture, enrich, groups, history, normalize, notes, selection
from gleanery.operators.dedupe import find_duplicates, key_holders, settle_duplicates
from gleanery.operators.skew import first_n_per_key
from gleanery.session import ensure_checkpoint_dir, tune
from gleanery.sources import feeds
from gleanery.streaming.keyed import KeyedLog, remove


LOGS = ("identities", "canonical_urls", "dedupe_keys", "selectable_keys", "groups", "memberships")


@dataclass(frozen=True)
class Store:
    """Batch-partitioned tables under one folder that all executors share."""

    spark: SparkSession
    folder: str
    buckets: int = 64       # of the keyed logs; fixed for the life of the store

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path)

    def keyed(self, name: str, schema: StructType, merge=None) -> KeyedLog:
        """Keys of all batches, for lookups that read only what a batch may hit."""
        return KeyedLog(self.spark, self.path(f"_keys/{name}"), schema, buckets=self.buckets, merge=merge)

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Replace the batch's own folder, also by no rows; its files then still tell the schema."""
        rows.write.mode("overwrite").parquet(f"{self.path(name)}/batch_id={batch_id}")

    def stage(self, name: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows stored for this batch alone; ``clear`` removes them."""
        path = f"{self.path('_stage')}/{batch_id}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self, batch_id: int) -> None:
        remove(self.spark, f"{self.path('_stage')}/{batch_id}")

    def read(self, name: str, like: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """Rows of earlier batches; an empty frame shaped like ``like`` at first."""
        if not self.exists(name):
            if like is None:
                raise FileNotFoundError(self.path(name))
            return like.limit(0).withColumn("batch_id", F.lit(0).cast("bigint"))
        reader = self.spark.read
        if like is not None:
            reader = reader.schema(like.withColumn("batch_id", F.lit(0).cast("bigint")).schema)
        rows = reader.parquet(self.path(name))
        return rows if before is None else rows.where(F.col("batch_id") < before)


def identities(rows: DataFrame) -> DataFrame:
    """Ids and URLs of assets under one text key."""
    keys = capture.identity_keys(rows)
    return keys.select(F.concat_ws("\u0002", F.col("source_id").cast("string"), "kind", "value").alias("key"), *keys.columns)


def known_identities(store: Store, rows: DataFrame, batch_id: int) -> tuple[DataFrame, KeyedLog]:
    """Stored identities that occur in ``rows``, as assets, and their log."""
    asked = identities(rows)
    log = store.keyed("identities", asked.schema)
    found = log.lookup(asked, batch_id)
    as_column = [F.when(F.col("kind") == kind, F.col("value")).alias(name) for kind, name in (("externalId", "external_id"), ("url", "url"))]
    return found.select("source_id", *as_column), log


def _holders(items: DataFrame) -> DataFrame:
    return key_holders(items).withColumnRenamed("dedupe_key", "key")


def batch_duplicates(store: Store, name: str, items: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Duplicates among a batch's items given all earlier ones, and the first holder of each of their keys.

    ``items`` must be stored; the log of first holders is updated.
    """
    own = _holders(items)
    log = store.keyed(name, own.schema)
    earlier = store.stage(f"{name}_earlier", log.lookup(own, batch_id), batch_id).withColumnRenamed("key", "dedupe_key")
    log.write(own, batch_id)
    found = find_duplicates(items, holders=earlier).select("item_id", "dedupe_key", "duplicate_of_item_id")
    firsts = earlier.unionByName(key_holders(items)).groupBy("dedupe_key").agg(F.min(F.struct("created_at", "item_id")).alias("first"))
    return found, firsts


def capture_batch(store: Store, payloads: DataFrame, batch_id: int) -> None:
    """Parse, keep unseen assets, normalize them, record the run and cursor.

    ``payloads``: payload_id, source_id, source_url, final_url, requested_at, xml.
    """
    tune(store.spark)
    ensure_checkpoint_dir(store.spark)
    # parsed once; both kinds of rows are read several times below
    assets, broken = feeds.split_rows(store.stage("feed_rows", feeds.feed_rows(payloads), batch_id))
    meta = payloads.select("payload_id", "source_url", "final_url", "requested_at")
    assets = assets.join(meta, "payload_id").withColumn("raw_metadata", feeds.asset_metadata())
    parsed = assets.select(
        F.sha2(F.concat_ws("/", F.lit(batch_id), "payload_id", "pos"), 256).alias("row_id"),
        "source_id",
        F.col("payload_id").alias("feed_id"),
        "pos",
        "external_id",
        "url",
        "title",
        "author",
        "published_at",
        "raw_content",
        "raw_metadata",
        "requested_at",
    )
    entries = store.stage("entries", parsed, batch_id)

    # One walk per source: its payloads of this batch in arrival order.
    ranked = entries.select(
        "row_id",
        "source_id",
        F.lit(batch_id).alias("batch_id"),
        F.struct("requested_at", "feed_id", "pos").alias("pos"),
        "external_id",
        "url",
        "published_at",
    )
    known, log = known_identities(store, ranked, batch_id)
    decided = store.stage("decided", capture.capture_dedupe(ranked, known).select("row_id", "decision"), batch_id)
    fresh = entries.join(decided.where("decision = 'kept'").select("row_id"), "row_id", "left_semi")
    good = payloads.join(broken.select("payload_id"), "payload_id", "left_anti").select(
        "source_id", F.lit(batch_id).alias("batch_id")
    )
    runs = capture.capture_runs(ranked.join(decided, "row_id"), good).drop("batch_id")
    # A cursor belongs to one fetched document, so its members are bounded by that document.
    fetched = entries.select("source_id", F.col("feed_id").alias("batch_id"), "pos", "external_id", "url", "published_at")
    cursors = capture.sync_cursors(fetched).withColumnRenamed("batch_id", "feed_id")
    failed = capture.failed_runs(broken.select("source_id", F.lit(batch_id).alias("batch_id"), F.col("error").alias("message")))

    store.write("raw_assets", _asset_rows(fresh), batch_id)
    log.write(identities(fresh), batch_id)
    store.write("capture_runs", runs, batch_id)
    store.write("failed_runs", failed.drop("batch_id"), batch_id)
    store.write("cursors", cursors, batch_id)
    done = payloads.select("source_id", F.col("requested_at").alias("at"), F.col("payload_id").alias("seq"), "payload_id")
    outcomes = done.join(broken.select("payload_id", F.col("error").alias("message")), "payload_id", "left")
    store.write(
        "outcomes",
        outcomes.select("source_id", "at", "seq", F.col("message").isNull().alias("ok"), "message"),
        batch_id,
    )
    normalize_batch(store, batch_id)


def _asset_rows(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("row_id").cast("string").alias("raw_asset_id"),
        F.concat_ws("-", F.col("source_id").cast("string"), F.col("feed_id").cast("string")).alias(
            "capture_entry_id"
        ),
        "source_id",
        F.lit("article").alias("asset_type"),
        "external_id",
        "title",
        "author",
        "url",
        "published_at",
        "raw_content",
        "raw_metadata",
        F.lit("new").alias("status"),
        F.col("requested_at").alias("created_at"),
    )


def normalize_batch(store: Store, batch_id: int) -> None:
    """Items of the batch's own assets; earlier items keep their URLs."""
    own = store.read("raw_assets").where(F.col("batch_id") == batch_id)
    items = normalize.normalize_assets(own).drop("metadata").join(
        own.select("raw_asset_id", "created_at", "source_id"), "raw_asset_id"
    )
    items = store.stage("normalized", items, batch_id)
    asked = items.select(F.col("canonical_url").alias("key"))
    log = store.keyed("canonical_urls", asked.schema)
    taken = log.lookup(asked, batch_id).withColumnRenamed("key", "canonical_url")
    store.write("items", normalize.assign_canonical_urls(items, ["created_at"], taken), batch_id)
    log.write(asked, batch_id)


def knowledge_batch(store: Store, runner: enrich.Runner, sources: DataFrame, batch_id: int) -> None:
    """Enrich the batch's items; invalid outputs are quarantined."""
    own = store.read("items").where(F.col("batch_id") == batch_id).drop("batch_id")
    topics = sources.select("source_id", F.col("topic").alias("source_topic"))
    ready = own.join(topics, "source_id", "left")
    # The runner answers once per item; both tables come from that answer.
    answers = store.stage("answers", enrich.run_and_validate(ready, runner), batch_id)
    valid, broken = enrich.split_valid(answers)
    valid = valid.join(own.select("item_id", "created_at"), "item_id").withColumn("version_id", F.lit(batch_id))
    store.write("enrichments", valid, batch_id)
    store.write("quarantine", broken, batch_id)


def preserve_batch(store: Store, destinations: DataFrame, batch_id: int) -> None:
    """Groups, memberships, notes, destination results and provenance of the batch's items."""
    own = store.read("items").where(F.col("batch_id") == batch_id).drop("batch_id")
    enriched = store.read("enrichments").where(F.col("batch_id") == batch_id).drop("batch_id", "title", "created_at")
    found, _ = batch_duplicates(store, "dedupe_keys", own, batch_id)
    joined = own.join(settle_duplicates(enriched.join(found, "item_id")), "item_id")
    settled = store.stage("settled", joined, batch_id)
    assigned = settled.select("item_id", "topic", F.col("created_at").alias("at"))
    write_groups(store, assigned, batch_id)
    built = notes.build_notes(settled.withColumn("baseline_score", F.col("importance_score")))
    rollup = notes.sync_rollup(built, destinations)
    store.write("notes", rollup.drop("destinations"), batch_id)
    store.write("destination_results", notes.destination_status(rollup), batch_id)
    tag = groups.group_id(text.slugify(text.blank_to_null(F.col("topic"))))
    noted = rollup.select("item_id", "note_id", "synced_destination_count")
    record = settled.join(noted, "item_id", "left").withColumn("group_id", tag).withColumn(
        "rationale", F.lit(None).cast("array<string>")
    )
    store.write(
        "provenance", record.select("item_id", history.processing_record().alias("record")), batch_id
    )


def _group_log(store: Store, item: DataType = StringType()) -> KeyedLog:
    schema = StructType().add("key", "string").add("at", "timestamp").add("item_id", item).add("title", "string").add("created_at", "timestamp")

    def merge(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("at", "item_id", "title")).alias("last")
        return rows.groupBy("key").agg(last, F.min("created_at").alias("created_at")).select("key", "last.*", "created_at")

    return store.keyed("groups", schema, merge)


def _member_log(store: Store) -> KeyedLog:
    schema = StructType().add("key", "string").add("at", "timestamp").add("topic", "string")

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max(F.struct("at", "topic")).alias("last")).select("key", "last.*")

    return store.keyed("memberships", schema, merge)


def write_groups(store: Store, assigned: DataFrame, batch_id: int) -> None:
    """The batch's assignments, merged with what earlier batches knew of the same tags.

    ``item_groups`` and ``item_group_members`` keep what each batch brought;
    ``stored_groups`` and ``stored_members`` are the state after it: one row per tag and
    one membership per item, so an item that changes topic leaves its old group.
    """
    store.write("item_groups", groups.topic_groups(assigned), batch_id)
    store.write("item_group_members", groups.topic_members(assigned), batch_id)
    topic = text.blank_to_null(F.col("topic"))
    tagged = assigned.select(
        text.slugify(topic).alias("key"), "at", "item_id", topic.alias("title"), F.col("at").alias("created_at")
    )
    _group_log(store, assigned.schema["item_id"].dataType).write(tagged.where("title is not null"), batch_id)
    latest = assigned.select(F.col("item_id").cast("string").alias("key"), "at", topic.alias("topic"))
    _member_log(store).write(latest, batch_id)


def stored_groups(store: Store, batch_id: int, item: DataType = StringType()) -> DataFrame:
    """Groups after ``batch_id``: one row per tag, the last title wins."""
    tags = _group_log(store, item).all(batch_id + 1)
    return tags.select(
        groups.group_id(F.col("key")).alias("group_id"),
        F.lit("topic").alias("group_type"),
        F.col("key").alias("tag"),
        "title",
        F.concat(F.lit("Items related to "), F.col("title"), F.lit(".")).alias("summary"),
        "created_at",
        F.col("at").alias("updated_at"),
    )


def stored_members(store: Store, batch_id: int) -> DataFrame:
    """The one membership of every item after ``batch_id``; none where its last topic was blank."""
    latest = _member_log(store).all(batch_id + 1).where("topic is not null")
    tag = text.slugify(F.col("topic"))
    return latest.select(groups.group_id(tag).alias("group_id"), F.col("key").alias("item_id"), tag.alias("tag"))


def _selectable(store: Store, batch_id: int) -> DataFrame:
    """All enriched items up to the batch, with duplicates settled."""
    every_item = store.read("items").where(F.col("batch_id") <= batch_id).drop("batch_id")
    versions = store.read("enrichments").where(F.col("batch_id") <= batch_id).drop("batch_id", "title")
    current = history.enrichment_history(versions).where("is_current").drop("is_current", "superseded_at")
    items = every_item.join(current.select("item_id"), "item_id", "left_semi")
    found = find_duplicates(items).select("item_id", "dedupe_key", "duplicate_of_item_id")
    return items.join(settle_duplicates(current.join(found, "item_id")).drop("created_at"), "item_id")


def _best(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` best rows of each audience with their rank and place."""
    placed = rows.drop("candidate_rank").withColumn("audience", F.lit("all")).withColumn("place", selection.candidate_place())
    return first_n_per_key(placed, ["audience"], n, "candidate_rank", F.asc("place"))


def select_batch(store: Store, sources: DataFrame, batch_id: int, policy=selection.Policy()) -> None:
    """The reading queue after a micro-batch, from the stored best candidates and the batch alone.

    ``selection_state`` holds twice the window. A batch adds its items and repairs stored
    ones whose key an earlier-created item now holds; those only lose places. Once rows
    were cut off, places up to the last stored one are certain (``floor``): rows
    beyond it could be behind ones that were cut. Only when fewer certain rows than
    the window are left is the state rebuilt from all items.
    """
    own = store.read("items").where(F.col("batch_id") == batch_id).drop("batch_id")
    enriched = store.read("enrichments").where(F.col("batch_id") == batch_id).drop("batch_id", "title", "created_at")
    own_items = own.join(enriched.select("item_id"), "item_id", "left_semi")
    found, firsts = batch_duplicates(store, "selectable_keys", own_items, batch_id)
    fresh = own_items.join(settle_duplicates(enriched.join(found, "item_id")), "item_id")
    size = 2 * policy.window

    shape = _best(fresh, size).withColumn("floor", F.col("place"))
    stored = store.read("selection_state", shape, before=batch_id)
    newest = stored.agg(F.max("batch_id")).scalar()
    held = stored.where(F.col("batch_id") == newest).drop("batch_id").join(firsts, "dedupe_key", "left")
    original = F.when(F.col("first.item_id") != F.col("item_id"), F.col("first.item_id"))
    held = settle_duplicates(
        held.withColumn("duplicate_of_item_id", F.when(F.col("first").isNotNull(), original).otherwise(F.col("duplicate_of_item_id")))
    ).drop("first")
    floor = held.agg(F.max("floor").alias("floor"))
    merged = held.drop("floor", "place", "audience", "candidate_rank")
    merged = merged.unionByName(fresh.select(*merged.columns))
    certain = (
        merged.withColumn("place", selection.candidate_place()).crossJoin(F.broadcast(floor))   # one row
        .where("floor is null or place <= floor")
    )
    best = store.stage("best", _best(certain, size + 1), batch_id)
    left = best.agg(F.count(F.lit(1)).alias("n"), F.max("floor").alias("floor")).first()
    if left["n"] < policy.window and newest is not None and floor.first()["floor"] is not None:
        best = store.stage("rebuilt", _best(_selectable(store, batch_id), size + 1).withColumn("floor", F.lit(None).cast(shape.schema["floor"].dataType)), batch_id)
        left = best.agg(F.count(F.lit(1)).alias("n"), F.max("floor").alias("floor")).first()
    cut = left["n"] > size or left["floor"] is not None
    kept = best.where(F.col("candidate_rank") <= size)
    last = kept.agg(F.max("place").alias("last"))
    mark = F.col("last") if cut else F.lit(None).cast(shape.schema["floor"].dataType)
    state = kept.drop("floor").crossJoin(F.broadcast(last)).withColumn("floor", mark).select(*shape.columns)
    store.write("selection_state", state, batch_id)

    window = kept.where(F.col("candidate_rank") <= policy.window).drop("place", "floor")
    tag = text.slugify(text.blank_to_null(F.col("topic")))
    window = store.stage("window", window.withColumn("key", tag), batch_id)
    titles = _group_log(store).lookup(window.select("key"), batch_id + 1).select("key", F.col("title").alias("topic_group_title"))
    named = sources.select("source_id", F.col("name").alias("source_name"))
    candidates = window.join(titles, "key", "left").drop("key").join(named, "source_id", "left")
    store.write("selections", selection.select_queue(candidates, policy).withColumn("run_id", F.lit(batch_id)), batch_id)


def rebuilt_selection(store: Store, sources: DataFrame, batch_id: int, policy=selection.Policy()) -> DataFrame:
    """Decisions as ``select_batch`` makes them, from all items up to the batch."""
    rows = _selectable(store, batch_id)
    assigned = rows.select("item_id", "topic", F.col("created_at").alias("at"))
    titles = groups.topic_titles(groups.topic_members(assigned), groups.topic_groups(assigned))
    named = sources.select("source_id", F.col("name").alias("source_name"))
    items = rows.withColumn("audience", F.lit("all"))
    ranked = selection.rank_candidates(
        items.withColumn("status", F.lit("processed")), rows.withColumn("is_current", F.lit(True)), policy
    )
    candidates = items.join(titles, "item_id", "left").join(named, "source_id", "left")
    return selection.select_queue(candidates.join(ranked.select("item_id", "candidate_rank"), "item_id"), policy)


def count_batch(store: Store, batch_id: int) -> None:
    """What each source's run persisted, normalized, processed and quarantined, stored with the batch."""

    def own(name: str) -> DataFrame:
        return store.read(name).where(F.col("batch_id") == batch_id)

    items = own("items").select("item_id", "source_id", "batch_id")
    counted = capture.run_counters({
        "persisted": own("raw_assets"),
        "normalized": items,
        "processed": items.join(own("enrichments").select("item_id"), "item_id", "left_semi"),
        "quarantined": items.join(own("quarantine").select("item_id"), "item_id", "left_semi"),
    })
    store.write("run_counters", counted.drop("batch_id"), batch_id)


def curation_batch(
    store: Store, runner: enrich.Runner, sources: DataFrame, destinations: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """The whole chain for one micro-batch, for ``foreachBatch``."""
    targets = notes.default_destinations(store.spark) if destinations is None else destinations

    def run(payloads: DataFrame, batch_id: int) -> None:
        for name in LOGS:
            store.keyed(name, StructType()).retire(batch_id)
        capture_batch(store, payloads, batch_id)
        knowledge_batch(store, runner, sources, batch_id)
        preserve_batch(store, targets, batch_id)
        select_batch(store, sources, batch_id)
        count_batch(store, batch_id)
        store.clear(batch_id)

    return run


def start_curation(
    payloads: DataFrame, store: Store, runner: enrich.Runner, sources: DataFrame, checkpoint: str, **trigger
) -> StreamingQuery:
    """Run the chain on a payload stream."""
    writer = payloads.writeStream.foreachBatch(curation_batch(store, runner, sources))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_sync_state(store: Store) -> DataFrame:
    """Sync state of every source from the outcomes of all batches."""
    return capture.sync_state(store.read("outcomes").drop("batch_id"))


def _sync_log(store: Store, source: DataType = StringType()) -> KeyedLog:
    schema = StructType().add("key", "string").add("source_id", source)
    for name in ("last_synced_at", "last_success_at", "last_error_at"):
        schema = schema.add(name, "timestamp")
    schema = schema.add("last_error_message", "string").add("source_status", "string").add("last_seq", "long")

    def merge(rows: DataFrame) -> DataFrame:
        return capture.merge_sync_states(rows).withColumn("key", F.col("source_id").cast("string"))

    return store.keyed("sync_state", schema, merge)


def sync_state_batch(store: Store) -> Callable[[DataFrame, int], None]:
    """Keep the sync state by event time, for ``foreachBatch``.

    A batch writes the state of its own sources only. States merge in any order, so late
    and repeated outcomes give the state of the ordered log: an outcome older than
    one known counts for the last success alone. Outcomes without a source have no state.
    """

    def run(outcomes: DataFrame, batch_id: int) -> None:
        log = _sync_log(store, outcomes.schema["source_id"].dataType)
        log.retire(batch_id)
        own = capture.marked_sync_state(outcomes.where("source_id is not null"))
        log.write(own.withColumn("key", F.col("source_id").cast("string")), batch_id)
        store.write("sync_batches", store.spark.range(1), batch_id)
        remove(store.spark, f"{store.path('sync_batches')}/batch_id={batch_id - 1}")

    return run


def stored_sync_state(store: Store, source: DataType = StringType()) -> DataFrame:
    """The state after the newest batch, one row per source; ``source`` is the type of its id."""
    newest = store.read("sync_batches").agg(F.max("batch_id")).scalar()
    last = store.spark.range(1).select(newest.alias("n")).first()["n"]
    return _sync_log(store, source).all(last + 1).drop("key", "last_seq")


def start_sync_state(outcomes: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Sync state that follows an outcome stream."""
    writer = outcomes.writeStream.foreachBatch(sync_state_batch(store))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Named queries: each runs an operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.functions import dates, text, urls, variants
from gleanery.operators import (
    capture, classify, context, dedupe, enrich, groups, history, integrity, normalize, notes, registry, score,
    selection,
)
from gleanery.plans import fixtures as fx, views
from gleanery.session import ensure_checkpoint_dir
from gleanery.sources import feeds, pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def joined(values: str | Column) -> Column:
    return F.array_join(values, "|")


def instant(name: str) -> Column:
    return dates.iso_utc(F.col(name)).alias(name.split(".")[-1])


def as_of() -> Column:
    return F.lit(fx.AS_OF).cast("timestamp")


# ------------------------------------------------------------------ reading queue
def _titles(spark, d):
    return groups.topic_titles(fx.topic_members(spark, d), fx.topic_groups(spark, d))


def _chain(spark, d):
    return fx.raw_assets(spark, d), fx.capture_entries(spark, d), fx.sources(spark, d)


def _candidates(spark, d, policy=selection.Policy()):
    return selection.assemble_candidates(
        fx.items(spark, d), fx.enrichments(spark, d), *_chain(spark, d), _titles(spark, d), policy
    )


def _enriched(spark, d):
    """Every item with its current enrichment and topic title."""
    current = fx.enrichments(spark, d).where("is_current").drop("created_at")
    return fx.items(spark, d).join(current, "item_id").join(_titles(spark, d), "item_id", "left")


def _decisions(spark, d, policy=selection.Policy()):
    return selection.select_queue(_candidates(spark, d, policy), policy)


@query
def inbox_candidates(spark, d):
    return _candidates(spark, d).select(
        "audience", "item_id", "candidate_rank", "title", "canonical_url", "source_name", "source_topic", "topic",
        "topic_group_title", "importance_score", "novelty_score", "preserve_recommendation",
        joined("tags").alias("tags"), instant("published_at"),
    )


@query
def content_quality(spark, d):
    return selection.with_content_quality(_enriched(spark, d)).select(
        "item_id", "body_meaningful", "summary_meaningful", "why_meaningful"
    )


@query
def inbox_scores(spark, d):
    return selection.with_selection_scores(_enriched(spark, d)).select(
        "item_id", "importance", "novelty", "quality_adjustment", "total_score"
    )


@query
def inbox_hard_filters(spark, d):
    scored = selection.with_selection_scores(_enriched(spark, d))
    return scored.select(
        "item_id", "total_score", joined(selection.hard_filter_reasons()).alias("reasons")
    )


@query
def inbox_select(spark, d):
    return _decisions(spark, d).select(
        "audience", "item_id", "candidate_rank", "stage", "selected", "relevance_score",
        joined("selection_reasons").alias("reasons"), "topic_slot", "source_slot", "selection_rank",
        "policy_version", F.col("score_breakdown.quality_adjustment").alias("quality_adjustment"),
        F.col("metadata.visible_body_eligible").alias("visible_body"),
        F.col("metadata.visible_summary_eligible").alias("visible_summary"),
        F.col("metadata.source_name").alias("source_name"),
    )


@query
def selection_summary(spark, d):
    return selection.selection_summary(_decisions(spark, d))


def _stored(decisions):
    """Decisions as a stored table: views read a selection, they never redo it."""
    ensure_checkpoint_dir(decisions.sparkSession)
    return decisions.checkpoint()


def _runs(spark, d):
    """Two runs of different policies over the same candidates."""
    strict = selection.Policy(version="v1", budget=4, max_per_topic=1)
    first = _decisions(spark, d, strict).withColumn("run_id", F.lit(1))
    return _stored(first.unionByName(_decisions(spark, d).withColumn("run_id", F.lit(2))))


@query
def selection_history(spark, d):
    return history.selection_history(_runs(spark, d)).select(
        "run_id", "audience", "item_id", "policy_version", "selected", "is_current"
    )


def _selected(spark, d):
    current = history.selection_history(_stored(_decisions(spark, d).withColumn("run_id", F.lit(1))))
    return views.selected_items(
        current, fx.items(spark, d), fx.enrichments(spark, d), *_chain(spark, d), _titles(spark, d)
    )


@query
def inbox_view(spark, d):
    rows = views.inbox_rows(_selected(spark, d)).orderBy(*views.inbox_order())
    return rows.select(
        "audience", "item_id", "title", "url", "source_name", "source_topic", "source_type_label", "summary_short",
        "published_at_label", "preview_label", "classification", "topic", "topic_group_title",
        joined("tags").alias("tags"), "relevance_score",
        F.col("score_breakdown.total_score").alias("total_score"),
        joined("selection_reasons").alias("reasons"), "policy_version",
    )


@query
def inbox_counters(spark, d):
    return views.inbox_counters(views.inbox_rows(_selected(spark, d)))


@query
def near_duplicate_titles(spark, d):
    return selection.near_duplicate_titles(fx.items(spark, d))


# ------------------------------------------------------------------ pages
@query
def html_to_text(spark, d):
    return fx.texts(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("content_text"))


@query
def page_article_extract(spark, d):
    return pages.extract_articles(fx.texts(spark, d, "pages")).select(
        "page_id", "title", "author", "language", "excerpt", "site_name", instant("published_at"),
        F.length("content_html").alias("html_length"), "content_text", "has_content",
    )


@query
def published_dates(spark, d):
    return pages.with_published_at(fx.dated_pages(spark, d)).select("page_id", instant("published_at"))


@query
def fetch_outcomes(spark, d):
    return pages.fetch_outcomes(fx.fetch_log(spark, d)).select(
        "page_id", "outcome", "code", "message", F.length("failed_body").alias("failed_body_length"),
        F.col("capture.contentType").alias("content_type"), F.col("capture.httpStatus").alias("http_status"),
        F.col("capture.extractionStatus").alias("extraction_status"),
        F.col("capture.fetchTimestamp").alias("fetch_timestamp"),
    )


@query
def page_assets(spark, d):
    assets = pages.page_assets(pages.fetch_outcomes(fx.fetch_log(spark, d)))

    def meta(path):
        return F.get_json_object("raw_metadata", path)

    return assets.select(
        "url", "asset_type", "status", "title", F.length("raw_content").alias("content_length"),
        meta("$.submittedUrl").alias("submitted_url"), meta("$.httpStatus").alias("http_status"),
        meta("$.contentTextLength").alias("text_length"), meta("$.failure.message").alias("failure_message"),
        meta("$.language").alias("language"),
    )


@query
def url_normalize(spark, d):
    url = F.col("url")
    return fx.table(spark, d, "pages").select(
        "page_id", urls.normalize(url).alias("normalized"),
        urls.problem(url, "Enter a valid article URL.", "Submitted URLs must use http or https.").alias("problem"),
    )


@query
def normalize_items(spark, d):
    assets = fx.page_assets(spark, d)
    done = assets.where("status = 'new'").selectExpr("raw_asset_id").where("raw_asset_id like '%7'")
    return normalize.normalize_assets(assets, done).select(
        "item_id", "title", "canonical_url", "language", "content_text", "status",
        F.col("metadata.connector_type").alias("connector_type"),
        F.col("metadata.external_id").alias("external_id"),
        F.col("metadata.extraction.content_length").alias("content_length"),
        F.col("metadata.extraction.content_source").alias("content_source"),
        F.col("metadata.extraction.text_format").alias("text_format"),
        F.col("metadata.extraction.http_status").alias("http_status"),
        F.col("metadata.rss.feed_title").alias("feed_title"),
        F.col("metadata.rss.feed_url").alias("feed_url"),
    )


def _canonical(spark, d):
    assets = fx.page_assets(spark, d).selectExpr(
        "raw_asset_id as item_id", "url as canonical_url", "created_at", "page_id % 9 = 0 as stored"
    )
    return normalize.assign_canonical_urls(
        assets.where("not stored").drop("stored"), ["created_at"], assets.where("stored")
    )


@query
def canonical_conflicts(spark, d):
    return _canonical(spark, d).select("item_id", "canonical_url", "canonical_url_conflict")


def _asset_outcomes(spark, d):
    assets = fx.page_assets(spark, d)
    failures = assets.where("raw_content is null").selectExpr(
        "raw_asset_id", "concat('no content in ', raw_asset_id) as message"
    )
    return normalize.apply_asset_outcomes(assets, failures)


@query
def entry_completion(spark, d):
    return normalize.entry_completion(_asset_outcomes(spark, d))


@query
def item_failures(spark, d):
    items = fx.items(spark, d).select("item_id", "status", "created_at")
    failures = items.where("status = 'new'").selectExpr(
        "item_id", "concat('failed on ', item_id) as message", "created_at as failed_at"
    )
    return normalize.annotate_item_failures(items, failures).select(
        "item_id", "status", "processing_status", "last_error", instant("failed_at")
    )


# ------------------------------------------------------------------ knowledge
@query
def item_context(spark, d):
    items = fx.items(spark, d).select("item_id", "raw_asset_id")
    return context.item_context(items, *_chain(spark, d)).drop("raw_asset_id")


@query
def pending_items(spark, d):
    items = fx.items(spark, d).select("item_id", "status")
    again = fx.table(spark, d, "labels").where("toxic = 1").selectExpr("doc_id as item_id")
    return context.pending_items(items, fx.enrichments(spark, d).where("item_id % 31 <> 9"), reprocess=again)


def _with_context(spark, d):
    return context.item_context(fx.items(spark, d), *_chain(spark, d))


@query
def score_items(spark, d):
    return score.with_rule_scores(_with_context(spark, d), as_of()).select(
        "item_id", "importance_score", "novelty_score", joined("rationale").alias("rationale")
    )


@query
def dedupe_items(spark, d):
    found = dedupe.find_duplicates(fx.items(spark, d))
    scored = fx.enrichments(spark, d).where("is_current").select(
        "item_id", "novelty_score", "preserve_recommendation"
    )
    return dedupe.settle_duplicates(scored.join(found, "item_id")).drop("created_at")


@query
def dedupe_matches(spark, d):
    return dedupe.matched_items(dedupe.find_duplicates(fx.items(spark, d))).select(
        "dedupe_key", "item_id", instant("created_at")
    )


@query
def classify_items(spark, d):
    return classify.classify(_with_context(spark, d)).select(
        "item_id", "classification", "topic", joined("tags").alias("tags")
    )


def topic_times(spark, d):
    """Topics assigned over time: each item twice, some to another topic first."""
    first = fx.items(spark, d).selectExpr(
        "item_id",
        "case item_id % 6 when 2 then 'RESEARCH!' when 3 then ' ' else item_topic end as topic",
        "created_at as at",
    )
    second = classify.classify(_with_context(spark, d)).selectExpr(
        "item_id", "case when item_id % 10 = 1 then ' ' else topic end as topic",
        "created_at + interval 1 day as at",
    )
    return first.unionByName(second)


@query
def topic_groups(spark, d):
    return groups.topic_groups(topic_times(spark, d)).select(
        "tag", "title", "summary", instant("created_at"), instant("updated_at")
    )


@query
def topic_members(spark, d):
    return groups.topic_members(topic_times(spark, d)).select("item_id", "tag")


@query
def membership_replace(spark, d):
    members = fx.topic_members(spark, d).select("item_id", "group_id")
    touched = topic_times(spark, d).join(
        fx.table(spark, d, "labels").selectExpr("doc_id as item_id"), "item_id", "left_semi"
    )
    return groups.replace_memberships(members, touched)


@query
def topic_titles(spark, d):
    return _titles(spark, d)


def _notes(spark, d):
    enriched = _enriched(spark, d).withColumn("baseline_score", F.lit(0.3))
    return notes.build_notes(enriched)


@query
def notes_build(spark, d):
    return _notes(spark, d).select(
        "item_id", "title", "note_type", "body_md", joined("highlights").alias("highlights"),
        joined("tags").alias("tags"), "review_weight",
    )


def _destinations(spark, d):
    return notes.with_missing_defaults(fx.destinations(spark, d))


@query
def note_sync(spark, d):
    return notes.sync_notes(_notes(spark, d), _destinations(spark, d)).select(
        "note_id", "item_id", "destination_id", "destination_type", "external_ref", "message", "status",
        instant("synced_at"),
    )


@query
def note_sync_rollup(spark, d):
    return notes.sync_rollup(_notes(spark, d), _destinations(spark, d)).select(
        "item_id", "synced_destination_count",
        F.col("destinations")["notion"]["destination_id"].alias("notion_destination"),
        F.col("destinations")["obsidian"]["external_ref"].alias("obsidian_ref"), instant("last_succeeded_at"),
    )


@query
def destination_status(spark, d):
    return notes.destination_status(notes.sync_rollup(_notes(spark, d), _destinations(spark, d))).withColumn(
        "synced_at", dates.iso_utc(F.col("synced_at"))
    )


@query
def destination_list(spark, d):
    return views.destination_list(notes.with_missing_defaults(fx.destinations(spark, d)))


@query
def knowledge_view(spark, d):
    rows = views.knowledge_rows(
        notes.sync_rollup(_notes(spark, d), _destinations(spark, d)), fx.items(spark, d), *_chain(spark, d)
    ).orderBy(*views.note_order())
    return rows.select(
        "item_id", "title", "type_label", "body_preview", "review_weight_label", "published_at_label",
        "source_name", "topic", joined("tags").alias("tags"),
        F.size("destination_statuses").alias("destination_count"),
    )


@query
def markdown_preview(spark, d):
    body = F.concat(F.lit("# "), F.substring("text", 1, 20), F.lit("\n\n[x](y) *"), "text", F.lit("*"))
    return fx.texts(spark, d, "documents").select("doc_id", text.markdown_preview(body).alias("preview"))


# ------------------------------------------------------------------ feeds and capture
def _feed_columns(assets):
    return assets.select(
        "payload_id", "source_id", "pos", "external_id", "title", "author", "url", instant("published_at"),
        "raw_content", F.col("feed.title").alias("feed_title"), F.col("feed.site_url").alias("feed_site_url"),
        F.col("feed.language").alias("feed_language"), F.col("feed.description").alias("feed_description"),
    )


@query
def feed_rss_assets(spark, d):
    return _feed_columns(feeds.feed_assets(fx.rss_payloads(spark, d))[0])


@query
def feed_atom_assets(spark, d):
    return _feed_columns(feeds.feed_assets(fx.atom_payloads(spark, d))[0])


@query
def feed_dispatch(spark, d):
    usable = F.col("error").isNull()
    return feeds.feed_rows(fx.mixed_payloads(spark, d)).select(
        "payload_id", F.when(usable, F.col("feed_kind")).alias("feed_kind"), "external_id", "error"
    )


def _captured(spark, d, **options):
    entries = fx.feed_entries(spark, d)
    stored = entries.where("stored").select("source_id", "external_id", "url")
    return capture.capture_dedupe(entries.where("not stored").drop("stored"), stored, **options)


@query
def capture_dedupe(spark, d):
    return _captured(spark, d).select("row_id", "source_id", "batch_id", "decision")


@query
def capture_dedupe_rounds(spark, d):
    return _captured(spark, d, fold_limit=0).select("row_id", "source_id", "batch_id", "decision")


@query
def capture_dedupe_chain(spark, d):
    """Events as entries that share an id, then a URL, with the next one: chains of up to 2500 rows a source."""
    entries = fx.table(spark, d, "events").selectExpr(
        "event_id as row_id", "event_id div 2500 as source_id", "cast(1 as bigint) as batch_id", "event_id as pos",
        "concat('c', (event_id + 1) div 2) as external_id",
        "if(event_id % 97 <> 50, concat('d', event_id div 2), null) as url",
    )
    stored = entries.where("row_id % 2500 = 1200").selectExpr("source_id", "external_id", "cast(null as string) as url")
    return capture.capture_dedupe(entries, stored).select("row_id", "source_id", "batch_id", "decision")


@query
def capture_runs(spark, d):
    return capture.capture_runs(_captured(spark, d))


def _fetches(spark, d):
    """Fetches of the outcome log; every seventh one failed, every fifth good one was empty."""
    return fx.table(spark, d, "events").selectExpr(
        "user_id % 20 as source_id", "event_id as batch_id", "event_id % 7 = 0 as failed", "event_id % 5 = 0 as empty",
        "concat('status ', event_type) as message",
    )


@query
def fetch_runs(spark, d):
    """Started, failed and completed runs, those of empty feeds too."""
    fetches = _fetches(spark, d)
    good = fetches.where("not failed")
    entries = good.where("not empty").withColumn("decision", F.expr("if(batch_id % 2 = 0, 'kept', 'known')"))
    done = capture.capture_runs(entries, good)
    started = capture.started_runs(fetches)
    failed = capture.failed_runs(fetches.where("failed"))
    rows = done.unionByName(started, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)
    return rows.select(
        "source_id", "batch_id", "phase", "entry_status", "fetched_count", "persisted_count", "skipped_count",
        "normalization_phase", "normalization_reason", "message",
    )


@query
def sync_cursor(spark, d):
    return capture.sync_cursors(fx.feed_entries(spark, d))


@query
def sync_cursor_members(spark, d):
    return capture.cursor_members(fx.feed_entries(spark, d)).withColumn(
        "latest_published_at", dates.iso_utc(F.col("latest_published_at"))
    )


@query
def identity_keys(spark, d):
    return capture.identity_keys(fx.feed_entries(spark, d))


def _state(spark, d):
    return capture.sync_state(fx.outcomes(spark, d))


@query
def sync_state(spark, d):
    return _state(spark, d).select(
        "source_id", instant("last_synced_at"), instant("last_success_at"), instant("last_error_at"),
        "last_error_message", "source_status",
    )


def _event_sources(spark, d):
    """Sources from events; some are paused, some have no sync state yet."""
    return (
        fx.table(spark, d, "events")
        .groupBy(F.expr("user_id % 26").alias("source_id"))
        .agg(F.min("ts").cast("timestamp").alias("created_at"), F.max("ts").cast("timestamp").alias("updated_at"))
        .selectExpr(
            "source_id", "concat('Source ', source_id) as name", "'rss' as source_type",
            "case when source_id % 9 = 8 then '' else concat('https://example.com/', source_id) end as source_url",
            "case source_id % 5 when 3 then 'paused' when 4 then 'error' else 'active' end as status",
            "created_at", "updated_at",
        )
    )


@query
def source_status(spark, d):
    state = _state(spark, d).drop("source_status")
    rows = registry.newest_first(registry.source_status(_event_sources(spark, d), state))
    return rows.select("source_id", "name", "status", "refusal", "badge_label", "badge_tone", "detail")


@query
def sync_state_backfill(spark, d):
    state = _state(spark, d).drop("source_status")
    return registry.backfill_sync_state(_event_sources(spark, d), state).select(
        "source_id", instant("last_synced_at"), instant("last_success_at"), "last_error_message"
    )


@query
def source_register(spark, d):
    requests = fx.registrations(spark, d)
    existing = requests.where("request_id % 10 = 5").select(urls.normalize(F.col("source_url")).alias("source_ref"))
    return registry.register_sources(requests, existing.distinct()).select(
        "request_id", "name", "source_ref", "topic", "source_id", "rejection"
    )


@query
def source_commands(spark, d):
    return registry.check_commands(fx.commands(spark, d)).select("command_id", "action", "rejection")


@query
def cascade_deletes(spark, d):
    """Entries of sources that commands have deleted lose their source; sync states go."""
    left = registry.apply_commands(registry.check_commands(fx.commands(spark, d))).select("source_id")
    entries = fx.commands(spark, d).selectExpr("command_id as entry_id", "source_id")
    kept = registry.cascade_deletes(entries, left, keep_rows=True).selectExpr("'entry' as kind", "entry_id", "source_id")
    states = registry.cascade_deletes(entries, left, keep_rows=False).selectExpr("'state' as kind", "entry_id", "source_id")
    return kept.unionByName(states)


@query
def source_table(spark, d):
    left = registry.apply_commands(registry.check_commands(fx.commands(spark, d)))
    return left.select("source_id", "status", instant("created_at"), instant("updated_at"))


# ------------------------------------------------------------------ enrichment
@query
def enrichment_validate(spark, d):
    return enrich.validate_outputs(fx.model_outputs(spark, d)).select(
        "item_id", "error", *[
            F.when(F.col("error").isNull(), F.col(name)).alias(name)
            for name in ("summary_short", "summary_long", "classification", "topic", "importance_score", "novelty_score")
        ],
        F.when(F.col("error").isNull(), joined("key_points")).alias("key_points"),
    )


@query
def enrichment_rules(spark, d):
    valid, _ = enrich.enrich(_with_context(spark, d), enrich.rule_runner(as_of()))
    return valid.select(
        "item_id", "importance_score", "novelty_score", "classification", "topic", "preserve_recommendation",
        joined("tags").alias("tags"), F.size("key_points").alias("key_point_count"),
    )


@query
def model_requests(spark, d):
    return _with_context(spark, d).select("item_id", enrich.request_json().alias("request"))


@query
def model_responses(spark, d):
    return fx.model_responses(spark, d).select(
        "conv_id", "turn", enrich.response_text(F.col("response")).alias("output_text")
    )


def versions(spark, d):
    return fx.enrichments(spark, d).selectExpr(
        "item_id", "version_id", "created_at", "importance_score", "preserve_recommendation"
    )


def later_versions(spark, d):
    return fx.table(spark, d, "labels").selectExpr(
        "doc_id as item_id", "2 as version_id", f"{fx.at_seconds(fx._FEB_1, 'doc_id + 3 * 86400')} as created_at",
        "0.25D as importance_score", "'review' as preserve_recommendation",
    )


@query
def enrichment_history(spark, d):
    return history.enrichment_history(versions(spark, d)).select(
        "item_id", "version_id", "importance_score", instant("created_at"), instant("superseded_at"), "is_current"
    )


@query
def enrichment_rewrite(spark, d):
    base = history.enrichment_history(versions(spark, d))
    return history.rewrite_history(base, later_versions(spark, d)).select(
        "item_id", "version_id", "importance_score", instant("created_at"), instant("superseded_at"), "is_current"
    )


@query
def processing_record(spark, d):
    items = fx.items(spark, d)
    current = fx.enrichments(spark, d).where("is_current").drop("created_at", "dedupe_key")
    found = dedupe.find_duplicates(items).drop("created_at")
    settled = items.drop("duplicate_of_item_id").join(current, "item_id").join(found, "item_id")
    built = notes.build_notes(settled.withColumn("baseline_score", F.lit(0.3)))
    noted = notes.sync_rollup(built, _destinations(spark, d)).select("item_id", "note_id", "synced_destination_count")
    record = settled.join(noted, "item_id", "left").select(
        "*", F.array(F.lit("rules")).alias("rationale"), groups.group_id(text.slugify(F.col("topic"))).alias("group_id")
    )
    return record.select("item_id", history.processing_record().alias("r")).select(
        "item_id", joined("r.order").alias("step_order"), F.col("r.status").alias("status"),
        F.col("r.note_status").alias("note_status"), F.col("r.steps.dedupe.dedupe_key").alias("dedupe_key"),
        F.col("r.steps.classify.topic").alias("topic"), F.col("r.steps.group.group_id").alias("group_id"),
        F.col("r.steps.summarize.key_point_count").alias("key_point_count"),
        F.col("r.steps.preserve.note_id").alias("note_id"),
        F.col("r.steps.preserve.synced_count").alias("synced_count"),
    )


@query
def insert_missing(spark, d):
    base = fx.items(spark, d).where("item_id % 3 = 0").selectExpr("item_id", "title", "0 as revision")
    delta = fx.enrichments(spark, d).selectExpr("item_id", "summary_short as title", "version_id + 1 as revision")
    return history.insert_missing(base, delta, ["item_id"], F.desc("revision"))


@query
def upsert_notes(spark, d):
    base = fx.items(spark, d).selectExpr("item_id", "title", "0 as revision", "created_at as updated_at")
    delta = fx.enrichments(spark, d).selectExpr(
        "item_id + 40 as item_id", "summary_short as title", "version_id + 1 as revision", "created_at as updated_at"
    )
    return history.upsert(base, delta, ["item_id"], F.desc("updated_at")).select(
        "item_id", "title", "revision", instant("updated_at")
    )


def _curation_tables(spark, d):
    """Curation tables with violations: repeated assets and URLs, and items or groups that are missing."""
    items = fx.items(spark, d).selectExpr("item_id", "if(item_id % 50 = 7, 'a-7', raw_asset_id) as raw_asset_id", "canonical_url")
    return {
        "raw_assets": fx.raw_assets(spark, d).select("raw_asset_id", "capture_entry_id"),
        "items": items.where("item_id % 31 <> 5"),
        "enrichments": fx.enrichments(spark, d).select("item_id", "is_current"),
        "item_group_members": fx.topic_members(spark, d).select("group_id", "item_id"),
    }


@query
def curation_integrity(spark, d):
    return integrity.curation_report(_curation_tables(spark, d))


@query
def curation_integrity_delta(spark, d):
    """The same violations found by a change: rows of items 31k+5 are removed, those of items 50k+7 and their children added."""
    after = _curation_tables(spark, d)
    whole = fx.items(spark, d).select("item_id", "raw_asset_id", "canonical_url")
    sound = whole.withColumn("canonical_url", F.when(F.col("item_id") < 150, F.col("canonical_url")))
    shared = after["items"].where("item_id >= 150 and canonical_url is not null or item_id % 50 = 7")
    replaced = sound.join(shared.select("item_id"), "item_id", "left_semi")
    members = after["item_group_members"]
    return integrity.curation_report_delta(
        {"raw_assets": after["raw_assets"], "items": sound, "enrichments": after["enrichments"], "item_group_members": members},
        {"items": shared},
        {"items": sound.where("item_id % 31 = 5").unionByName(replaced.where("item_id % 31 <> 5"))},
    )


@query
def nested_flags(spark, d):
    """Duplicate flags read from item metadata: texts count; numbers, nulls, lists and missing records do not."""
    nested = lambda value: f"to_json(named_struct('knowledgeProcessing', named_struct('duplicateOfItemId', {value}, 'title', text)))"
    record = f"""case doc_id % 7 when 0 then {nested("concat('item-', doc_id)")} when 1 then {nested("doc_id")}
      when 2 then '{{"knowledgeProcessing":{{"duplicateOfItemId":null}}}}' when 3 then {nested("array('item-1')")}
      when 4 then {nested("' '")} when 5 then '{{"knowledgeProcessing":["item-1"]}}' else if(doc_id % 2 = 0, '{{}}', null) end"""
    rows = fx.table(spark, d, "documents").selectExpr("doc_id as item_id", f"try_parse_json({record}) as metadata")
    return rows.select("item_id", variants.duplicate_of(F.col("metadata")).alias("duplicate_of_item_id"))


@query
def run_counters(spark, d):
    """Rows persisted, normalized, processed and quarantined of every run."""
    kept = _captured(spark, d).where("decision = 'kept'").select("row_id", "source_id", "batch_id")
    outputs = fx.model_outputs(spark, d)
    valid, broken = enrich.split_valid(enrich.validate_outputs(outputs))
    own = lambda rows: kept.join(rows.select(F.col("item_id").alias("row_id")).distinct(), "row_id", "left_semi")
    return capture.run_counters(
        {"persisted": kept, "normalized": kept.where("row_id % 11 <> 4"), "processed": own(valid), "quarantined": own(broken)}
    )


@query
def integrity_report(spark, d):
    t = lambda name: fx.table(spark, d, name)
    return integrity.report(
        integrity.duplicate_keys(t("orders"), ["o_custkey", "o_orderdate"], "unique orders(customer,date)"),
        integrity.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"], "unique lineitem(order,line)"),
        # texts are hashed before they are grouped, so no text is shuffled
        integrity.duplicate_keys(t("documents").select(F.md5("text").alias("text")), ["text"], "unique documents(text)"),
        integrity.orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "reference lineitem.orderkey"),
        integrity.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey", "reference orders.custkey"),
        integrity.orphans(t("documents"), "doc_id", t("labels"), "doc_id", "reference documents.doc_id"),
    )

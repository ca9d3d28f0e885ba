"""Feed capture: unseen assets, counts, cursors, sync state, run records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.functions import dates, text
from gleanery.functions.staging import with_once
from gleanery.operators import chains
from gleanery.operators.skew import SCATTER, lookup
from gleanery.session import ensure_checkpoint_dir

FOLD_LIMIT = 1 << 16     # entries of one batch decided by a single in-memory fold

_SEP = "\u0002"


def _key(*parts: Column) -> Column:
    return F.concat_ws(_SEP, *[part.cast("string") for part in parts])


def _present(name: str):
    """Identity values are compared as they are; an empty text is no identity."""
    return F.nullif(F.col(name), F.lit(""))


def identity_keys(df: DataFrame) -> DataFrame:
    """One row per (source, kind, value) a set of assets is known by."""
    kinds = F.array(
        F.struct(F.lit("externalId").alias("kind"), _present("external_id").alias("value")),
        F.struct(F.lit("url").alias("kind"), _present("url").alias("value")),
    )
    return (
        df.select("source_id", F.explode(kinds).alias("k"))
        .select("source_id", "k.kind", "k.value")
        .where("value is not null")
        .distinct()
    )


def flag_known(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``known``: a stored asset of the same source has the id or the URL.

    One equi-join per kind of key; an OR condition would be a nested loop.
    """
    out = entries
    for name in ("external_id", "url"):
        seen = (
            stored.where(_present(name).isNotNull())
            .select("source_id", F.col(name).alias("_seen"))
            .distinct()
            .withColumn(f"_known_{name}", F.lit(True))
        )
        # rows without the key match nothing; scattered, they do not pile up in one partition
        scattered = F.concat(F.lit("\u0001none:"), F.pmod(F.xxhash64("row_id"), F.lit(SCATTER)).cast("string"))
        keyed = out.withColumn("_seen", F.coalesce(_present(name), scattered))
        out = keyed.join(seen, ["source_id", "_seen"], "left").drop("_seen")
    known = F.col("_known_external_id").isNotNull() | F.col("_known_url").isNotNull()
    return out.withColumn("known", known).select(*entries.columns, "known")


def _numbered(key: str) -> Column:
    """Numbers from 1 for the keys of a scope, null without one."""
    return F.when(F.col(key).isNotNull(), F.dense_rank().over(Window.partitionBy("scope").orderBy(key)))


def _fold_small(pairs: DataFrame) -> DataFrame:
    """Greedy choice of batches small enough to sit in one row.

    The walk keeps one byte for each key: taken or not. Looking one up takes no time,
    and setting one copies at most ``fold_limit`` bytes, so no step searches a list of keys.
    """
    queue = F.array_sort(F.collect_list(F.struct("pos", "row_id", "ext", "url")))
    none = F.repeat(F.lit("0"), F.size("queue") + 1).cast("binary")
    yes, no = F.lit(b"1"), F.lit(b"0")
    start = F.struct(none.alias("ext"), none.alias("url"), F.lit(b"").alias("verdicts"))

    def taken(state, entry):
        held = [F.coalesce(F.substring(state[k], entry[k], F.lit(1)) == yes, F.lit(False)) for k in ("ext", "url")]
        return held[0] | held[1]

    def marked(seen, place):
        return F.when(place.isNull(), seen).otherwise(F.overlay(seen, yes, place, 1))

    def step(state, entry):
        after = [marked(state[k], entry[k]).alias(k) for k in ("ext", "url")]
        return F.when(
            taken(state, entry),
            F.struct(state["ext"].alias("ext"), state["url"].alias("url"), F.concat(state["verdicts"], no).alias("verdicts")),
        ).otherwise(F.struct(*after, F.concat(state["verdicts"], yes).alias("verdicts")))

    queued = (
        pairs.select("scope", "pos", "row_id", _numbered("ext_key").alias("ext"), _numbered("url_key").alias("url"))
        .groupBy("scope")
        .agg(queue.alias("queue"))
    )
    walked = with_once(queued, verdicts=F.aggregate("queue", start, step)["verdicts"])
    kept = F.filter("queue", lambda entry, place: F.substring("verdicts", place + 1, F.lit(1)) == yes)
    return walked.select(F.explode(kept).alias("entry")).select("entry.row_id")


def _choose(rows: DataFrame, fold_limit: int) -> DataFrame:
    """Fold what is small; take large batches through rounds until it is.

    Every round settles whole chains of rows that block each other, and of
    ordinary feeds nearly all rows. Rounds are map-side combined aggregation plus
    joins, and checkpointed, so neither plan nor lineage grows.
    """
    chosen = []
    while True:
        large = (
            rows.groupBy("scope").agg(F.count("*").alias("scope_rows")).where(F.col("scope_rows") > fold_limit)
        )
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*chosen, _fold_small(rows)])
        ensure_checkpoint_dir(rows.sparkSession)
        sized = lookup(rows, large, "scope", ["scope_rows"], weight="scope_rows", spread=["row_id"])
        chosen.append(_fold_small(sized.where("scope_rows is null")))
        kept, rows = chains.settle(sized.where("scope_rows is not null"))
        chosen.append(kept)


def choose_unseen(entries: DataFrame, *, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Row ids kept when each batch is walked in feed order; ``pos`` is unique in its batch.

    An entry is dropped when an earlier *kept* entry of its batch has its
    external id or its URL; dropped entries block nothing. Exact copies are
    merged first, then small batches are folded in place and large ones decided
    in rounds.
    """
    scope = _key(F.col("source_id"), F.col("batch_id"))
    keyed = entries.select(
        scope.alias("scope"),
        "pos",
        "row_id",
        *[
            F.when(_present(name).isNotNull(), _key(scope, F.lit(kind), F.col(name))).alias(alias)
            for name, kind, alias in (("external_id", "e", "ext_key"), ("url", "u", "url_key"))
        ],
    )
    anonymous = keyed.where("ext_key is null and url_key is null").select("row_id")
    pairs = (
        keyed.where("ext_key is not null or url_key is not null")
        .groupBy("scope", "ext_key", "url_key")
        .agg(F.min(F.struct("pos", "row_id")).alias("f"))
        .select("scope", "ext_key", "url_key", "f.pos", "f.row_id")
    )
    # Positions are unique inside a scope only; the keys carry their scope.
    return anonymous.unionByName(_choose(pairs, fold_limit))


def capture_dedupe(entries: DataFrame, stored: DataFrame, *, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Identity columns with ``decision``: kept, known (stored before) or batch_duplicate.

    ``entries``: row_id, source_id, batch_id, pos (any orderable value, unique in
    its batch), external_id, url.
    ``stored``: source_id, external_id, url.
    """
    ensure_checkpoint_dir(entries.sparkSession)
    columns = ["row_id", "source_id", "batch_id", "pos", "external_id", "url"]
    # Narrow, and read three times below: sizes, choice and verdict.
    flagged = flag_known(entries.select(*columns), stored).checkpoint()
    kept = choose_unseen(flagged.where("not known"), fold_limit=fold_limit)
    kept = kept.withColumn("_kept", F.lit(True))
    decision = (
        F.when(F.col("known"), "known").when(F.col("_kept"), "kept").otherwise("batch_duplicate")
    )
    return flagged.join(kept, "row_id", "left").withColumn("decision", decision).drop("known", "_kept")


def capture_runs(decided: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """One run record per source and batch, with counts and final phase.

    ``fetches`` (source_id, batch_id) lists the good fetches; one that brought no
    entry has a run with zero counts too.
    """
    counts = decided.groupBy("source_id", "batch_id").agg(
        F.count("*").alias("fetched_count"),
        F.count_if(F.col("decision") == "kept").alias("persisted_count"),
        F.count_if(F.col("decision") != "kept").alias("skipped_count"),
    )
    if fetches is not None:
        every = fetches.select("source_id", "batch_id").distinct()
        counts = every.join(counts, ["source_id", "batch_id"], "left").na.fill(
            0, ["fetched_count", "persisted_count", "skipped_count"]
        )
    nothing_new = F.col("persisted_count") == 0
    return counts.select(
        "*",
        F.lit("completed").alias("phase"),
        F.when(nothing_new, "normalized").otherwise("captured").alias("entry_status"),
        F.when(nothing_new, "skipped").alias("normalization_phase"),
        F.when(nothing_new, "no_new_raw_assets").alias("normalization_reason"),
    )


def started_runs(requests: DataFrame) -> DataFrame:
    """Run records of fetches that are under way: (source_id, batch_id)."""
    return requests.select(
        "source_id", "batch_id", F.lit("started").alias("phase"), F.lit("captured").alias("entry_status")
    )


def failed_runs(failures: DataFrame) -> DataFrame:
    """Run records of fetches that failed: (source_id, batch_id, message)."""
    return failures.select(
        "source_id",
        "batch_id",
        F.lit("failed").alias("phase"),
        F.lit("failed").alias("entry_status"),
        "message",
    )


def cursor_members(entries: DataFrame) -> DataFrame:
    """Distinct ids and URLs of each batch's latest instant, in feed order.

    Without any date the first entry stands in. One row per member, so the
    size of a batch does not matter.
    """
    scope = ["source_id", "batch_id"]
    heads = entries.groupBy(*scope).agg(
        F.max("published_at").alias("latest"), F.min("pos").alias("first_pos"), F.count("*").alias("n")
    )
    keyed = entries.withColumn("_scope", _key(F.col("source_id"), F.col("batch_id")))
    heads = heads.select(
        _key(F.col("source_id"), F.col("batch_id")).alias("_scope"), "latest", "first_pos", "n"
    )
    joined = lookup(keyed, heads, "_scope", ["latest", "first_pos"], weight="n", spread=["pos"])
    at_latest = (F.col("published_at") == F.col("latest")) | (
        F.col("latest").isNull() & (F.col("pos") == F.col("first_pos"))
    )
    kinds = F.array(
        F.struct(F.lit("externalId").alias("kind"), F.col("external_id").alias("value")),
        F.struct(F.lit("url").alias("kind"), F.col("url").alias("value")),
    )
    return (
        joined.where(at_latest)
        .select(*scope, "latest", "pos", F.explode(kinds).alias("k"))
        .where(text.is_present(F.col("k.value")))
        .groupBy(*scope, F.col("k.kind").alias("kind"), F.col("k.value").alias("value"))
        .agg(F.min("pos").alias("first_pos"), F.max("latest").alias("latest_published_at"))
    )


def sync_cursors(entries: DataFrame) -> DataFrame:
    """The cursor text of every batch.

    A batch is what one fetch returned, that is one feed document, so its members
    were in one row before and fit in one again.
    """
    scope = ["source_id", "batch_id"]
    counts = entries.groupBy(*scope).agg(F.max("published_at").alias("latest"))

    def values(kind):
        of_kind = F.filter("listed", lambda m: m["kind"] == kind)
        return F.transform(of_kind, lambda m: m["value"])

    listed = cursor_members(entries).groupBy(*scope).agg(
        F.array_sort(F.collect_list(F.struct("first_pos", "kind", "value"))).alias("listed")
    )
    empty = F.array().cast(listed.schema["listed"].dataType)
    joined = counts.join(listed, scope, "left").withColumn("listed", F.coalesce(F.col("listed"), empty))
    cursor = F.to_json(
        F.struct(
            values("externalId").alias("latestExternalIds"),
            dates.iso_utc(F.col("latest")).alias("latestPublishedAt"),
            values("url").alias("latestUrls"),
        ),
        {"ignoreNullFields": "false"},
    )
    return joined.select(
        *scope,
        dates.iso_utc(F.col("latest")).alias("latest_published_at"),
        F.size("listed").cast("bigint").alias("member_count"),
        cursor.alias("cursor"),
    )


def sync_state(outcomes: DataFrame) -> DataFrame:
    """Latest sync state per source from an outcome log.

    ``outcomes``: source_id, at, seq, ok, message. A success clears the error;
    a failure keeps the last success.
    """
    order = F.struct("at", "seq")
    state = outcomes.groupBy("source_id").agg(
        F.max("at").alias("last_synced_at"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"),
        F.max_by(F.struct("ok", "at", "message"), order).alias("last"),
    )
    failed = ~F.col("last.ok")
    return state.select(
        "source_id",
        "last_synced_at",
        "last_success_at",
        F.when(failed, F.col("last.at")).alias("last_error_at"),
        F.when(failed, text.shorten_error(F.col("last.message"))).alias("last_error_message"),
        F.when(failed, "error").otherwise("active").alias("source_status"),
    )


def marked_sync_state(outcomes: DataFrame) -> DataFrame:
    """``sync_state`` with last_seq, the number of the outcome it ends with, for ``merge_sync_states``."""
    last = outcomes.groupBy("source_id").agg(F.max(F.struct("at", "seq")).alias("mark"))
    return sync_state(outcomes).join(last.select("source_id", F.col("mark.seq").alias("last_seq")), "source_id")


def merge_sync_states(states: DataFrame) -> DataFrame:
    """One state per source from several, each of another part of the outcomes.

    The order and grouping of the parts do not matter, nor that they overlap: what is latest
    by time and number counts, whenever it arrived.
    """
    last = F.struct("last_error_at", "last_error_message", "source_status", "last_seq")
    return states.groupBy("source_id").agg(
        F.max("last_synced_at").alias("last_synced_at"),
        F.max("last_success_at").alias("last_success_at"),
        F.max_by(last, F.struct("last_synced_at", "last_seq", "source_status", "last_error_message")).alias("last"),
    ).select("source_id", "last_synced_at", "last_success_at", "last.*")


def run_counters(stages: dict[str, DataFrame]) -> DataFrame:
    """(source_id, batch_id, <stage>_count ...): rows every stage of a run handled, in one aggregation.

    ``stages``: name to rows with source_id and batch_id, for example persisted,
    normalized, processed and quarantined. A run that any stage saw has a row.
    """
    marked = [rows.select("source_id", "batch_id", F.lit(name).alias("stage")) for name, rows in stages.items()]
    return reduce(DataFrame.unionByName, marked).groupBy("source_id", "batch_id").agg(
        *[F.count_if(F.col("stage") == name).alias(f"{name}_count") for name in stages]
    )

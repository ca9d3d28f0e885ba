"""The reading queue: candidates, scores, filters and budgeted diverse choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gleanery import fixed_values as V
from gleanery.functions import quality, text
from gleanery.operators.context import item_context
from gleanery.operators.skew import Narrow, first_n_per_key, lookup
from gleanery.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Policy:
    """Limits of one selection run."""

    version: str = V.POLICY_VERSION
    budget: int = V.SELECTION_BUDGET
    window: int = V.CANDIDATE_WINDOW
    max_per_topic: int = V.MAX_PER_TOPIC
    max_per_source: int = V.MAX_PER_SOURCE
    min_score: float = V.MIN_REVIEW_SCORE


def weighted_signal(importance: Column, novelty: Column) -> Column:
    return importance * F.lit(0.65) + novelty * F.lit(0.35)


def candidate_place() -> Column:
    """Sorts best candidates first: signal, undated, newest, then id; needs scores and times."""
    signal = weighted_signal(F.coalesce("importance_score", F.lit(0.0)), F.coalesce("novelty_score", F.lit(0.0)))
    return F.struct(
        (-signal).alias("signal"),
        F.coalesce(-F.unix_micros("published_at"), F.lit(-(1 << 62))).alias("published"),
        F.coalesce(-F.unix_micros("created_at"), F.lit(1 << 62)).alias("created"),
        F.col("item_id").alias("item_id"),
    )


# ------------------------------------------------------------------ candidates
def rank_candidates(items: DataFrame, enrichments: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(audience, item_id, raw_asset_id, candidate_rank) of each audience's best items.

    Runs on id, score and time columns only; texts are joined to the few
    survivors afterwards. The rank limit is applied before the shuffle.
    """
    columns = ("item_id", "raw_asset_id", "audience", "published_at", "created_at")
    usable = items.where("status = 'processed'").select(*columns)
    current = enrichments.where("is_current").select("item_id", "importance_score", "novelty_score")
    ranked = usable.join(current, "item_id").withColumn("_place", candidate_place())
    best = first_n_per_key(ranked, ["audience"], policy.window, "candidate_rank", F.asc("_place"))
    return best.select("audience", "item_id", "raw_asset_id", "candidate_rank")


def assemble_candidates(
    items: DataFrame,
    enrichments: DataFrame,
    assets: DataFrame,
    entries: DataFrame,
    sources: DataFrame,
    titles: DataFrame,
    policy: Policy = Policy(),
) -> DataFrame:
    """Candidates with enrichment, source and topic-group columns.

    The ranked ids are checkpointed and counted, and every large table is
    reduced to them before any wide join.
    """
    ensure_checkpoint_dir(items.sparkSession)
    best = Narrow(rank_candidates(items, enrichments, policy).checkpoint())
    chosen = items.join(best.pick("item_id", "candidate_rank"), "item_id")
    current = enrichments.where("is_current").drop("is_current", "created_at", "superseded_at")
    joined = item_context(
        chosen.join(best.rows(current, "item_id"), "item_id"),
        best.rows(assets, "raw_asset_id"),
        entries,
        sources,
    )
    joined = joined.join(best.rows(titles, "item_id"), "item_id", "left")
    return joined.withColumn("source_name", text.blank_to_null(F.col("source_name"))).withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )


# ------------------------------------------------------------------ content
_COLLAPSED = ("_title", "_summary", "_content", "_why")


def _with_collapsed(candidates: DataFrame) -> DataFrame:
    summary = F.coalesce("summary_short", "summary_long")
    texts = (F.col("title"), summary, F.col("content_text"), F.col("why_it_matters"))
    return candidates.select("*", *[quality.collapsed(t).alias(n) for n, t in zip(_COLLAPSED, texts)])


def _with_quality(collapsed: DataFrame) -> DataFrame:
    title, summary, content, why = [F.col(name) for name in _COLLAPSED]
    return collapsed.select(
        "*",
        quality.body_is_meaningful(content).alias("body_meaningful"),
        quality.summary_is_meaningful(summary, title).alias("summary_meaningful"),
        quality.why_is_meaningful(why).alias("why_meaningful"),
    )


def with_content_quality(candidates: DataFrame) -> DataFrame:
    """Add body_meaningful, summary_meaningful and why_meaningful."""
    return _with_quality(_with_collapsed(candidates)).drop(*_COLLAPSED)


# ------------------------------------------------------------------ scores
def with_selection_scores(candidates: DataFrame) -> DataFrame:
    """Add content quality, importance, novelty, quality_adjustment and total_score."""

    def part(holds, amount):
        return F.when(holds, F.lit(amount)).otherwise(F.lit(0.0))

    def unit(name):
        return text.unit_interval(text.round_places(F.coalesce(F.col(name), F.lit(0.0)), 3))

    adjustment = (
        part(F.col("summary_meaningful"), 0.02)
        + part(F.col("why_meaningful"), 0.04)
        + part(text.is_present(F.col("topic_group_title")), 0.02)
        - part(~F.col("summary_meaningful"), 0.04)
        - part(F.col("roundup_title"), 0.12)
        - part(quality.repeats_title(F.col("_summary"), F.col("_title")), 0.04)
    )
    judged = _with_quality(_with_collapsed(candidates)).select(
        "*",
        unit("importance_score").alias("importance"),
        unit("novelty_score").alias("novelty"),
        text.is_roundup(F.col("_title")).alias("roundup_title"),
        (F.col("_title") == "").alias("untitled"),
    )
    adjusted = judged.withColumn("_adjustment", adjustment)
    total = weighted_signal(F.col("importance"), F.col("novelty")) + F.col("_adjustment")
    return adjusted.select(
        "*",
        text.round_places(F.col("_adjustment"), 3).alias("quality_adjustment"),
        text.round_places(total, 3).alias("total_score"),
    ).drop("_adjustment", *_COLLAPSED)


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name in pairs]))


def hard_filter_reasons(policy: Policy = Policy()) -> Column:
    """Every reason a scored candidate can never be shown, in order."""
    weak = (F.coalesce("importance_score", F.lit(0.0)) < 0.4) & (
        F.coalesce("novelty_score", F.lit(0.0)) < 0.45
    )
    return _reasons(
        (F.col("duplicate_of_item_id").isNotNull(), "duplicate_item"),
        (F.col("preserve_recommendation") == "discard", "discarded_by_enrichment"),
        (F.col("untitled"), "missing_title"),
        (~F.col("summary_meaningful") & ~F.col("body_meaningful"), "no_meaningful_visible_content"),
        (F.col("importance_score").isNull() | F.col("novelty_score").isNull(), "missing_signal_scores"),
        (weak, "low_signal_scores"),
        (F.col("total_score") < policy.min_score, "below_review_threshold"),
        (F.col("roundup_title") & (F.col("total_score") < 0.72), "roundup_low_review_value"),
    )


def selection_reasons() -> Column:
    found = _reasons(
        (F.col("total_score") >= 0.85, "top_review_value"),
        (F.col("importance") >= 0.7, "high_importance"),
        (F.col("novelty") >= 0.6, "high_novelty"),
        (F.col("summary_meaningful"), "meaningful_summary"),
        (F.col("why_meaningful"), "why_it_matters_present"),
        (text.is_present(F.col("topic_group_title")), "topic_grouped"),
        (text.is_present(F.col("source_name")), "source_attributed"),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ranked_for_relevance")))


def _diversity_key(value: Column) -> Column:
    return F.nullif(F.lower(text.collapse(F.coalesce(value, F.lit("")))), F.lit(""))


# ------------------------------------------------------------------ choice
def select_queue(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One decision per candidate.

    Each audience holds at most ``policy.window`` candidates, so its queue is a
    bounded array that one fold walks in score order with the counts so far.
    """
    scored = with_selection_scores(candidates)
    ready = scored.select(
        "audience",
        "item_id",
        "candidate_rank",
        "published_at",
        "total_score",
        "importance",
        "novelty",
        "quality_adjustment",
        "duplicate_of_item_id",
        "source_name",
        "topic_group_title",
        F.col("body_meaningful").alias("visible_body_eligible"),
        F.col("summary_meaningful").alias("visible_summary_eligible"),
        hard_filter_reasons(policy).alias("filters"),
        selection_reasons().alias("merits"),
        _diversity_key(F.coalesce("topic_group_title", "topic")).alias("topic_key"),
        _diversity_key(F.col("source_name")).alias("source_key"),
        text.title_prefix(F.col("title")).alias("prefix"),
    )
    entry = F.struct(
        (-F.col("total_score")).alias("by_score"),
        (-F.coalesce(F.unix_millis("published_at"), F.lit(0))).alias("by_time"),
        "candidate_rank",
        *[name for name in ready.columns if name not in ("audience", "candidate_rank")],
    )
    queues = ready.groupBy("audience").agg(F.array_sort(F.collect_list(entry)).alias("queue"))

    counts = "map<string,int>"
    verdict_type = (
        "array<struct<item_id:{},stage:string,reasons:array<string>,topic_slot:int,source_slot:int,"
        "selection_rank:int>>"
    ).format(ready.schema["item_id"].dataType.simpleString())
    start = F.struct(
        F.lit(0).alias("chosen"),
        F.create_map().cast(counts).alias("topics"),
        F.create_map().cast(counts).alias("sources"),
        F.array().cast("array<string>").alias("prefixes"),
        F.array().cast(verdict_type).alias("verdicts"),
    )

    def seen(state_map, key):
        return F.when(key.isNotNull(), F.coalesce(F.element_at(state_map, key), F.lit(0)))

    def walk(state, row):
        topic_count = seen(state["topics"], row["topic_key"])
        source_count = seen(state["sources"], row["source_key"])
        obstacle = (
            F.when(state["chosen"] >= policy.budget, "selection_budget_reached")
            .when(F.array_contains(state["prefixes"], row["prefix"]), "near_duplicate_title")
            .when(topic_count >= policy.max_per_topic, "topic_diversity_limit")
            .when(source_count >= policy.max_per_source, "source_diversity_limit")
        )
        blocked = F.when(F.size(row["filters"]) > 0, row["filters"]).when(
            obstacle.isNotNull(), F.array(obstacle)
        )
        stage = (
            F.when(F.size(row["filters"]) > 0, "hard_filter")
            .when(obstacle == "selection_budget_reached", "budget")
            .when(obstacle.isNotNull(), "diversity")
            .otherwise("selected")
        )
        bound = F.struct(
            blocked.alias("blocked"),
            stage.alias("stage"),
            (topic_count + 1).alias("topic_slot"),
            (source_count + 1).alias("source_slot"),
        )

        def advance(b):
            taken = b["blocked"].isNull()
            rank = state["chosen"] + F.lit(1)
            slots = F.array_compact(
                F.array(
                    F.concat(F.lit("topic_slot_"), b["topic_slot"].cast("string")),
                    F.concat(F.lit("source_slot_"), b["source_slot"].cast("string")),
                    F.concat(F.lit("selection_rank_"), rank.cast("string")),
                )
            )

            def bump(state_map, key, slot):
                added = F.map_concat(
                    F.map_filter(state_map, lambda k, _: k != key), F.create_map(key, slot)
                )
                return F.when(taken & key.isNotNull(), added).otherwise(state_map)

            verdict = F.struct(
                row["item_id"].alias("item_id"),
                b["stage"].alias("stage"),
                F.coalesce(b["blocked"], F.concat(row["merits"], slots)).alias("reasons"),
                F.when(taken, b["topic_slot"]).alias("topic_slot"),
                F.when(taken, b["source_slot"]).alias("source_slot"),
                F.when(taken, rank).alias("selection_rank"),
            )
            return F.struct(
                F.when(taken, rank).otherwise(state["chosen"]).alias("chosen"),
                bump(state["topics"], row["topic_key"], b["topic_slot"]).alias("topics"),
                bump(state["sources"], row["source_key"], b["source_slot"]).alias("sources"),
                F.when(
                    taken & row["prefix"].isNotNull(), F.concat(state["prefixes"], F.array(row["prefix"]))
                )
                .otherwise(state["prefixes"])
                .alias("prefixes"),
                F.concat(state["verdicts"], F.array(verdict)).alias("verdicts"),
            )

        return F.transform(F.array(bound), advance)[0]

    walked = queues.select("audience", "queue", F.aggregate("queue", start, walk)["verdicts"].alias("verdicts"))
    decided = walked.select("audience", F.explode(F.arrays_zip("queue", "verdicts")).alias("d"))
    return decided.select(
        "audience",
        "d.verdicts.item_id",
        "d.queue.candidate_rank",
        "d.verdicts.stage",
        (F.col("d.verdicts.stage") == "selected").alias("selected"),
        F.col("d.queue.total_score").alias("relevance_score"),
        F.struct(
            F.col("d.queue.importance").alias("importance_score"),
            F.col("d.queue.novelty").alias("novelty_score"),
            F.col("d.queue.quality_adjustment").alias("quality_adjustment"),
            F.col("d.queue.total_score").alias("total_score"),
        ).alias("score_breakdown"),
        F.col("d.verdicts.reasons").alias("selection_reasons"),
        "d.verdicts.topic_slot",
        "d.verdicts.source_slot",
        "d.verdicts.selection_rank",
        F.lit(policy.version).alias("policy_version"),
        F.struct(
            F.lit(policy.budget).alias("candidate_budget"),
            F.lit(policy.window).alias("candidate_window"),
            F.lit(policy.max_per_topic).alias("max_per_topic"),
            F.lit(policy.max_per_source).alias("max_per_source"),
            F.col("d.verdicts.stage").alias("policy_stage"),
            F.col("d.queue.duplicate_of_item_id").alias("duplicate_of_item_id"),
            F.col("d.queue.source_name").alias("source_name"),
            F.col("d.queue.topic_group_title").alias("topic_group_title"),
            F.col("d.queue.visible_body_eligible").alias("visible_body_eligible"),
            F.col("d.queue.visible_summary_eligible").alias("visible_summary_eligible"),
        ).alias("metadata"),
    )


def selection_summary(decisions: DataFrame) -> DataFrame:
    """Candidate and selected counts of a run, per audience."""
    return decisions.groupBy("audience", "policy_version").agg(
        F.count("*").alias("candidate_count"), F.count_if("selected").alias("selected_count")
    )


def near_duplicate_titles(items: DataFrame) -> DataFrame:
    """Later items whose first three title tokens match an earlier title."""
    keyed = items.select("item_id", "created_at", text.title_prefix(F.col("title")).alias("title_key"))
    keyed = keyed.where("title_key is not null")
    shared = (
        keyed.groupBy("title_key")
        .agg(F.count("*").alias("copies"), F.min(F.struct("created_at", "item_id")).alias("f"))
        .where("copies > 1")
        .select("title_key", "copies", F.col("f.item_id").alias("first_item_id"))
    )
    found = lookup(
        keyed, shared, "title_key", ["copies", "first_item_id"], weight="copies", spread=["item_id"]
    )
    return found.where("first_item_id <> item_id").select("item_id", "title_key", "first_item_id", "copies")

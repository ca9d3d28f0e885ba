"""Reading queue: the golden scenario and a sequential model."""

import datetime as dt
import random

import pytest

from gleanery.operators import selection

CANDIDATE = (
    "audience string, item_id bigint, candidate_rank int, title string, content_text string, summary_short string, "
    "summary_long string, why_it_matters string, importance_score double, novelty_score double, "
    "preserve_recommendation string, published_at timestamp, source_name string, topic string, "
    "topic_group_title string, duplicate_of_item_id bigint"
)
SUMMARY = "Standalone summary number {} explains what changed and who should care."
WHY = "Useful background for the weekly topic review."
NOW = dt.datetime(2026, 4, 12)


def candidate(item_id, title, importance, novelty, source, topic, group, **changes):
    row = dict(
        audience="all", item_id=item_id, candidate_rank=item_id, title=title, content_text="short body",
        summary_short=SUMMARY.format(item_id), summary_long=None, why_it_matters=WHY, importance_score=importance,
        novelty_score=novelty, preserve_recommendation="keep", published_at=NOW, source_name=source, topic=topic,
        topic_group_title=group, duplicate_of_item_id=None,
    )
    return tuple((row | changes).values())


def decide(spark, rows, **policy):
    frame = spark.createDataFrame(rows, CANDIDATE)
    decided = selection.select_queue(frame, selection.Policy(**policy)).collect()
    return {row["item_id"]: row for row in decided}


def golden():
    def c(*args, **changes):
        return candidate(*args, **changes)

    weak = {"summary_short": "Too short", "content_text": None}
    return [
        c(1, "Primary AI item", 0.96, 0.84, "Primary AI Feed", "AI", "AI"),
        c(2, "Second AI item", 0.89, 0.71, "Primary AI Feed", "AI", "AI"),
        c(3, "Third AI topic item", 0.88, 0.72, "Primary AI Feed", "AI", "AI"),
        c(4, "Primary AI item: follow-up analysis", 0.87, 0.69, "Research Feed", "AI", "AI"),
        c(5, "Research item", 0.80, 0.64, "Research Feed", "Research", "Research"),
        c(6, "Systems item", 0.82, 0.55, "Systems Feed", "Systems", "Systems"),
        c(7, "Agent item", 0.78, 0.60, "Primary AI Feed", "Agents", "Agents"),
        c(8, "Infrastructure item", 0.77, 0.58, "Primary AI Feed", "Infra", "Infra"),
        c(9, "Source overflow item", 0.76, 0.57, "Primary AI Feed", "Other", "Other"),
        c(10, "Duplicate AI item", 0.93, 0.70, "Primary AI Feed", "AI", "AI", duplicate_of_item_id=1, **weak),
        c(11, "Discarded item", 0.92, 0.83, "Systems Feed", "Systems", "Systems",
          preserve_recommendation="discard", **weak),
        c(12, "Quick note", 0.79, 0.66, "Systems Feed", "Notes", "Notes", summary_short="Quick note",
          content_text=None, why_it_matters=None),
        c(13, "Low signal item", 0.20, 0.20, "Research Feed", "Low", "Low", why_it_matters=None, **weak),
    ]


def test_golden_scenario(spark):
    got = decide(spark, golden())
    chosen = sorted((row["selection_rank"], i) for i, row in got.items() if row["selected"])
    assert [i for _, i in chosen] == [1, 2, 5, 6, 7]
    assert got[1]["relevance_score"] == 0.998 and got[2]["relevance_score"] == 0.907
    assert got[3]["selection_reasons"] == ["topic_diversity_limit"]
    assert got[4]["selection_reasons"] == ["near_duplicate_title"]
    assert got[8]["selection_reasons"] == got[9]["selection_reasons"] == ["source_diversity_limit"]
    assert got[10]["selection_reasons"] == ["duplicate_item", "no_meaningful_visible_content"]
    assert got[11]["selection_reasons"] == ["discarded_by_enrichment", "no_meaningful_visible_content"]
    assert got[12]["selection_reasons"] == ["no_meaningful_visible_content"]
    assert got[12]["relevance_score"] == 0.685
    assert got[13]["selection_reasons"] == [
        "no_meaningful_visible_content", "low_signal_scores", "below_review_threshold",
    ]
    assert got[1]["selection_reasons"] == [
        "top_review_value", "high_importance", "high_novelty", "meaningful_summary", "why_it_matters_present",
        "topic_grouped", "source_attributed", "topic_slot_1", "source_slot_1", "selection_rank_1",
    ]
    assert got[2]["selection_reasons"][-3:] == ["topic_slot_2", "source_slot_2", "selection_rank_2"]
    assert got[1]["metadata"]["policy_stage"] == "selected" and got[13]["stage"] == "hard_filter"


def test_missing_keys_are_not_limited(spark):
    rows = [candidate(i, f"Topicless story alpha{i} beta{i}", 0.8, 0.7, f"Feed {i}", None, None) for i in range(3)]
    rows += [candidate(i, f"Sourceless piece gamma{i} d{i}x", 0.8, 0.7, None, f"T{i}", None) for i in range(3, 7)]
    rows = [(*row[:3], f"unique{row[1]} words{row[1]} here{row[1]}", *row[4:]) for row in rows]
    got = decide(spark, rows)
    assert sum(row["selected"] for row in got.values()) == 7


def model(rows, budget=8, per_topic=2, per_source=3):
    """Plain walk over eligible rows of one audience."""
    topics, sources, heads, taken, out = {}, {}, set(), 0, {}
    for row in sorted(rows, key=lambda r: (-r["total"], -r["time"], r["rank"])):
        t, s, h = row["topic"], row["source"], row["head"]
        if taken >= budget:
            out[row["id"]] = "selection_budget_reached"
        elif h in heads:
            out[row["id"]] = "near_duplicate_title"
        elif t and topics.get(t, 0) >= per_topic:
            out[row["id"]] = "topic_diversity_limit"
        elif s and sources.get(s, 0) >= per_source:
            out[row["id"]] = "source_diversity_limit"
        else:
            taken += 1
            topics[t] = topics.get(t, 0) + 1
            sources[s] = sources.get(s, 0) + 1
            heads.add(h)
            out[row["id"]] = f"selection_rank_{taken}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_sequential_walk(spark, seed):
    rng = random.Random(seed)
    rows, plain = [], {}
    for item_id in range(360):
        audience = f"a{item_id % 6}"
        importance, novelty = rng.randrange(60, 101) / 100, rng.randrange(60, 101) / 100
        topic = rng.choice([None, "x", "y", "z", "w"])
        source = rng.choice([None, "s", "t", "u"])
        head = f"head{rng.randrange(12)} common tail"
        days = rng.randrange(4)
        published = None if days == 3 else NOW + dt.timedelta(days=days)
        rank = item_id // 6 + 1
        rows.append(candidate(item_id, f"{head} {item_id}", importance, novelty, source, topic, None,
                              audience=audience, published_at=published, candidate_rank=rank))
        total = int((importance * 0.65 + novelty * 0.35 + (0.0 + 0.02 + 0.04)) * 1000 + 0.5) / 1000
        time = 0 if published is None else published.timestamp()
        plain.setdefault(audience, []).append(
            dict(id=item_id, total=total, time=time, rank=rank, topic=topic, source=source, head=head)
        )
    got = decide(spark, rows)
    expected = {}
    for audience_rows in plain.values():
        expected |= model(audience_rows)
    assert {i: row["selection_reasons"][-1] for i, row in got.items()} == expected
    assert all(row["relevance_score"] == next(p["total"] for p in plain[row["audience"]] if p["id"] == i)
               for i, row in got.items())


def test_policy_limits_are_parameters(spark):
    got = decide(spark, golden(), budget=2)
    assert sum(row["selected"] for row in got.values()) == 2
    assert got[3]["selection_reasons"] == ["selection_budget_reached"]


def test_near_duplicate_titles(spark):
    rows = [(i, NOW + dt.timedelta(hours=i), t) for i, t in
            enumerate(["One two three", "ONE, two: three four", "one two", None, "one two"])]
    frame = spark.createDataFrame(rows, "item_id bigint, created_at timestamp, title string")
    found = selection.near_duplicate_titles(frame).collect()
    assert [(r["item_id"], r["first_item_id"], r["copies"]) for r in found] == [(1, 0, 2)]


def test_summary_counts(spark):
    frame = spark.createDataFrame(golden(), CANDIDATE)
    row = selection.selection_summary(selection.select_queue(frame)).first()
    assert (row["candidate_count"], row["selected_count"]) == (13, 5)

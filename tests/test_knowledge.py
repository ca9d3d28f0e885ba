"""Normalization, scoring, dedupe, classification, groups, notes, history, enrichment."""

import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from gleanery.operators import (
    classify, context, dedupe, enrich, groups, history, integrity, normalize, notes, registry, score, skew, timeline,
)

AT = dt.datetime(2026, 4, 12, 10, 30)
ITEM = (
    "item_id bigint, title string, canonical_url string, canonical_url_conflict string, content_text string, "
    "created_at timestamp"
)


def rows_of(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def test_two_thousand_destinations(spark):
    note = ("n1", 1, "A title", AT)
    built = spark.createDataFrame([note], "note_id string, item_id bigint, title string, created_at timestamp")
    many = spark.createDataFrame(
        [(f"d{i:04d}", ("notion", "obsidian")[i % 2], "n", f"t{i}", "active") for i in range(2000)],
        "destination_id string, destination_type string, name string, target_ref string, status string",
    )
    assert notes.sync_notes(built, many).select("external_ref").distinct().count() == 2000
    (row,) = notes.sync_rollup(built, many).collect()
    assert row["synced_destination_count"] == 2000
    assert {k: v["destination_id"] for k, v in row["destinations"].items()} == {"notion": "d1998", "obsidian": "d1999"}


def test_normalize_skips_failed_and_done(spark):
    meta = json.dumps({"language": " ", "feed": {"language": "en", "title": "F"}, "httpStatus": 200, "extractor": 5})
    rows = [(f"a{i}", "e", "article", None, f"t{i}", None, "https://x/1", AT, "<p>Hi</p>", meta, s)
            for i, s in enumerate(["new", "failed", "new"])]
    assets = spark.createDataFrame(
        rows, "raw_asset_id string, capture_entry_id string, asset_type string, external_id string, title string, "
        "author string, url string, published_at timestamp, raw_content string, raw_metadata string, status string",
    )
    done = spark.createDataFrame([("a2",)], "raw_asset_id string")
    (item,) = normalize.normalize_assets(assets, done).collect()
    assert (item["item_id"], item["language"], item["content_text"]) == ("a0", "en", "Hi")
    extraction = item["metadata"]["extraction"]
    assert (extraction["extractor"], extraction["http_status"], extraction["text_format"]) == (None, 200.0, "html")


def test_canonical_owner(spark):
    rows = [(1, "u", AT), (2, "u", AT), (3, "v", AT), (4, None, AT), (5, "u", AT - dt.timedelta(days=1))]
    new = spark.createDataFrame(rows, "item_id bigint, canonical_url string, created_at timestamp")
    stored = spark.createDataFrame([("v",), (None,)], "canonical_url string")
    got = rows_of(normalize.assign_canonical_urls(new, ["created_at"], stored).drop("created_at"), "item_id")
    assert got == [(1, None, "u"), (2, None, "u"), (3, None, "v"), (4, None, None), (5, "u", None)]


def test_entry_completion(spark):
    rows = [("a1", "e1", "new"), ("a2", "e1", "new"), ("a3", "e2", "new"), ("a4", "e3", "failed")]
    assets = spark.createDataFrame(rows, "raw_asset_id string, capture_entry_id string, status string")
    failures = spark.createDataFrame([("a2", "broken")], "raw_asset_id string, message string")
    done = normalize.entry_completion(normalize.apply_asset_outcomes(assets, failures))
    got = rows_of(done.select("capture_entry_id", "entry_status", "phase", "failure_message"), "capture_entry_id")
    assert got == [("e1", "failed", "failed", "broken"), ("e2", "normalized", "completed", None),
                   ("e3", "failed", "failed", None)]


def test_rule_scores(spark):
    rows = [
        (1, "Main page", "x" * 1200, "Topic", AT), (2, None, "weekly summary", None, AT - dt.timedelta(days=8)),
        (3, " ", None, " ", AT + dt.timedelta(days=1)),
    ]
    frame = spark.createDataFrame(
        rows, "item_id bigint, title string, content_text string, source_topic string, published_at timestamp"
    )
    got = score.with_rule_scores(frame, F.lit(AT)).orderBy("item_id").collect()
    assert [(r["importance_score"], r["novelty_score"]) for r in got] == [(0.95, 0.75), (0.3, 0.6), (0.4, 0.75)]
    assert got[0]["rationale"] == [
        "title_present", "substantive_content", "long_form", "recent", "source_topic_present", "high_signal_ai_topic",
    ]
    assert got[2]["rationale"] == ["recent"]


def test_duplicates_in_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEY_LIMIT", 1)
    rows = [(i, "日本", None, None, "", AT + dt.timedelta(seconds=300 - i)) for i in range(300)]
    rows += [(1000 + i, f"Title {i // 2}", None, None, "", AT + dt.timedelta(seconds=i)) for i in range(20)]
    rows += [(2000, None, None, "HTTPS://X/", None, AT), (2001, None, "https://x/", None, None, AT)]
    frame = spark.createDataFrame(rows, ITEM)
    plain = {r["item_id"]: r for r in dedupe.find_duplicates(frame).collect()}
    assert len(plain) == 322
    assert plain[299]["duplicate_of_item_id"] is None and plain[0]["duplicate_of_item_id"] == 299
    assert plain[5]["dedupe_key"] == "text:" and plain[5]["key_copies"] == 300
    assert plain[1001]["duplicate_of_item_id"] == 1000 and plain[1000]["duplicate_of_item_id"] is None
    assert plain[2001]["duplicate_of_item_id"] == 2000 and plain[2000]["dedupe_key"] == "url:https://x/"
    apart = dedupe.find_duplicates(frame, empty_slug="id").where("item_id < 1000")
    assert apart.where("duplicate_of_item_id is not null").count() == 0
    assert dedupe.matched_items(dedupe.find_duplicates(frame)).count() == 322


def test_lookup_answers_hot_keys_map_side(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else ("cold" if i % 2 else None)) for i in range(60)],
                                 "id bigint, k string")
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    joined = skew.lookup(left, right, "k", ["n"], weight="n", spread=["id"], min_rows=20)
    assert joined.where("k = 'hot' and n = 40").count() == 40
    assert joined.where("k = 'cold' and n = 10").count() == 10
    assert joined.where("k is null and n is null").count() == 10 and joined.count() == 60


def test_classification(spark):
    rows = [
        (1, None, "Benchmark report: more", "", "en"), (2, "AI", "Plain words | rest", "", None),
        (3, None, "Réport d'été: la suite", "", "FR"), (4, None, None, "how to", None), (5, None, None, None, None),
        (6, " ", "A Roundup of updates", "ends with how", "en"),
    ]
    frame = spark.createDataFrame(
        rows, "item_id bigint, source_topic string, title string, content_text string, language string"
    )
    got = rows_of(classify.classify(frame).select("item_id", "classification", "topic", "tags"), "item_id")
    assert got == [
        (1, "research", "Research", ["research", "analysis", "lang_en"]), (2, "topic-tracked", "AI", ["ai"]),
        (3, "general", "Réport d'été", ["r_port_d_t", "lang_fr"]),
        (4, "tutorial", "Guides", ["tutorial", "guide", "guides"]), (5, "general", None, []),
        (6, "news", "News", ["news", "lang_en"]),
    ]


def test_groups(spark):
    rows = [(1, "AI", AT), (2, "ai!", AT + dt.timedelta(days=1)), (3, " ", AT), (1, "Systems", AT + dt.timedelta(days=2))]
    enriched = spark.createDataFrame(rows, "item_id bigint, topic string, at timestamp")
    made = groups.topic_groups(enriched)
    assert rows_of(made.select("tag", "title", "summary"), "tag") == [
        ("ai", "ai!", "Items related to ai!."), ("systems", "Systems", "Items related to Systems."),
    ]
    members = groups.topic_members(enriched)
    assert rows_of(members.select("item_id", "tag"), "item_id") == [(1, "systems"), (2, "ai")]
    old = spark.createDataFrame([("g", 1), ("g", 9), ("h", 9)], "group_id string, item_id bigint")
    assert groups.replace_memberships(old, enriched).count() == 4
    titles = groups.topic_titles(members.select("group_id", "item_id"), made)
    assert rows_of(titles, "item_id") == [(1, "Systems"), (2, "ai!")]


ENRICHED = (
    "item_id bigint, title string, canonical_url string, content_text string, summary_short string, "
    "summary_long string, key_points array<string>, why_it_matters string, topic string, classification string, "
    "tags array<string>, importance_score double, novelty_score double, baseline_score double, note_draft string, "
    "preserve_recommendation string, duplicate_of_item_id bigint, created_at timestamp"
)


def note_row(item_id, **changes):
    row = dict(
        item_id=item_id, title="Title", canonical_url="https://x/", content_text="One. Two! Three.",
        summary_short="Short", summary_long=None, key_points=["a", "b", "a"], why_it_matters="Why", topic="AI",
        classification="research", tags=["t"], importance_score=0.9, novelty_score=0.75, baseline_score=0.3,
        note_draft=None, preserve_recommendation="keep", duplicate_of_item_id=None, created_at=AT,
    )
    return tuple((row | changes).values())


def test_notes(spark):
    rows = [
        note_row(1), note_row(2, note_draft=" Draft ", classification="news"), note_row(3, note_draft="# Has one"),
        note_row(4, duplicate_of_item_id=1), note_row(5, preserve_recommendation="review"),
        note_row(6, title=None, summary_short=" ", topic=None, content_text=None, canonical_url=None, note_draft=" "),
    ]
    built = notes.build_notes(spark.createDataFrame(rows, ENRICHED))
    got = {r["item_id"]: r for r in built.collect()}
    assert sorted(got) == [1, 2, 3, 6]
    assert got[1]["body_md"] == (
        "# Title\n\nShort\n\n\n## Why it matters\n\nWhy\n\n## Key points\n\n- a\n- b\n- a\n\n## Preservation context\n\n"
        "- Importance score: 0.90\n- Novelty score: 0.75\n- Baseline score heuristic: 0.30\n"
        "- Deduped as duplicate: no\n- Classification: research\n- Topic: AI\n\n## Source excerpt\n\nOne. Two!\n\n"
        "[Original source](https://x/)"
    )
    assert got[1]["highlights"] == ["Short", "Why", "a", "b"] and got[1]["review_weight"] == 0.83
    assert (got[1]["note_type"], got[2]["note_type"]) == ("summary", "reference")
    assert got[2]["body_md"] == "# Title\n\nDraft" and got[3]["body_md"] == "# Has one"
    assert got[6]["title"] == "Preserved note" and got[6]["body_md"] == "# Preserved note"
    assert got[6]["highlights"] == ["Why", "a", "b"]

    none = notes.default_destinations(spark).limit(0)
    targets = notes.with_missing_defaults(none)
    refs = rows_of(notes.sync_notes(built, targets).where("item_id = 1").select("destination_type", "external_ref"), "destination_type")
    assert refs == [("notion", "notion://gleanery/default/page/title"), ("obsidian", "obsidian://gleanery/default/title.md")]
    rollup = notes.sync_rollup(built, targets)
    assert rollup.where("synced_destination_count = 2").count() == 4
    assert notes.destination_status(rollup).count() == 8


def test_history_and_rewrite(spark):
    day = dt.timedelta(days=1)
    rows = [(1, 1, AT), (1, 2, AT + day), (1, 3, AT + day), (2, 1, AT)]
    versions = spark.createDataFrame(rows, "item_id bigint, version_id bigint, created_at timestamp")
    past = history.enrichment_history(versions)
    got = rows_of(past.select("item_id", "version_id", "superseded_at", "is_current"), "item_id", "version_id")
    assert got == [(1, 1, AT + day, False), (1, 2, AT + day, False), (1, 3, None, True), (2, 1, None, True)]
    new = spark.createDataFrame([(2, 2, AT + 2 * day)], versions.schema)
    again = history.rewrite_history(past, new)
    got = rows_of(again.select("item_id", "version_id", "superseded_at", "is_current"), "item_id", "version_id")
    assert got[3:] == [(2, 1, AT + 2 * day, False), (2, 2, None, True)] and len(got) == 5


def test_timeline_matches_a_plain_window(spark):
    rows = [(i % 3, i, AT + dt.timedelta(seconds=(i * 37) % 50), None if i % 4 else i) for i in range(200)]
    frame = spark.createDataFrame(rows, "k bigint, id bigint, t timestamp, v bigint")
    expected, last = {}, {}
    for key, row_id, _, value in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        expected[row_id] = last.get(key)
        last[key] = value if value is not None else last.get(key)
    for pieces in (1, 7, None):
        found = timeline.with_previous_value(frame, ["k"], "t", ["id"], "v", "prev", pieces=pieces)
        assert {r["id"]: r["prev"] for r in found.collect()} == expected


def test_a_million_commands_of_one_source_in_one_second(spark):
    """They are scanned in even pieces, and the outcome is that of the plain walk."""
    n = 1_000_000
    actions = "element_at(array('register', 'pause', 'delete', 'pause', 'register', 'register'), cast(id * 7919 % 6 + 1 as int))"
    commands = spark.range(n).selectExpr("id as command_id", "'s' as source_id", f"{actions} as action", "timestamp'2026-01-01' as at")
    sizes = [r["count"] for r in timeline.in_pieces(commands, ["source_id"], ["at", "command_id"], 16).groupBy("_piece").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * n / 16
    found = registry.check_commands(commands).groupBy("rejection").count().collect()
    names = ("register", "pause", "delete", "pause", "register", "register")
    exists, expected = False, {}
    for i in range(n):
        action = names[i * 7919 % 6]
        bad = registry.ALREADY_REGISTERED if action == "register" and exists else registry.NOT_FOUND if action != "register" and not exists else None
        expected[bad] = expected.get(bad, 0) + 1
        exists = True if action == "register" else False if action == "delete" else exists
    assert {r["rejection"]: r["count"] for r in found} == expected


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", AT), (2, "b", AT)], "k bigint, v string, t timestamp")
    delta = spark.createDataFrame(
        [(2, "new", AT), (2, "newer", AT + dt.timedelta(1)), (3, "c", AT)], "k bigint, v string, t timestamp"
    )
    assert rows_of(history.upsert(base, delta, ["k"], F.desc("t")).drop("t"), "k") == [
        (1, "a"), (2, "newer"), (3, "c"),
    ]
    assert rows_of(history.insert_missing(base, delta, ["k"], F.desc("t")).drop("t"), "k") == [
        (1, "a"), (2, "b"), (3, "c"),
    ]
    runs = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "run_id bigint, item_id bigint")
    assert history.selection_history(runs).where("is_current").count() == 2


def test_pending_items(spark):
    items = spark.createDataFrame([(i, s) for i, s in enumerate(["new", "processed", "processed", "processed"])],
                                  "item_id bigint, status string")
    current = spark.createDataFrame([(0, True), (1, True), (2, False), (3, True)], "item_id bigint, is_current boolean")
    again = spark.createDataFrame([(3,)], "item_id bigint")
    got = rows_of(context.pending_items(items, current, reprocess=again).select("item_id"), "item_id")
    assert got == [(0,), (2,), (3,)]


def valid_output(**changes):
    output = {
        "summary": {"short": " A standalone summary. ", "long": None}, "key_points": ["a", " b ", "c"],
        "classification": {"label": "research", "topic": "AI"}, "tags": ["x"], "importance_score": 0.876,
        "novelty_score": 1, "why_it_matters": "It does.", "preserve_recommendation": "keep", "note_draft": None,
    }
    return json.dumps(output | changes)


def test_output_validation(spark):
    cases = [
        (valid_output(), None), ("[1]", "Knowledge enrichment output must be an object."),
        ("{", "Knowledge enrichment output must be an object."),
        (valid_output(key_points=["a"]), "key_points must contain at least 3 entries."),
        (valid_output(key_points=["a", 5, " "]), "key_points[1] must be a string."),
        (valid_output(tags=["x"] * 9), "tags must contain at most 8 entries."),
        (valid_output(importance_score=1.4), "importance_score must be a number between 0 and 1."),
        (valid_output(importance_score="0.5"), "importance_score must be a number between 0 and 1."),
        (valid_output(why_it_matters=5), "why_it_matters must be a string."),
        (valid_output(preserve_recommendation="maybe"),
         "preserve_recommendation must be one of discard, keep, or review."),
        (valid_output(summary={"short": "MY TITLE", "long": None}), "summary.short must not repeat the item title verbatim."),
        (valid_output(summary={"short": "My title: and more", "long": None}),
         "summary.short must not repeat the item title as a prefixed label."),
        (valid_output(summary={"short": "x"}), "summary.long must be a string."),
        (valid_output(classification={"label": "a", "topic": " "}), "classification.topic must not be empty."),
    ]
    frame = spark.createDataFrame(
        [(i, "My title", text) for i, (text, _) in enumerate(cases)], "item_id bigint, title string, output_json string"
    )
    checked = enrich.validate_outputs(frame).orderBy("item_id").collect()
    assert [r["error"] for r in checked] == [error for _, error in cases]
    good = checked[0]
    assert (good["summary_short"], good["key_points"], good["importance_score"], good["novelty_score"]) == (
        "A standalone summary.", ["a", "b", "c"], 0.88, 1.0,
    )


ITEMS = (
    "item_id bigint, title string, content_text string, source_topic string, language string, author string, "
    "canonical_url string, published_at timestamp"
)


def test_runners(spark):
    items = spark.createDataFrame(
        [(1, "T", "Lead one is here. Second sentence follows. Third one.", None, "en", None, None, AT)], ITEMS
    )
    valid, broken = enrich.enrich(items, enrich.rule_runner(F.lit(AT)))
    assert valid.count() == 1 and broken.count() == 0

    output = valid_output()  # a value, so that workers need not import this module

    def call(requests: pd.Series) -> pd.Series:
        return requests.map(lambda r: output if json.loads(r)["item"]["id"] == "1" else "{}")

    valid, broken = enrich.enrich(items, enrich.batch_runner(call))
    assert valid.first()["classification"] == "research" and broken.count() == 0
    request = json.loads(items.select(enrich.request_json()).first()[0])["item"]
    assert list(request) == list(enrich.REQUEST_FIELDS) and request["published_at"] == "2026-04-12T10:30:00.000Z"


def test_response_text(spark):
    cases = [
        ({"choices": [{"message": {"content": "a"}}]}, "a"),
        ({"choices": [{"message": {"content": [{"type": "x", "text": "n"}, {"type": "text", "text": "b"}]}}]}, "b"),
        ({"output_text": "c"}, "c"), ({"output": [{"content": [{"type": "output_text", "text": "d"}]}]}, "d"),
        ({"output": []}, None), ({"choices": []}, None),
    ]
    frame = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, j string")
    got = frame.select("i", enrich.response_text(F.col("j")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [expected for _, expected in cases]


def test_integrity_report(spark):
    frames = {
        "sources": spark.createDataFrame([("s", "rss", "u"), ("t", "rss", "u")],
                                         "source_id string, source_type string, source_ref string"),
        "capture_entries": spark.createDataFrame([("e", "zz"), ("f", None)], "capture_entry_id string, source_id string"),
        "raw_assets": spark.createDataFrame([("a", "gone")], "raw_asset_id string, capture_entry_id string"),
        "item_groups": spark.createDataFrame([("g", "topic", "x"), ("h", "topic", "x")],
                                             "group_id string, group_type string, tag string"),
    }
    got = {r["check_name"]: r["key_text"] for r in integrity.curation_report(frames).collect()}
    assert got == {
        "unique sources(source_type,source_ref)": "rss|u", "unique item_groups(group_type,tag)": "topic|x",
        "reference capture_entries.source_id": "zz", "reference raw_assets.capture_entry_id": "gone",
    }


def test_rule_tags_may_be_blank_but_those_of_models_may_not(spark):
    columns = ("item_id bigint, title string, content_text string, source_topic string, author string, "
               "canonical_url string, published_at timestamp, language string")
    items = spark.createDataFrame([(1, "Ö Ö", "Ä. Ü.", None, None, None, AT, "de")], columns)
    runner = enrich.rule_runner(F.lit(AT))
    valid, broken = enrich.enrich(items, runner)
    assert [r["tags"] for r in valid.collect()] == [["", "lang_de"]]
    assert broken.count() == 0
    assert enrich.validate_outputs(runner(items)).first()["error"] == "tags[0] must not be empty."

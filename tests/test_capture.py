"""Capture: greedy choice against a sequential model, cursors, sync state."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import capture, chains

ENTRY = (
    "row_id bigint, source_id bigint, batch_id bigint, pos bigint, external_id string, url string"
)
AT = dt.datetime(2026, 4, 12, 10, 30)


def sequential(entries, stored):
    """The plain walk: known, kept, or blocked by an earlier kept entry."""
    decisions = {}
    seen = {}
    stored_keys = {(s, kind, v) for s, e, u in stored for kind, v in (("e", e), ("u", u)) if v}
    for row_id, source, batch, _pos, ext, url in sorted(entries, key=lambda e: (e[1], e[2], e[3])):
        keys = {(kind, v) for kind, v in (("e", ext), ("u", url)) if v}
        if {(source, *key) for key in keys} & stored_keys:
            decisions[row_id] = "known"
        elif keys & seen.setdefault((source, batch), set()):
            decisions[row_id] = "batch_duplicate"
        else:
            decisions[row_id] = "kept"
            seen[(source, batch)] |= keys
    return decisions


def random_entries(seed, rows=400):
    rng = random.Random(seed)
    entries = []
    for row_id in range(rows):
        source = 0 if rng.random() < 0.4 else rng.randrange(1, 4)
        ext = None if rng.random() < 0.15 else f"e{rng.randrange(60)}"
        url = None if rng.random() < 0.15 else f"u{rng.randrange(60)}"
        entries.append((row_id, source, rng.randrange(2), row_id, ext, url))
    rng.shuffle(entries)
    stored = [(rng.randrange(4), f"e{rng.randrange(60)}", f"u{rng.randrange(60)}") for _ in range(10)]
    return entries, stored


@pytest.mark.parametrize(("seed", "fold_limit"), [(1, 1000), (2, 0), (3, 60)])
def test_choice_equals_the_sequential_walk(spark, seed, fold_limit):
    entries, stored = random_entries(seed)
    frame = spark.createDataFrame(entries, ENTRY)
    kept = spark.createDataFrame(stored, "source_id bigint, external_id string, url string")
    decided = capture.capture_dedupe(frame, kept, fold_limit=fold_limit).collect()
    assert {row["row_id"]: row["decision"] for row in decided} == sequential(entries, stored)


def test_dropped_entries_block_nothing(spark):
    rows = [(0, 1, 1, 0, "e1", "u1"), (1, 1, 1, 1, "e1", "u2"), (2, 1, 1, 2, "e2", "u2"), (3, 1, 1, 3, None, None),
            (4, 1, 1, 4, None, "")]
    frame = spark.createDataFrame(rows, ENTRY)
    for limit in (100, 0):
        kept = {row["row_id"] for row in capture.choose_unseen(frame, fold_limit=limit).collect()}
        assert kept == {0, 2, 3, 4}


def test_one_source_with_one_hot_url(spark):
    """A third of all rows share a URL; a long chain needs many rounds."""
    rows = [(i, 1, 1, i, f"e{i}", "hot") for i in range(300)]
    rows += [(300 + i, 1, 1, 300 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(12)]
    rows += [(400 + i, 2, 1, i, f"x{i}", f"y{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, ENTRY)
    none = spark.createDataFrame([], "source_id bigint, external_id string, url string")
    decided = capture.capture_dedupe(frame, none, fold_limit=50).collect()
    assert {row["row_id"]: row["decision"] for row in decided} == sequential(rows, [])


def entries_at(spark, rows):
    return spark.createDataFrame(rows, ENTRY + ", published_at timestamp")


def test_cursor_of_the_latest_instant(spark):
    rows = [
        (0, 1, 1, 0, "entry-old", "https://example.com/old", AT - dt.timedelta(days=1)),
        (1, 1, 1, 1, "entry-duplicate", "https://example.com/articles/duplicate", AT),
        (2, 1, 1, 2, "entry-duplicate", "https://example.com/articles/duplicate", AT),
        (3, 2, 1, 0, "only", None, None),
        (4, 2, 1, 1, "second", "u", None),
    ]
    cursors = {row["source_id"]: row for row in capture.sync_cursors(entries_at(spark, rows)).collect()}
    assert cursors[1]["cursor"] == (
        '{"latestExternalIds":["entry-duplicate"],"latestPublishedAt":"2026-04-12T10:30:00.000Z",'
        '"latestUrls":["https://example.com/articles/duplicate"]}'
    )
    assert cursors[2]["cursor"] == '{"latestExternalIds":["only"],"latestPublishedAt":null,"latestUrls":[]}'


def test_cursor_of_a_large_batch_is_whole(spark):
    rows = [(i, 1, 1, i, f"e{i}", f"u{i}" if i % 2 else None, AT) for i in range(5000)]
    frame = entries_at(spark, rows).repartition(7)
    row = capture.sync_cursors(frame).first()
    cursor = json.loads(row["cursor"])
    assert row["member_count"] == 7500 == capture.cursor_members(frame).count()
    assert cursor["latestExternalIds"] == [f"e{i}" for i in range(5000)]
    assert cursor["latestUrls"] == [f"u{i}" for i in range(1, 5000, 2)]


def test_runs(spark):
    rows = [(0, 1, 1, "kept"), (1, 1, 1, "batch_duplicate"), (2, 2, 1, "known"), (3, 2, 1, "known")]
    frame = spark.createDataFrame(rows, "row_id bigint, source_id bigint, batch_id bigint, decision string")
    runs = {row["source_id"]: row for row in capture.capture_runs(frame).collect()}
    assert (runs[1]["fetched_count"], runs[1]["persisted_count"], runs[1]["skipped_count"]) == (2, 1, 1)
    assert (runs[1]["entry_status"], runs[1]["normalization_phase"]) == ("captured", None)
    assert (runs[2]["entry_status"], runs[2]["normalization_phase"]) == ("normalized", "skipped")
    assert runs[2]["normalization_reason"] == "no_new_raw_assets"


def test_sync_state(spark):
    rows = [
        (1, AT, 1, True, None), (1, AT + dt.timedelta(hours=1), 2, False, "status 500 " + "x" * 600),
        (2, AT, 1, False, "bad"), (2, AT + dt.timedelta(hours=1), 2, True, None),
    ]
    frame = spark.createDataFrame(rows, "source_id bigint, at timestamp, seq bigint, ok boolean, message string")
    state = {row["source_id"]: row for row in capture.sync_state(frame).collect()}
    assert state[1]["source_status"] == "error" and state[1]["last_success_at"] == AT
    assert len(state[1]["last_error_message"]) == 500 and "status 500" in state[1]["last_error_message"]
    assert state[2]["source_status"] == "active" and state[2]["last_error_message"] is None


def test_identity_keys(spark):
    rows = [(0, 1, 1, 0, "a", "b"), (1, 1, 1, 1, "a", None), (2, 2, 1, 0, "", "b")]
    keys = capture.identity_keys(spark.createDataFrame(rows, ENTRY)).collect()
    assert sorted(map(tuple, keys)) == [(1, "externalId", "a"), (1, "url", "b"), (2, "url", "b")]


def test_failed_runs(spark):
    frame = spark.createDataFrame([(1, 7, "m")], "source_id bigint, batch_id bigint, message string")
    assert capture.failed_runs(frame).select("phase", "entry_status", "message").first() == ("failed", "failed", "m")


def test_no_row_is_lost(spark):
    entries, stored = random_entries(9)
    frame = spark.createDataFrame(entries, ENTRY)
    kept = spark.createDataFrame(stored, "source_id bigint, external_id string, url string")
    decided = capture.capture_dedupe(frame, kept)
    assert decided.agg(F.count("*"), F.count_distinct("row_id")).first() == (400, 400)


def alternating(n, source=1, start=0):
    """Rows linked to the next one by id and by URL in turn."""
    return [(start + i, source, 1, i, f"c{source}-{(i + 1) // 2}", f"d{source}-{i // 2}") for i in range(n)]


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    """10,000 alternating rows: pointers double, so rounds grow with the logarithm."""
    rounds, jumps = [], []
    settle, jumped = chains.settle, chains._jumped
    monkeypatch.setattr(chains, "settle", lambda rows: rounds.append(1) or settle(rows))
    monkeypatch.setattr(chains, "_jumped", lambda *links: jumps.append(1) or jumped(*links))
    rows = alternating(10_000) + [(20_000 + i, 1, 1, 20_000 + i, f"c1-{i}", None) for i in range(0, 5000, 7)]
    frame = spark.createDataFrame(rows, ENTRY)
    kept = {row["row_id"] for row in capture.choose_unseen(frame, fold_limit=100).collect()}
    assert kept == {row_id for row_id, decision in sequential(rows, []).items() if decision == "kept"}
    assert len(rounds) <= 2 and len(rounds) + len(jumps) <= 20


@pytest.mark.parametrize("seed", range(3))
def test_tangled_chains_equal_the_sequential_walk(spark, seed):
    """Chains in random order, joined at hubs, with rows of one key and repeats."""
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        ext = None if rng.random() < 0.1 else f"e{rng.randrange(350)}"
        url = "hub" if rng.random() < 0.05 else f"u{rng.randrange(350)}"
        rows.append((i, 1, 1, i, ext, url))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, ENTRY)
    kept = {row["row_id"] for row in capture.choose_unseen(frame, fold_limit=0).collect()}
    assert kept == {row_id for row_id, decision in sequential(rows, []).items() if decision == "kept"}


def test_batches_of_thousands_are_walked_in_place(spark, monkeypatch):
    """Chains and tangles of 3000 entries need no rounds; neighbours in feed order are not neighbours by key."""
    monkeypatch.setattr(chains, "settle", lambda rows: pytest.fail("a round"))
    rng = random.Random(5)
    rows = alternating(2500)
    for i in range(3000):
        ext = None if rng.random() < 0.1 else f"e{rng.randrange(1500)}"
        url = "hub" if rng.random() < 0.05 else None if rng.random() < 0.1 else f"u{rng.randrange(1500)}"
        rows.append((10_000 + i, 2, 1, i, ext, url))
    rng.shuffle(rows)
    kept = {row["row_id"] for row in capture.choose_unseen(spark.createDataFrame(rows, ENTRY)).collect()}
    assert kept == {row_id for row_id, decision in sequential(rows, []).items() if decision == "kept"}

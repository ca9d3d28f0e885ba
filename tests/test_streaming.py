"""Micro-batches: the feed scenario, replay, and sync state over a stream."""

import datetime as dt

from pyspark.sql import functions as F

from gleanery.operators import enrich
from gleanery.plans import batches as table_batches
from gleanery.streaming import microbatch

AT = dt.datetime(2026, 4, 12, 10, 30)
PAYLOAD = (
    "payload_id bigint, source_id string, source_url string, final_url string, requested_at timestamp, xml string"
)


def feed(*items):
    body = "".join(
        f"<item><guid>{guid}</guid><link>{url}</link><title>{title}</title><description><![CDATA[<p>{title} body."
        f"</p><p>Second paragraph with several words in it.</p>]]></description></item>"
        for guid, url, title in items
    )
    return f"<rss><channel><title>F</title><language>en</language>{body}</channel></rss>"


ONE = ("g1", "https://example.com/1", "First launch story here")
TWO = ("g2", "https://example.com/2", "Another guide about things")
THREE = ("g3", "https://example.com/3", "Third research report today")


def payloads(spark, step, *rows):
    data = [(step * 10 + i, source, "u", "u", AT + dt.timedelta(hours=step, minutes=i), xml)
            for i, (source, xml) in enumerate(rows)]
    return spark.createDataFrame(data, PAYLOAD)


def batches(spark):
    return [
        payloads(spark, 0, ("s1", feed(ONE, TWO))),
        payloads(spark, 1, ("s1", feed(ONE, TWO)), ("s2", "<rss><channel>")),
        payloads(spark, 2, ("s1", feed(TWO, THREE, THREE)), ("s2", feed(ONE))),
    ]


def store_at(spark, tmp_path):
    return microbatch.Store(spark, str(tmp_path / "store"))


def sources(spark):
    return spark.createDataFrame([("s1", "Feed one", "AI"), ("s2", "Feed two", None)],
                                 "source_id string, name string, topic string")


def snapshot(store):
    names = ("raw_assets", "items", "enrichments", "capture_runs", "selections", "outcomes")
    return {name: sorted(map(str, store.read(name).drop("score_breakdown").collect())) for name in names}


def test_batches_capture_only_unseen_assets_and_replay_changes_nothing(spark, tmp_path):
    store = store_at(spark, tmp_path)
    step = microbatch.curation_batch(store, enrich.rule_runner(F.lit(AT)), sources(spark))
    frames = batches(spark)
    for batch_id, frame in enumerate(frames):
        step(frame, batch_id)

    runs = {(r["batch_id"], r["source_id"]): r for r in store.read("capture_runs").collect()}
    counts = {k: (r["fetched_count"], r["persisted_count"], r["skipped_count"]) for k, r in runs.items()}
    assert counts == {(0, "s1"): (2, 2, 0), (1, "s1"): (2, 0, 2), (2, "s1"): (3, 1, 2), (2, "s2"): (1, 1, 0)}
    assert runs[(1, "s1")]["normalization_reason"] == "no_new_raw_assets"
    assert store.read("failed_runs").first()["message"] == "RSS parsing failed for source s2."

    items = store.read("items").collect()
    assert len(items) == 4
    (conflict,) = [r for r in items if r["canonical_url"] is None]
    assert conflict["canonical_url_conflict"] == "https://example.com/1" and conflict["source_id"] == "s2"
    state = {r["source_id"]: r for r in microbatch.current_sync_state(store).collect()}
    assert state["s2"]["source_status"] == "active" and state["s2"]["last_error_message"] is None

    newest = store.read("selections").where("run_id = 2")
    assert newest.count() == store.read("enrichments").select("item_id").distinct().count()
    copy = newest.where("stage = 'hard_filter' and array_contains(selection_reasons, 'duplicate_item')")
    assert [r["item_id"] for r in copy.collect()] == [conflict["item_id"]]

    members = store.read("item_group_members")
    assert members.join(store.read("item_groups").select("group_id").distinct(), "group_id", "left_anti").count() == 0
    records = [r["record"] for r in store.read("provenance").collect()]
    assert len(records) == 4 and all(len(r["order"]) == 6 == len(r["steps"]) for r in records)
    noted = {r["note_id"] for r in store.read("notes").collect()}
    assert noted == {r["steps"]["preserve"]["note_id"] for r in records if r["note_status"] == "created"}
    assert store.read("destination_results").count() == 2 * len(noted)

    before = snapshot(store)
    step(frames[2], 2)
    assert snapshot(store) == before


def test_stream_runs_the_chain(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches(spark)[0].write.parquet(folder)
    store = store_at(spark, tmp_path)
    stream = spark.readStream.schema(PAYLOAD).parquet(folder)
    query = microbatch.start_curation(
        stream, store, enrich.rule_runner(F.lit(AT)), sources(spark), str(tmp_path / "checkpoint")
    )
    query.awaitTermination(120)
    assert query.exception() is None
    assert store.read("items").count() == 2


def test_first_batches_without_rows_do_not_stop_the_chain(spark, tmp_path):
    nothing = enrich.batch_runner(lambda requests: requests.map(lambda _: "{broken"))
    rules = enrich.rule_runner(F.lit(AT))
    starts = (
        ("empty", rules, (("s1", feed()), ("s2", "<rss><channel>")), {"s1": (0, "normalized", "skipped")}),
        ("invalid", nothing, (("s1", feed(ONE)),), {"s1": (1, "captured", None)}),
    )
    for name, runner, rows, expected in starts:
        store = microbatch.Store(spark, str(tmp_path / name))
        microbatch.curation_batch(store, runner, sources(spark))(payloads(spark, 0, *rows), 0)
        microbatch.curation_batch(store, rules, sources(spark))(payloads(spark, 1, ("s1", feed(TWO, THREE))), 1)
        assert store.read("enrichments").count() == 2 == store.read("provenance").count()
        runs = store.read("capture_runs").where("batch_id = 0").collect()
        assert {r["source_id"]: (r["fetched_count"], r["entry_status"], r["normalization_phase"]) for r in runs} == expected
        assert not store.exists("_stage/0") and not store.exists("_stage/1")


def test_replay_with_other_answers_leaves_no_stale_rows(spark, tmp_path):
    store = store_at(spark, tmp_path)
    frame = payloads(spark, 0, ("s1", feed(ONE, TWO)))
    microbatch.curation_batch(store, enrich.rule_runner(F.lit(AT)), sources(spark))(frame, 0)
    assert (store.read("enrichments").count(), store.read("quarantine").count()) == (2, 0)
    assert [tuple(r) for r in store.read("run_counters").collect()] == [("s1", 2, 2, 2, 0, 0)]
    broken = enrich.batch_runner(lambda requests: requests.map(lambda _: "[]"))
    microbatch.curation_batch(store, broken, sources(spark))(frame, 0)
    assert (store.read("enrichments").count(), store.read("quarantine").count()) == (0, 2)
    assert [tuple(r) for r in store.read("run_counters").collect()] == [("s1", 2, 2, 0, 2, 0)]


def test_sync_state_follows_a_stream(spark, tmp_path):
    rows = [("s", AT, 1, True, None), ("s", AT + dt.timedelta(hours=1), 2, False, "bad")]
    schema = "source_id string, at timestamp, seq bigint, ok boolean, message string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    store = store_at(spark, tmp_path)
    microbatch.start_sync_state(stream, store, str(tmp_path / "cp")).awaitTermination(120)
    (row,) = microbatch.stored_sync_state(store).collect()
    assert (row["source_status"], row["last_error_message"], row["last_success_at"]) == ("error", "bad", AT)
    more = spark.createDataFrame([("s", AT + dt.timedelta(hours=2), 3, True, None), ("t", AT, 4, False, "x")], schema)
    more.write.mode("append").parquet(str(tmp_path / "log"))
    microbatch.start_sync_state(stream, store, str(tmp_path / "cp")).awaitTermination(120)
    state = {r["source_id"]: r for r in microbatch.stored_sync_state(store).collect()}
    assert (state["s"]["source_status"], state["s"]["last_error_at"]) == ("active", None)
    assert state["t"]["source_status"] == "error"


def test_late_and_repeated_outcomes_give_the_state_of_the_ordered_log(spark, tmp_path):
    import random

    from gleanery.operators import capture

    rng = random.Random(6)
    schema = "source_id string, at timestamp, seq bigint, ok boolean, message string"
    log = [
        (rng.choice(["a", "b", "c", None]), AT + dt.timedelta(minutes=rng.randrange(30)), i, rng.random() < 0.5, f"m{i}")
        for i in range(60)
    ]
    store = microbatch.Store(spark, str(tmp_path / "store"), buckets=2)
    run = microbatch.sync_state_batch(store)
    mixed = rng.sample(log, len(log)) + rng.sample(log, 12)
    for batch in range(4):
        rows = mixed[18 * batch:18 * batch + 18] if batch != 2 else []
        for _ in range(2 if batch == 1 else 1):     # a replay
            run(spark.createDataFrame(rows, schema), batch)
    run(spark.createDataFrame(mixed[36:54], schema), 4)
    known = capture.sync_state(spark.createDataFrame(log, schema)).where("source_id is not null")
    found = microbatch.stored_sync_state(store).select(*known.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, known.collect()))
    assert len(list((tmp_path / "store" / "sync_batches").glob("batch_id=*"))) == 1


def test_selection_state_equals_the_full_rebuild(spark, tmp_path):
    """Ten batches with a small window: late originals demote stored candidates, and cut ones come back."""
    import random

    from gleanery.operators.selection import Policy

    rng = random.Random(5)
    store, policy = store_at(spark, tmp_path), Policy(window=3)
    item = ("item_id string, raw_asset_id string, source_id string, title string, canonical_url string, canonical_url_conflict string,"
            " content_text string, published_at timestamp, created_at timestamp")
    enriched = ("item_id string, title string, created_at timestamp, version_id bigint, summary_short string, summary_long string,"
                " why_it_matters string, topic string, importance_score double, novelty_score double, preserve_recommendation string")
    body = "Some words that tell what happened here and why it matters to readers of this. " * 3
    rebuilt = []
    whole = microbatch._selectable
    microbatch._selectable = lambda *a: rebuilt.append(1) or whole(*a)
    try:
        for batch in range(10):
            items, answers = [], []
            for i in range(4):
                name = f"i{batch:02d}{i}"
                at = AT + dt.timedelta(minutes=rng.randrange(1000))
                title = f"Story number {rng.randrange(12)} of the year"
                seen = None if rng.random() < 0.2 else at
                items.append((name, f"a-{name}", f"s{rng.randrange(2)}", title, None, None, body, seen, at))
                topic = rng.choice(["Research", "research!", " ", "Tools"])
                if rng.random() < 0.9:
                    answers.append((name, title, at, batch, body, body, body, topic, rng.randrange(60, 99) / 100, rng.random(), "keep"))
            store.write("items", spark.createDataFrame(items, item), batch)
            store.write("enrichments", spark.createDataFrame(answers, enriched), batch)
            own = spark.createDataFrame(answers, enriched)
            microbatch.write_groups(store, own.select("item_id", "topic", F.col("created_at").alias("at")), batch)
            microbatch.select_batch(store, sources(spark), batch, policy)
            if batch % 3 == 0:
                found = store.read("selections").where(F.col("run_id") == batch).drop("run_id", "batch_id")
                expected = microbatch.rebuilt_selection(store, sources(spark), batch, policy).select(*found.columns)
                rebuilt.pop()
                assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
        assert store.read("selection_state").where("batch_id = 9").count() <= 6
        assert len(rebuilt) <= 5
    finally:
        microbatch._selectable = whole


def test_catalogue_batches_read_their_rows_once(spark, tmp_path):
    """The rows may be gone after the first batch; those without a number belong to none."""
    path = str(tmp_path / "rows")
    spark.range(30).selectExpr("id", "nullif(id % 5, 4) as n").write.parquet(path)
    store = microbatch.Store(spark, str(tmp_path / "store"))
    found = {}
    for batch_id, own in table_batches._batches(store, spark.read.parquet(path), F.col("n")):
        found[batch_id] = sorted(r["id"] for r in own.collect())
        spark.range(0).selectExpr("id", "id as n").write.mode("overwrite").parquet(path)
    assert found == {b: [i for i in range(30) if i % 5 == b] for b in range(table_batches.BATCHES)}

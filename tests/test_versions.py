"""Bucketed version history against the whole window, and the files it opens and writes."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.operators.history import enrichment_history
from gleanery.streaming.versions import VersionTable

SCHEMA = StructType().add("item_id", "long").add("version_id", "long").add("created_at", "long").add("score", "double")


def table_at(spark, path, buckets=8):
    return VersionTable(spark, str(path / "versions"), SCHEMA, buckets)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {f: f.read_bytes() for f in sorted((path / "versions").rglob("*.parquet")) if "pointers" not in str(f)}


def bucket_of(spark, item, buckets=8):
    return frame(spark, [(item, 0, 0, 0.0)]).select(F.pmod(F.xxhash64("item_id"), F.lit(buckets))).first()[0]


def test_batches_in_any_order_equal_the_whole_window(spark, tmp_path):
    rng, table, known = random.Random(4), table_at(spark, tmp_path), {}
    names = ["item_id", "version_id", "created_at", "score", "superseded_at", "is_current"]
    for batch in range(5):
        rows = [(rng.randrange(20), 10 * batch + i, rng.randrange(1000), float(i)) for i in range(9)] if batch != 2 else []
        known |= {r[:2]: r for r in rows}
        table.add(frame(spark, [*rows, (None, 1, 1, 0.0), (1, None, 1, 0.0)]), batch)
    whole = enrichment_history(frame(spark, list(known.values()))).select(*names)
    expected = sorted(map(str, whole.collect()))
    assert sorted(map(str, table.history(5).select(*names).collect())) == expected
    current = [r for r in whole.drop("is_current", "superseded_at").collect() if str(r.item_id)]
    newest = {i: max((r for r in known.values() if r[0] == i), key=lambda r: (r[2], r[1])) for i in {r.item_id for r in current}}
    assert sorted(tuple(r)[:4] for r in table.current(5).collect()) == sorted(newest.values())


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = table_at(spark, tmp_path)
    table.add(frame(spark, [(i, 0, i, 0.0) for i in range(100)]), 0)
    before, own = files(tmp_path), bucket_of(spark, 7)
    table.add(frame(spark, [(7, 1, 500, 1.0)]), 1)
    after = files(tmp_path)
    assert all(after[f] == content for f, content in before.items())
    written = {str(f) for f in after.keys() - before.keys() if "staged" not in str(f)}
    assert written and all(f"batch=1/bucket={own}/" in f for f in written)
    assert {b for b, n in table.pointers(2).items() if n == 1} == {own}
    assert sum(n == 0 for n in table.pointers(2).values()) == 7


def test_current_rows_open_no_closed_file_and_no_old_bucket(spark, tmp_path):
    table = table_at(spark, tmp_path)
    table.add(frame(spark, [(i, 0, i, 0.0) for i in range(60)]), 0)
    table.add(frame(spark, [(7, 1, 500, 1.0)]), 1)
    opened = table.current(2).inputFiles()
    assert all("/current/" in f for f in opened)
    assert not [f for f in opened if f"batch=0/bucket={bucket_of(spark, 7)}/" in f]
    plan = table.current(2)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_replays_late_and_repeated_versions(spark, tmp_path):
    table = table_at(spark, tmp_path)
    assert table.current(9).count() == 0 and table.history(9).count() == 0 and table.pointers(9) == {}
    table.add(frame(spark, [(1, 2, 50, 0.2), (1, 2, 50, 0.2)]), 3)
    for _ in range(2):  # an older version than the one known, and the same batch again
        table.add(frame(spark, [(1, 1, 10, 0.1)]), 5)
    found = sorted((r.version_id, r.superseded_at, r.is_current) for r in table.history(6).collect())
    assert found == [(1, 50, False), (2, None, True)]
    assert [r.version_id for r in table.history(5).collect()] == [2]
    table.add(frame(spark, [(1, 2, 5, 0.9)]), 6)      # replaced, now the older of both
    found = sorted((r.version_id, r.score, r.superseded_at, r.is_current) for r in table.history(7).collect())
    assert found == [(1, 0.1, None, True), (2, 0.9, 10, False)]
    table.add(frame(spark, []), 7)
    assert table.current(8).count() == 1


def test_retired_folders_are_gone_and_nothing_is_lost(spark, tmp_path):
    table = table_at(spark, tmp_path, buckets=2)
    for batch in range(4):
        table.retire(batch)
        table.add(frame(spark, [(i, batch, batch, 0.0) for i in range(10)]), batch)
    kept = sorted(p.parent.name + "/" + p.name for p in (tmp_path / "versions" / "current").glob("batch=*/bucket=*"))
    assert kept == [f"batch={b}/bucket={k}" for b in (2, 3) for k in (0, 1)]
    assert len(list((tmp_path / "versions" / "pointers").glob("batch=*"))) == 2
    assert table.history(4).count() == 40 and table.current(4).where("version_id = 3").count() == 10
    table.retire(3)
    table.add(frame(spark, [(i, 3, 3, 0.0) for i in range(10)]), 3)     # the replay of a batch
    assert table.history(4).count() == 40

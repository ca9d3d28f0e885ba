"""Keyed logs: segments, Bloom filters and buckets against a plain dictionary."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.streaming.keyed import KeyedLog, segments

SCHEMA = StructType().add("key", "string").add("at", "long").add("holder", "string")


def log_at(spark, path, **sizes):
    return KeyedLog(spark, str(path / "log"), SCHEMA, **{"buckets": 8, "fanout": 3, **sizes})


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_segments_cover_all_batches_once_and_are_few(fanout):
    for before in range(0, 300):
        covered = [b for level, n in segments(before, fanout) for b in range(n * fanout**level, (n + 1) * fanout**level)]
        assert covered == list(range(before))
        assert len(list(segments(before, fanout))) <= 9 * fanout


def test_lookup_equals_a_dictionary_over_merged_batches(spark, tmp_path):
    rng = random.Random(1)
    log, known = log_at(spark, tmp_path), {}
    for batch in range(10):
        rows = [(f"k{rng.randrange(60)}", rng.randrange(100), f"h{rng.randrange(9)}") for _ in range(12)]
        rows = [] if batch == 6 else [*rows, (None, 1, "x")]
        asked = [(f"k{rng.randrange(80)}", 0, "") for _ in range(15)]
        if batch in (4, 9):
            found = {r["key"]: (r["at"], r["holder"]) for r in log.lookup(frame(spark, asked), batch).collect()}
            assert found == {k: known[k] for k, *_ in asked if k in known}
        for key, *value in rows:
            if key is not None:
                known[key] = min(known.get(key, tuple(value)), tuple(value))
        log.write(frame(spark, rows), batch)
    assert log.lookup(frame(spark, []), 10).count() == 0


def test_untouched_buckets_are_not_read(spark, tmp_path):
    """Files of buckets that the filters rule out are overwritten by rubbish, and nobody notices."""
    log = log_at(spark, tmp_path, buckets=16, filter_bits=1 << 12)
    log.write(frame(spark, [(f"k{i}", i, "h") for i in range(400)]), 0)
    asked = frame(spark, [("k7", 0, ""), ("new1", 0, ""), ("new2", 0, "")])
    ((rows, hits),) = log.opened(asked, 1)
    own = frame(spark, [("k7", 0, "")]).select(F.pmod(F.xxhash64("key"), F.lit(16))).first()[0]
    assert hits == [own]
    files = sorted((tmp_path / "log" / "rows").rglob("*.parquet"))
    spoiled = [f for f in files if f"bucket={own}/" not in str(f)]
    assert len(spoiled) >= 14
    for file in spoiled:
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"rubbish")
    assert [tuple(r) for r in log.lookup(asked, 1).collect()] == [("k7", 7, "h")]
    scan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1]


def test_replay_and_gaps(spark, tmp_path):
    log = log_at(spark, tmp_path)
    for batch in (1, 2, 5, 5):
        log.write(frame(spark, [(f"b{batch}", batch, "h")]), batch)
    asked = frame(spark, [("b1", 0, ""), ("b2", 0, ""), ("b5", 0, "")])
    assert sorted(r["key"] for r in log.lookup(asked, 6).collect()) == ["b1", "b2", "b5"]
    assert sorted(r["key"] for r in log.lookup(asked, 5).collect()) == ["b1", "b2"]


def test_retired_segments_are_gone_and_nothing_is_lost(spark, tmp_path):
    log = log_at(spark, tmp_path)
    for batch in range(10):
        log.retire(batch)
        log.write(frame(spark, [(f"b{batch}", batch, "h"), ("each", batch, "h")]), batch)
        assert {r["key"]: r["at"] for r in log.all(batch + 1).collect()} == {"each": 0, **{f"b{b}": b for b in range(batch + 1)}}
    left = sorted(p.parent.name + "/" + p.name for p in (tmp_path / "log" / "rows").glob("level=*/number=*"))
    assert left == ["level=0/number=9", "level=2/number=0"]
    log.retire(9)
    log.write(frame(spark, [("b9", 9, "h"), ("each", 9, "h")]), 9)      # the replay of a batch
    assert log.all(10).count() == 11


def test_retire_spares_segments_that_were_never_merged(spark, tmp_path):
    log = log_at(spark, tmp_path)
    for batch in (0, 1):                                                # batch 2 never ran
        log.write(frame(spark, [(f"b{batch}", batch, "h")]), batch)
    log.retire(3)
    assert len(list((tmp_path / "log" / "rows").glob("level=0/number=*"))) == 2

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import mixing

SCHEMA = "doc_id long, source string, text string, _key string, _draws int, target int"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "k", 1, 2) for i, s, t in rows], SCHEMA)


def corpus():
    random = np.random.default_rng(1)
    rows = [(i, ["b", "a", None, "é", ""][i % 5] if i % 3 else "a", "w " * int(random.integers(1, 200))) for i in range(900)]
    return rows + [(900, "a", None), (901, "b", ""), (None, "b", "x y"), (None, "b", "x y"), (5, rows[5][1], rows[5][2])]


def test_targets_are_shared_again_until_none_is_above():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200, 450 * 2 / 8 + (450 * 5 / 8 - 200) * 2 / 3, 450 / 8 + (450 * 5 / 8 - 200) / 3]
    assert mixing.targets([10, 1000], [5, 2]) == [20, 1495]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []
    assert sum(mixing.targets([7, 1, 99, 3], [5, 2, 1, 5])) == pytest.approx(165)


def test_report_contract(spark):
    rows = corpus()
    result = mixing.report(frame(spark, rows)).collect()
    again = mixing.report(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, result)) == sorted(map(str, again)) and len(result) == len(rows)
    key = {}
    for i, s, t in rows:
        key.setdefault(i, s)
    sizes, taken, target = {}, {}, {}
    for r in result:
        assert 0 <= r.taken <= 2 * r["size"]
        s = key[r.doc_id] if r.doc_id is not None else "b"
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], total = r.target, r.source_size
    order = sorted((s for s in sizes if s is not None)) + [None]
    wanted = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert [target[s] for s in order] == pytest.approx(wanted)
    assert all(abs(taken[s] - target[s]) <= 20 for s in order)


def test_sizes_and_targets_equal_brute_force(spark):
    rows = corpus()
    order = [*sorted({s for _, s, _ in rows if s is not None}), None]
    sizes = [sum(len((t or "").split()) for _, s, t in rows if s == source) for source in order]
    weights = [(5, 2, 1)[i % 3] for i in range(len(order))]
    low, high = 0.0, 2.0 * sum(sizes)
    for _ in range(200):  # the level at which min(twice the size, weight by level) fill the mix
        level = (low + high) / 2
        filled = sum(min(2 * s, w * level) for s, w in zip(sizes, weights))
        low, high = (low, level) if filled > 1.5 * sum(sizes) else (level, high)
    wanted = {o: (s, min(2 * s, w * high)) for o, s, w in zip(order, sizes, weights)}
    expected = sorted((i if i is not None else -1, len((t or "").split()), *wanted[s]) for i, s, t in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.source_size, r.target) for r in mixing.report(frame(spark, rows)).collect())
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected])


def test_runs_of_blocks_change_nothing_and_blocks_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    whole = sorted(map(str, mixing.report(frame(spark, corpus())).collect()))
    monkeypatch.setattr(mixing, "RUN_BLOCKS", 3)
    assert sorted(map(str, mixing.report(frame(spark, corpus())).collect())) == whole
    sized = frame(spark, corpus()).select("doc_id", "source", mixing.size_column("text").alias("_size"))
    drawn = {}
    for r in mixing.assigned(sized).collect():
        for draw in r._draws:
            drawn[r.source, draw["pass"]] = drawn.get((r.source, draw["pass"]), 0) + r._size
    assert sum(drawn.values()) == pytest.approx(1.5 * sum(len((t or "").split()) for _, _, t in corpus()), abs=60)


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = frame(spark, corpus())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len((t or "").split()) for _, _, t in corpus())
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == pytest.approx(1.5 * words, abs=60)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.report(frame(spark, [])).count() == 0
    assert mixing.report(frame(spark, [(1, None, None), (2, "a", "")])).count() == 2


@pytest.mark.parametrize("shards", [1, 2, 3, 8, 13])
def test_tree_gives_disjoint_exact_quotas(shards):
    counts = [10, 0, 3, 250]
    parts = [mixing.shard_quotas(counts, shards, s) for s in range(shards)]
    assert np.array_equal(sum(q for _, q in parts), counts)
    for (start, quota), (following, _) in zip(parts, parts[1:]):
        assert np.array_equal(start + quota, following)
    assert max(q.sum() for _, q in parts) - min(q.sum() for _, q in parts) <= shards.bit_length()


def test_a_shard_is_sorted_in_slices_that_follow_one_another(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 20_000)
    docs = spark.range(3000).selectExpr("id as doc_id", "'s' as source", "repeat('a ', 10) as text")
    drawn = mixing.assigned(docs.withColumn("_size", F.lit(10).cast("long"))).withColumn("d", F.explode("_draws"))
    order = F.xxhash64(F.lit(mixing.SEED), "d.pass", "d.shard", "doc_id")
    wanted = [r.doc_id for r in drawn.orderBy("d.shard", order, "doc_id").collect()]
    rows = mixing.mix(docs).withColumn("part", F.spark_partition_id()).collect()
    parts = [r.part for r in rows]
    assert [r.doc_id for r in rows] == wanted and len(wanted) > 4000
    assert max(map(parts.count, set(parts))) < 400

import numpy as np

from gleanery.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, shard int"


def brute(rows, queries, k):
    whole = {i: np.floor(256 * np.array(v, float)) for i, v in rows}
    out = {}
    for q in queries:
        ranked = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in ranked]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_pruned_search_is_exact(spark):
    random = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in random.normal(size=8).round(1)]) for i in range(700)]
    vectors = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    asked = vectors.where("vec_id % 7 = 0")
    assert found(topk.search(vectors, asked, 4)) == brute(rows, range(0, 700, 7), 4)


def test_pruning_skips_blocks():
    vectors = np.zeros((640, 4))
    vectors[:64] = 100
    vectors[64:] = np.random.default_rng(1).integers(0, 9, (576, 4))
    blocks = topk.Blocks(np.arange(640), vectors)
    bounds = np.hstack([np.full(4, 1.0), np.zeros(4)]) @ blocks.most.T
    seen = []
    blocks.cuts = type("Cuts", (list,), {"__getitem__": lambda self, b: seen.append(b) or list.__getitem__(self, b)})(blocks.cuts.tolist())
    ids, scores = blocks.search(-1, np.ones(4), bounds, 3)
    assert list(ids) == [0, 1, 2] and list(scores) == [400, 400, 400] and len(seen) // 2 <= topk.STEP


def test_floor_of_one_shard_serves_all_others(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 90)
    random = np.random.default_rng(8)
    rows = [(int(i), [float(np.float32(x)) for x in random.normal(size=6).round(1)]) for i in range(500)]
    rows += [(i, rows[i % 7][1]) for i in range(500, 560)]     # ties across shards
    vectors = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    asked = vectors.where("vec_id % 2 = 0")                    # more than a shard of queries
    assert found(topk.search(vectors, asked, 5)) == brute(rows, range(0, 560, 2), 5)
    few = vectors.where("vec_id < 4")
    assert found(topk.search(few, asked, 5)) == {
        q: sorted(((i, int(np.floor(256 * np.array(rows[q][1])) @ np.floor(256 * np.array(rows[i][1])))) for i in range(4) if i != q), key=lambda p: (-p[1], p[0]))
        for q in range(0, 560, 2)
    }


def test_blocks_below_the_floor_stay_closed():
    blocks = topk.Blocks(np.arange(640), np.repeat([[9.0], [1.0]], [64, 576], axis=0))
    bounds = np.array([1.0, 0.0]) @ blocks.most.T
    assert list(blocks.search(-1, np.ones(1), bounds, 3, 9.0)[1]) == [9, 9, 9]
    assert not len(blocks.search(-1, np.ones(1), bounds, 3, 10.0)[0])


def test_ties_nulls_few_rows_and_huge_values(spark):
    nan, inf = float("nan"), float("inf")
    vectors = spark.createDataFrame(
        [
            (0, [1.0, 1.0], 0, 0), (5, [1.0, 1.0], 0, 0), (4, [1.0, 1.0], 0, 0), (5, [1.0, 1.0], 0, 0),
            (6, [nan, 1.0], 0, 0), (7, [None, 1.0], 0, 0), (8, None, 0, 0), (9, [inf, 0.0], 0, 0),
            (None, [9.0, 9.0], 0, 0), (10, [2.0], 0, 0), (11, [], 0, 0),
        ],
        SCHEMA,
    )
    result = found(topk.search(vectors, vectors.where("vec_id = 0"), 5))
    assert result == {0: [(4, 131072), (5, 131072), (10, 131072), (11, 0)]}
    huge = spark.createDataFrame([(0, [3e38], 0, 0), (1, [3e38], 0, 0), (2, [-3e38], 0, 0)], SCHEMA)
    assert found(topk.search(huge, huge.where("vec_id = 0"), 5)) == {0: [(1, topk.LARGEST), (2, -topk.LARGEST)]}
    assert topk.report(spark.createDataFrame([], SCHEMA)).count() == 0

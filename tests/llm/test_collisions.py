import numpy as np

from gleanery.llm import collisions

SCHEMA = "vec_id long, embedding array<float>, label int, node int"


def brute(ids, vectors, labels):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return [(i, j) for i in range(len(ids)) for j in range(i) if labels[i] == labels[j] and unit[i] @ unit[j] >= 0.93]


def test_recall_and_exactness_near_the_threshold(spark):
    random = np.random.default_rng(2)
    centers = random.normal(size=(150, 32))
    vectors = np.concatenate([centers + random.normal(size=(150, 32)) * s for s in (0, 0.15, 0.2, 0.25)]).astype("f4").astype(float)
    labels = np.tile(np.arange(150) % 2, 4)
    rows = [(int(i), v.tolist(), int(l), 0) for i, (v, l) in enumerate(zip(vectors, labels))]
    found = {r.vec_id: r for r in collisions.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    exact = np.zeros(len(rows), int)
    for i, j in brute(range(len(rows)), vectors, labels):
        exact[[i, j]] += 1
    counts = np.array([found[i].n_links for i in range(len(rows))])
    assert (counts <= exact).all() and counts.sum() >= 0.98 * exact.sum() > 100
    assert all(found[i].kept == (found[i].component_id == i) for i in found)


def test_candidates_are_the_pairs_with_enough_collisions(monkeypatch):
    monkeypatch.setattr(collisions, "STRIP", 17)
    random = np.random.default_rng(9)
    for columns, need in ((24, 16), (24, 24), (24, 0), (5, 4), (1, 1)):
        left, right = random.normal(size=(60, columns)), random.normal(size=(80, columns))
        right[:30] = left[:30] + random.normal(size=(30, columns)) * 0.3
        right[30:40], left[40:50, 0] = left[30:40], 0.5       # equal values, ties in the order
        right[40:50, 0] = 1.0                                  # on the edge of a window
        counts = ((right[None] >= left[:, None] - 0.5) & (right[None] <= left[:, None] + 0.5)).sum(axis=2)
        i, j = collisions.candidates(left, right, 0.5, need)
        assert list(zip(i, j)) == list(zip(*np.nonzero(counts >= need)))
    none = np.zeros((0, 3))
    assert not len(collisions.candidates(none, none, 1.0, 2)[0]) and not len(collisions.candidates(np.ones((2, 3)), none, 1.0, 2)[0])


def test_small_blocks_meet_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 7)
    random = np.random.default_rng(5)
    vectors = np.concatenate([random.normal(size=(1, 16)) + random.normal(size=(60, 16)) * 0.05, random.normal(size=(60, 16))])
    rows = [(int(i), v.tolist(), 1, 0) for i, v in enumerate(vectors)]
    found = {r.vec_id: r for r in collisions.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i].n_links == 59 and found[i].component_id == 0 for i in range(60))
    assert all(found[i].n_links == 0 for i in range(60, 120))


def test_copies_nulls_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], 1, 0), (3, [1.0, 0.0], 1, 0), (4, [2.0, 0.0], 1, 0), (9, [1.0, 0.0], 2, 0), (3, [1.0, 0.0], 1, 0),
        (6, [0.0, 0.0], 1, 0), (7, None, 1, 0), (8, [nan, 0.0], 1, 0), (10, [inf, 0.0], 1, 0), (11, [None, 1.0], 1, 0),
        (12, [1.0, 0.0], None, 0), (None, [1.0, 0.0], 1, 0), (13, [1.0, 0.0, 0.0], 1, 0), (14, [], 1, 0), (15, [3e38, 0.0], 1, 0),
    ]
    found = sorted(tuple(r) for r in collisions.report(spark.createDataFrame(rows, SCHEMA)).collect() if r.vec_id is not None)
    together = [(3, 4, 3, True), (3, 4, 3, True), (4, 4, 3, False), (5, 4, 3, False), (15, 4, 3, False)]
    alone = [(i, 0, i, True) for i in (6, 7, 8, 9, 10, 11, 12, 13, 14)]
    assert found == sorted(together + alone)
    assert collisions.report(spark.createDataFrame([], SCHEMA)).count() == 0

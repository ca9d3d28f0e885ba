import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, tile string"


def brute(rows, anchors=lambda i: i % 10 == 0):
    """Every anchor against every row, from the contract's words."""
    good = [
        (i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max((len(v) for *_, v in good), default=0)
    good = [(i, label, v + [0] * (width - len(v))) for i, label, v in good]
    asking = {}
    for i, label, v in sorted(good):
        if anchors(i):
            asking.setdefault(i, (label, v))
    out = []
    for a, (label, v) in asking.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in good)
        near = [(i, -s) for s, i, same in scored if same and i != a][:5]
        for p, positive in near:
            fits = [(i, -s) for s, i, same in scored if not same and 30 * positive <= -100 * s <= 90 * positive][:10]
            out += [(a, p, rank + 1, n, positive, score) for rank, (n, score) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, label, 0, "x") for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(frame, F.col("vec_id") % 10 == 0, **how).collect())


def clustered(seed, n, width=6):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(5, width))
    return [
        (int(i), [float(x) for x in (centres[random.integers(5)] + 0.4 * random.normal(size=width)).round(2)], int(random.integers(4)))
        for i in random.permutation(n)
    ]


@pytest.mark.parametrize("tile_bytes", [1 << 22, 6000])
def test_equals_brute_force(spark, tile_bytes):
    rows = clustered(5, 400)
    assert mined(spark, rows, tile_bytes=tile_bytes) == brute(rows) != []


def test_nulls_ties_repeats_and_wide_values(spark):
    rows = clustered(2, 60)
    rows += [(None, [1.0] * 6, 1), (70, None, 1), (80, [1.0] * 6, None), (90, [1.0, None], 2), (100, [float("nan")] * 6, 1)]
    rows += [(110, [], 1), (111, [0.5], 1), (120, [1.0] * 6, 1), (121, [1.0] * 6, 1), (122, [1.0] * 6, 1), (123, [1.0] * 6, 2)]
    rows += [(i, [0.9] * 6, 2) for i in range(130, 150)]             # equal vectors, ties by id
    rows += [(151, [0.7] * 6, 3), (151, [0.7] * 6, 3)]
    rows += [(160, [1e6, 2.0], 1), (161, [1e6, 3.0], 1), (162, [9e5, 1.0], 2)]
    assert mined(spark, rows, tile_bytes=1500) == brute(rows)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0], 1)]) == []
    assert mined(spark, [(10, [], 1), (20, [], 1), (21, [], 2)]) == brute([(10, [], 1), (20, [], 1), (21, [], 2)])


def test_cells_come_by_falling_bound_and_bound_their_rows():
    random = np.random.default_rng(0)
    whole = random.integers(-300, 300, (500, 8)).astype(float)
    books = [negatives.fit_codebook(h, 6) for h in negatives.halves(whole)]
    codes = np.stack([negatives.nearest(h, b) for h, b in zip(negatives.halves(whole), books)], axis=1)
    index = negatives.MultiIndex(np.arange(500), np.zeros(500, int), whole, codes)
    query = whole[3]
    visited = list(index.visit(query))
    bounds = [b for b, _ in visited]
    assert bounds == sorted(bounds, reverse=True)
    assert sum(end - start for _, (start, end) in visited) == 500
    assert all((index.whole[start:end] @ query).max() <= bound for bound, (start, end) in visited)


def test_the_walk_stops_early():
    random = np.random.default_rng(0)
    whole = np.vstack([random.normal(300 * k, 3, (1000, 8)) for k in range(4)]).round()
    codes = np.repeat(np.arange(4), 1000)[:, None].repeat(2, axis=1)
    index = negatives.MultiIndex(np.arange(4000), np.ones(4000, int), whole, codes)
    anchor = {"anchor_id": 3999, "label": 1, "floors": [None], "scores": [0]}
    seen = []
    walk = index.scored
    index.scored = lambda query, least: (seen.append(len(rows)) or (rows, s) for rows, s in walk(query, least))
    found = list(negatives.positives(index, anchor, whole[3999], 5))
    best = sorted((-int(whole[i] @ whole[3999]), i) for i in range(3999))[:5]
    assert [(-s, i) for _, i, s in found] == best and sum(seen) == 1000

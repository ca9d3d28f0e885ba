import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import components, simhash

SCHEMA = "doc_id long, text string, fp string, component_id int, _rest int, _fp int"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def test_report_equals_brute_force(spark):
    dice = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["É", "É x"]
    base = [[dice.choice(words) for _ in range(dice.choice([1, 2, 3, 40, 400]))] for _ in range(30)]
    rows = [(None, None), (50, None), (49, ""), (48, " \n\t"), (None, "a b c d"), (5, "a b c d"), (5, "A B c D")]
    for i in range(120):
        text = list(dice.choice(base))
        if dice.random() < 0.5:
            text[dice.randrange(len(text))] = dice.choice(words)
        rows.append((100 + i, dice.choice([" ", "\n"]).join(text)))
    rows += rows[-3:]
    prints = [(i, brute_print(t)) for i, t in rows]
    known = [(i, p) for i, p in prints if i is not None]
    heads = {}
    for i, p in known:
        heads[p] = min(heads.get(p, i), i)
    edges = [(heads[p], heads[q]) for p in heads for q in heads if (p ^ q).bit_count() <= 2]
    roots = closed(set(heads.values()), edges)
    expected = sorted(((i, f"{p:016x}", None if i is None else roots[heads[p]]) for i, p in prints), key=str)
    assert sorted([tuple(r) for r in simhash.report(frame(spark, rows)).collect()], key=str) == expected


def test_hot_fingerprints_change_nothing(spark, monkeypatch):
    rows = [(i, "") for i in range(40, 10, -1)] + [(i, "a b c d") for i in range(50, 70)] + [(3, "x y z"), (None, ""), (None, "x")] + [(60, "a b c d")] * 30
    plain = sorted(map(str, simhash.report(frame(spark, rows)).collect()))
    monkeypatch.setattr(simhash, "HOT_ROWS", 2)
    monkeypatch.setattr(simhash, "HOT_PRINTS", 1)
    assert sorted(map(str, simhash.report(frame(spark, rows)).collect())) == plain and len(plain) == len(rows)


def test_equal_ids_with_other_texts_are_kept_apart(spark):
    rows = [(5, "one two three four"), (5, "five six seven eight"), (9, "one two three four"), (None, None), (None, "x")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_per_group(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[3], rows[4]], key=str)


def test_bound_and_grid_hold():
    random_ = np.random.default_rng(0)
    masks = [m & (1 << 64) - 1 for m in simhash._grid_masks(2)]

    def counts(x):
        return [(x >> 2 * i & 3).bit_count() for i in range(32)]

    for _ in range(300):
        a = int(random_.integers(0, 1 << 63)) << 1 | 1
        b = a
        for bit in random_.choice(64, 2):
            b ^= 1 << int(bit)
        pa, pb = (sum(c << 2 * i for i, c in enumerate(counts(x))) for x in (a, b))
        assert sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= (a ^ b).bit_count()
        assert any(pa & m == pb & m for m in masks)


def test_popcounts_and_distance_columns(spark):
    values = [(0, -1), (5, 7), (-(1 << 63), (1 << 63) - 1), (0x0F0F, 0x00FF), (-2, 3)]
    pairs = spark.createDataFrame(values, "a long, b long")
    found = pairs.select("a", "b", simhash.manhattan(simhash.popcounts(F.col("a")), simhash.popcounts(F.col("b"))).alias("d"))
    for r in found.collect():
        expected = sum(abs((r.a >> 2 * i & 3).bit_count() - (r.b >> 2 * i & 3).bit_count()) for i in range(32))
        assert r.d == expected


@pytest.mark.parametrize("crowd", [1, 64])
def test_crowded_cells_lose_no_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    dice = random.Random(9)
    points = set()
    for _ in range(12):
        center = dice.getrandbits(64)
        for _ in range(25):
            p = center
            for bit in dice.sample(range(64), dice.randint(0, 3)):
                p ^= 1 << bit
            points.add(p - (1 << 64) if p >> 63 else p)
    found = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long")).collect()
    exact = [(p, q) for p in points for q in points if p < q and bin((p ^ q) & (1 << 64) - 1).count("1") <= 2]
    assert closed(points, [(r.a, r.b) for r in found]) == closed(points, exact)


def test_one_stays_per_group(spark):
    text = " ".join(f"word{i}" for i in range(500))
    rows = [(3, text), (2, text), (2, text), (9, text + " "), (None, text), (None, text), (4, "other text here now"), (6, None), (5, "")]
    kept = simhash.one_per_group(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "component_id", "_rest", "_fp"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "None", "None"]
    assert simhash.one_per_group(frame(spark, [])).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, None), (None, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 90)]])
def test_components(spark, edges):
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert {r.node: r.component for r in found.collect()} == closed({n for e in real for n in e}, real)

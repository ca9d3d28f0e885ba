"""SimHash near-duplicates: popcount embedding, grid join, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.llm.common import bounded_batches, hex64, packed, release, staged, unpacked
from gleanery.llm.components import connected_components

SEED = 42
SLICE = 1 << 16          # shingles counted at once
LOW_BITS = 0x5555555555555555
CROWD = 64               # cells of more points go through shared neighbours
HOT_ROWS = 1000          # rows that make a fingerprint hot
HOT_PRINTS = 128         # hot fingerprints broadcast at most


def _hashes(words: list[bytes], size: int) -> Iterator[list[int]]:
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        yield [digest(b" ".join(words), SEED)]
        return
    for start in range(0, len(words) - size + 1, SLICE):
        part = words[start:start + SLICE + size - 1]
        yield [digest(b" ".join(gram), SEED) for gram in zip(*(part[i:] for i in range(size)), strict=False)]


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """64-bit SimHash over word shingles, as a signed integer; 0 without words.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, as wanted here.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    for hashes in _hashes(words, size):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprint_column(text: str, size: int = 3) -> Column:
    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([fingerprint(t, size) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return simhash(F.col(text))


def _bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def popcounts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, two bits each, as one long."""
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    low = fp.bitwiseAND(F.lit(LOW_BITS))
    return high.bitwiseXOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two packed popcount vectors; never above the Hamming distance."""
    differ = a.bitwiseXOR(b)
    odd = differ.bitwiseAND(F.lit(LOW_BITS))
    two = F.shiftrightunsigned(differ, 1).bitwiseAND(F.lit(LOW_BITS)).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + 2 * F.bit_count(two)


def _grid_masks(distance: int) -> list[int]:
    """Masks of the axes each grid looks at.

    The 32 axes form ``distance + 3`` groups. Points within the distance differ
    in at most ``distance`` groups, so they share a cell of the grid over some
    three groups.
    """
    groups = distance + 3
    edges = [round(32 * i / groups) for i in range(groups + 1)]
    masks = [sum(3 << 2 * axis for axis in range(edges[i], edges[i + 1])) for i in range(groups)]
    chosen = [sum(masks[i] for i in parts) for parts in combinations(range(groups), 3)]
    return [mask - (1 << 64) if mask >= 1 << 63 else mask for mask in chosen]


def links(points: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly what chains of close fingerprints connect.

    ``points``: distinct long column ``fp``. Pairs are tried within cells of at
    most ``CROWD`` points: Manhattan distance of the popcounts first, a lower
    bound, then the exact distance. Points of fuller cells never meet pairwise:
    each is listed under every fingerprint up to half the distance away. Two points within an
    even distance share such a neighbour, everything listed under one neighbour
    is within the distance, and no list exceeds the number of flips (65 at
    distance 2), so links to its smallest member suffice.
    """
    if distance != 2:
        raise ValueError("crowded cells are resolved for distance 2")
    embedded = points.select("fp", popcounts(F.col("fp")).alias("counts"))
    cells = embedded.select(
        "fp",
        "counts",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(mask)).alias("at"))
                    for i, mask in enumerate(_grid_masks(distance))
                ]
            )
        ).alias("cell"),
    )
    filled = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("points")).where("points > 1")
    shared = staged(cells.join(filled, "cell").select("cell.grid", "cell.at", "fp", "counts", "points"))
    few = shared.where(F.col("points") <= CROWD).drop("points")
    left = few.select("grid", "at", F.col("fp").alias("a"), F.col("counts").alias("a_counts"))
    right = few.select("grid", "at", F.col("fp").alias("b"), F.col("counts").alias("b_counts"))
    near = (
        left.join(right, ["grid", "at"])
        .where(F.col("a") < F.col("b"))
        .where(manhattan(F.col("a_counts"), F.col("b_counts")) <= distance)
        .where(_bits(F.col("a"), F.col("b")) <= distance)
        .select("a", "b")
        .distinct()
    )
    flips = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    listed = (
        shared.where(F.col("points") > CROWD)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(flip)) for flip in flips])).alias("beside"))
        .groupBy("beside")
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
        .distinct()
    )
    return near.union(listed)


def _named(prints: DataFrame, distance: int) -> DataFrame:
    """A row per fingerprint of ``prints`` (doc_id, fp): head and lowest, the smallest
    doc_id with it and in its group, and rows, how many rows have it."""
    heads = staged(
        prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("rows"))
    )
    components = connected_components(links(heads.select("fp"), distance))
    merged = (
        components.join(heads, F.col("node") == F.col("fp"))
        .select("node", "component", "head")
    )
    smallest = merged.groupBy("component").agg(F.min("head").alias("lowest"))
    label = merged.join(smallest, "component").select(F.col("node").alias("fp"), "lowest")
    return heads.join(label, "fp", "left").select("fp", "head", "rows", F.coalesce("lowest", "head").alias("lowest"))


def near_duplicates(docs: DataFrame, distance: int = 2, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints that differ in
    at most ``distance`` bits. Texts that are null, empty or blank have fingerprint
    zero and link like others. A row without doc_id links nothing and has no
    component; rows repeating a doc_id each get their own. Other columns are not read.

    Rows of the most frequent fingerprints (``HOT_PRINTS`` at most) find their group
    map-side; only the others are shuffled by fingerprint.
    """
    bounded_batches(docs.sparkSession)
    prints = staged(docs.select("doc_id", fingerprint_column("text", size).alias("fp")))
    named = staged(_named(prints, distance))
    hot = (
        named.where(F.col("rows") >= HOT_ROWS).orderBy(F.desc("rows"), "fp").limit(HOT_PRINTS)
        .select(F.col("fp").alias("_hot"), F.col("lowest").alias("_hot_lowest"))
    )
    answered = prints.where("doc_id is not null").join(F.broadcast(hot), F.col("fp") == F.col("_hot"), "left")
    parts = [
        answered.where("_hot is not null").select("doc_id", "fp", F.col("_hot_lowest").alias("component_id")),
        answered.where("_hot is null").select("doc_id", "fp").join(named.select("fp", "lowest"), "fp", "left")
        .select("doc_id", "fp", F.col("lowest").alias("component_id")),
        prints.where("doc_id is null").select("doc_id", "fp", F.col("doc_id").alias("component_id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def one_per_group(docs: DataFrame, distance: int = 2, size: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the smallest doc_id stays.

    Exact repeats of a row, doc_id included, count as one; rows without doc_id stay.
    All columns are kept. The rows are stored with their fingerprints, which are computed once.
    """
    bounded_batches(docs.sparkSession)
    marked = staged(packed(docs, "doc_id", "text").withColumn("_fp", fingerprint_column("text", size)))
    chosen = _named(marked.select("doc_id", F.col("_fp").alias("fp")), distance).where("head = lowest").select(
        F.col("head").alias("_chosen_id"), F.col("fp").alias("_chosen_fp")
    )
    kept = marked.join(
        chosen, (F.col("doc_id") == F.col("_chosen_id")) & (F.col("_fp") == F.col("_chosen_fp")), "left_semi"
    ).dropDuplicates(["doc_id", "_fp"])
    return unpacked(kept.unionByName(marked.where("doc_id is null")), docs.columns, "doc_id", "text")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")

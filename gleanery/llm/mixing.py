"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.llm.common import bounded_batches, packed, release, staged, unpacked

WEIGHTS = (5, 2, 1)
SHARE = 1.5              # words of the mix over words there are
MOST = 2                 # passes over a source at most
BLOCK_WORDS = 1 << 14
RUN_BLOCKS = 4096        # blocks whose words one window task adds up
SHARD_WORDS = 1 << 24
SLICE_BITS = 3           # a shard is sorted and stored in 8 slices of its order, each by a task of its own
ORDERS = 64              # permutations tried for a source's last, partly taken block
SEED = 20_240
SMALL_SOURCES = 100_000  # source rows (name and three numbers) broadcast at most


def size_column(text: str) -> Column:
    """Number of runs of bytes other than space and \\t to \\r; 0 for null."""

    @F.arrow_udf("long")
    def words(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([len(t.split()) if t else 0 for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return words(F.col(text))


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source: by weight, at most ``most`` times its size.

    What is above that is shared again by weight among the others until none is above.
    """
    wanted, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in open_:
                wanted[i] = left * weights[i] / weight
            break
        for i in above:
            wanted[i] = float(most * sizes[i])
        left -= sum(wanted[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return wanted


def shard_quotas(counts: Sequence[int], shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(start, quota) by source: the draws of each source that fall to ``shard``.

    Walks the tree from the root. A node splits its exact counts between its
    halves by one multivariate-hypergeometric draw, seeded by the node, so every
    shard finds its own path without the others and all paths agree.
    """
    have, start = np.array(counts, np.int64), np.zeros(len(counts), np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        total = int(have.sum())
        take = total * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, take, method="marginals")
        if shard < middle:
            have, high = left, middle
        else:
            start, have, low = start + left, have - left, middle
    return start, have


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _last_blocks(rows: DataFrame) -> DataFrame:
    """(key, flip, cutoff) per source: which documents of its partly taken block are taken.

    Of several permutations the one with a prefix closest to what is left is
    chosen; a document is in it if its permuted number is at most the cutoff.
    """
    flips = np.random.default_rng(SEED).integers(-(1 << 63), (1 << 63) - 1, ORDERS)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        left, best = float(group["left"].iloc[0]), None
        for flip in flips:
            order = np.bitwise_xor(group["number"].to_numpy(np.int64), flip)
            place = np.argsort(order, kind="stable")
            order, total = order[place], np.cumsum(group["words"].to_numpy(np.int64)[place])
            ends = np.append(order[1:] != order[:-1], True)
            off = np.where(ends, np.abs(total - left), np.inf)
            at = int(off.argmin())
            found = (left, None) if left <= off[at] else (off[at], int(order[at]))
            if best is None or found[0] < best[0]:
                best = (*found, int(flip))
        return pd.DataFrame(
            {"key": group["key"].iloc[:1], "flip": [best[2]], "cutoff": pd.array([best[1]], dtype="Int64")}
        )

    return rows.groupBy("key").applyInPandas(choose, "key string, flip long, cutoff long")


def assigned(
    sized: DataFrame,
    source: str = "source",
    size: str = "_size",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``sharded``."""
    return sharded(sized, source, size, weights, share, seed)[0]


def sharded(
    sized: DataFrame, source: str, size: str, weights: Sequence[float], share: float, seed: int
) -> tuple[DataFrame, int]:
    """``sized`` plus ``_draws`` (array of pass and shard), ``_source_size`` and ``_target``; number of shards.

    Every source is cut into blocks of about ``BLOCK_WORDS`` words by a hash, so also a source
    with most of the rows spreads over many blocks, however large it is. Its quota is whole blocks in block
    order, passing over the source again beyond its size, and of one last block the
    documents that come closest to the target. Block draws fall to output shards by
    the splitting tree: shards get disjoint runs of each source's permuted blocks.
    One row per source and a few totals reach the driver.

    Null sources form one source, ranked last. Documents without words are drawn
    with their block and add nothing. Equal rows share one fate. No rows: no draws.
    """
    spark = sized.sparkSession
    bounded_batches(spark)
    numbered = sized.withColumn("_key", _source_key(F.col(source))).withColumn(
        "_number", F.xxhash64(F.lit(seed), "doc_id", F.col(size))
    )
    totals = sorted(
        ((r["key"], r["words"]) for r in numbered.groupBy(F.col("_key").alias("key")).agg(F.sum(size).alias("words")).collect()),
        key=lambda r: (r[0] == "n", r[0]),
    )
    sizes = [words for _, words in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share)
    sources = spark.createDataFrame(
        [(k, s, t, max(1, -(-s // BLOCK_WORDS))) for (k, s), t in zip(totals, wanted, strict=True)],
        "key string, source_size long, target double, blocks long",
    )
    named = sources.withColumnRenamed("key", "_key")
    placed = (
        numbered.join(F.broadcast(named) if len(totals) <= SMALL_SOURCES else named, "_key")
        .withColumn("_block", F.expr("pmod(xxhash64(_number), blocks)"))
        .drop("blocks")
    )
    counted = staged(
        placed.groupBy(F.col("_key").alias("key"), F.col("_block").alias("block"))
        .agg(F.sum(size).alias("words"), F.first("target").alias("target"), F.first("source_size").alias("total"))
        .withColumn("run", F.expr(f"block div {RUN_BLOCKS}"))
    )
    # words and blocks before each: within runs, and over the sums of the runs before
    runs_before = counted.groupBy("key", "run").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("blocks")).select(
        "key", "run",
        F.expr("sum(words) over (partition by key order by run rows unbounded preceding) - words").alias("words_before"),
        F.expr("sum(blocks) over (partition by key order by run rows unbounded preceding) - blocks").alias("blocks_before"),
        F.expr("sum(blocks) over (partition by key)").alias("present"),
    )
    blocks = (
        counted.withColumn("end", F.expr("sum(words) over (partition by key, run order by block rows unbounded preceding)"))
        .withColumn("place", F.expr("row_number() over (partition by key, run order by block) - 1"))
        .join(runs_before, ["key", "run"])
        .withColumn("end", F.col("end") + F.col("words_before"))
    )
    draws = staged(
        blocks.select("*", F.explode(F.array(*map(F.lit, range(MOST)))).alias("pass"))
        .withColumn("from", F.expr("pass * total + end - words"))
        .withColumn("to", F.expr("pass * total + end"))
        .where("from < target or (pass = 0 and total = 0)")
        .withColumn("whole", F.col("to") <= F.col("target"))
        .withColumn("left", F.col("target") - F.col("from"))
        .withColumn("draw", F.expr("pass * present + blocks_before + place"))
        .select("key", "block", "pass", "draw", "whole", "left")
    )
    last = draws.where("not whole").select("key", "block", "left")
    rows = placed.select(F.col("_key").alias("key"), F.col("_block").alias("block"), F.col("_number").alias("number"), F.col(size).alias("words"))
    picks = staged(_last_blocks(rows.where("words > 0").join(last, ["key", "block"]).drop("block")))

    counts = {r["key"]: r["n"] for r in draws.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys = [k for k, _ in totals]
    root = [counts.get(k, 0) for k in keys]
    shards = max(1, math.ceil(share * sum(sizes) / SHARD_WORDS))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                start, quota = shard_quotas(root, shards, shard, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array([shard] * len(keys), pa.int64()), pa.array(start), pa.array(quota)],
                    names=["key", "shard", "start", "quota"],
                )

    runs = spark.range(shards).mapInArrow(spread, "key string, shard long, start long, quota long").where("quota > 0")
    owners = runs.select("key", "shard", F.explode(F.expr("sequence(start, start + quota - 1)")).alias("draw"))
    plan = (
        draws.join(owners, ["key", "draw"])
        .join(picks, "key", "left")
        .groupBy(F.col("key").alias("_key"), F.col("block").alias("_block"))
        .agg(F.collect_list(F.struct("pass", "shard", "whole", "flip", "cutoff")).alias("_plan"))
    )
    taken = F.filter(
        F.coalesce("_plan", F.array().cast("array<struct<pass:int,shard:bigint,whole:boolean,flip:bigint,cutoff:bigint>>")),
        lambda d: d["whole"] | F.coalesce(F.col("_number").bitwiseXOR(d["flip"]) <= d["cutoff"], F.lit(False)),
    )
    found = (
        placed.join(plan, ["_key", "_block"], "left")
        .withColumn("_draws", F.transform(taken, lambda d: F.struct(d["pass"], d["shard"])))
        .select(*sized.columns, F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_draws")
    )
    return found, shards


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The mixed rows of ``docs`` (doc_id, source, text, ...): a row for each draw.

    Rows of a shard stand together, shuffled by a hash of the draw, in partitions that follow
    one another. All columns are kept.
    """
    needed = ("doc_id", "source", "text")
    sized = packed(docs, *needed).withColumn("_size", size_column("text"))
    rows, shards = sharded(sized, "source", "_size", weights, share, seed)
    drawn = rows.withColumn("_draw", F.explode("_draws"))
    order = F.xxhash64(F.lit(seed), F.col("_draw.pass"), F.col("_draw.shard"), F.col("doc_id"))
    slices = 1 << SLICE_BITS
    part = F.col("_draw.shard") * slices + F.shiftright(order, 64 - SLICE_BITS) + slices // 2
    return unpacked(
        drawn.repartitionById(shards * slices, part.cast("int")).sortWithinPartitions(F.col("_draw.shard"), order, "doc_id"),
        docs.columns, *needed,
    )


def report(docs: DataFrame) -> DataFrame:
    sized = staged(docs.select("doc_id", "source", size_column("text").alias("_size")))
    return assigned(sized).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.size("_draws")).alias("taken"),
    )

"""Joins and orderings that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_KEY_LIMIT = 128      # rows ever broadcast by lookup()
HOT_KEY_MIN_ROWS = 10_000
SCATTER = 4096
BROADCAST_ROWS = 200_000  # id rows sent to every executor at most


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    values: Sequence[str],
    *,
    weight: str,
    spread: Sequence[str],
    min_rows: int = HOT_KEY_MIN_ROWS,
) -> DataFrame:
    """Left-join unique ``right`` rows to a ``left`` grouped by a data-made key.

    ``weight`` names the right column with the number of left rows per key, known
    from the aggregation that made ``right``. The heaviest keys (at most
    ``HOT_KEY_LIMIT``, so the broadcast is bounded by construction) are answered
    map-side. Their rows, and rows with a null key, then carry a scattered key
    through the ordinary join, so no partition receives a whole hot group.
    """
    if left.schema[key].dataType.simpleString() != "string":
        raise ValueError(f"lookup key {key} must be a string")
    hot = (
        right.where(F.col(weight) >= min_rows)
        .orderBy(F.desc(weight), key)
        .limit(HOT_KEY_LIMIT)
        .select(F.col(key).alias("_hot_key"), *[F.col(value).alias(f"_hot_{value}") for value in values])
    )
    cold = right.select(
        F.col(key).alias("_cold_key"), *[F.col(value).alias(f"_cold_{value}") for value in values]
    )
    scattered = F.concat(
        F.lit("\u0001scatter:"), F.pmod(F.xxhash64(*spread), F.lit(SCATTER)).cast("string")
    )
    is_hot = F.col("_hot_key").isNotNull()
    answered = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_join_key", F.when(is_hot | F.col(key).isNull(), scattered).otherwise(F.col(key))
    )
    joined = answered.join(cold, F.col("_join_key") == F.col("_cold_key"), "left")
    found = [
        F.when(is_hot, F.col(f"_hot_{value}")).otherwise(F.col(f"_cold_{value}")).alias(value)
        for value in values
    ]
    return joined.select(*left.columns, *found)


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row of every key.

    ``row_number() = 1`` becomes a per-task group limit before the shuffle, so
    at most one row per key and task is moved.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_n_per_key(df: DataFrame, keys: Sequence[str], n: int, rank: str, *order: Column) -> DataFrame:
    """First ``n`` rows of every key with their rank, limited before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


class Narrow:
    """Reduce large tables to the rows of a chosen id set before joining them.

    The ids must be stored or checkpointed, as they are counted here. Up to
    ``limit`` id rows are broadcast, so that wide tables are filtered where they
    are scanned; a larger set is joined by shuffle.
    """

    def __init__(self, ids: DataFrame, limit: int = BROADCAST_ROWS):
        self.ids = ids
        self.small = ids.select(F.lit(1)).limit(limit + 1).count() <= limit

    def pick(self, *columns: str) -> DataFrame:
        chosen = self.ids.select(*columns)
        return F.broadcast(chosen) if self.small else chosen

    def rows(self, df: DataFrame, key: str) -> DataFrame:
        return df.join(self.pick(key), key, "left_semi")

"""Earlier values along a key's timeline, as a prefix scan.

A plain window puts all rows of a key in one task. Here rows are range-partitioned on
(key, time, tie) into pieces of even size, whatever their times; each piece is
scanned on its own, and what a key's pieces end with is carried across them. So a key
with a third of all rows, even in one instant, is spread over many tasks, and what one
task sees of a key is one row a piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gleanery.session import ensure_checkpoint_dir


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``df`` stored with ``_piece``: its number among ranges of (keys, order); as many as shuffle partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    count = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys, *order)
    return ranged.withColumn("_piece", F.spark_partition_id()).checkpoint()


def with_previous_value(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str],
    value: str,
    out: str,
    pieces: int | None = None,
) -> DataFrame:
    """Add the last non-null ``value`` of earlier rows of the same key."""
    cut = in_pieces(df, keys, [time, *tie], pieces)
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_piece").orderBy(time, *tie).rowsBetween(*earlier)
    near = cut.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    ends = cut.groupBy(*keys, "_piece").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(time, *tie))).alias("_end")
    )
    across = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(*earlier)
    ends = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(across)).drop("_end")
    joined = near.join(ends, [*keys, "_piece"], "left")
    return joined.withColumn(out, F.coalesce("_near", "_far")).select(*df.columns, out)

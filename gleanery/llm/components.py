"""Connected components of an edge list by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.llm.common import staged


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hooked(sides: DataFrame, kept) -> DataFrame:
    """Link what ``kept`` selects of every node's neighbours to its smallest neighbour.

    The minimum is aggregated before the shuffle and joined back, so a hub's
    edges stay spread wherever adaptive execution can split the join.
    """
    low = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (
        sides.join(low, "a")
        .where(kept)
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .where("a <> b")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: the smallest node.

    Alternates large and small stars until the edge list stops changing, which
    takes a number of rounds logarithmic in the graph's size. Only a count and a
    checksum reach the driver. Null ends and loops are dropped; repeated edges
    and an empty list are fine.
    """
    current = staged(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        mark = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum"),
        ).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        large = _hooked(_directed(current), F.col("b") > F.col("a")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            down.join(low, "a")
            .select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.low").alias("b"))
            .where("a <> b")
        )
        current = staged(small.distinct())
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

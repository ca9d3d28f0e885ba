"""Keys seen by earlier micro-batches, in hash buckets that a batch opens only where it may hit.

A table is a set of segments. Batch b writes segment (0, b); when FANOUT segments of
a level are complete they are merged into one of the next level, so a row is
rewritten once a level and a batch reads a number of segments that grows with the
logarithm of the batches. ``retire`` removes segments that a merged one replaces, so the
files of a table follow its keys and not the number of batches. Inside a segment rows lie in folders by hash bucket, next
to a Bloom filter for each bucket: a batch reads the filters of the buckets its own
keys fall into, and then the rows of those buckets only where a filter says yes.

Every segment is written by exactly one batch, from that batch and earlier ones, so
a replay writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FANOUT = 16
HASHES = 4
WORD = 64
FILTER_SCHEMA = "bucket int, word bigint, bits bigint"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a store; Spark's own API has no call for that."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def segments(before: int, fanout: int = FANOUT) -> Iterator[tuple[int, int]]:
    """(level, number) of the segments that together hold batches 0 to ``before`` - 1."""
    start, level = 0, 0
    while fanout ** (level + 1) <= before:
        level += 1
    while start < before:
        while start + fanout**level > before:
            level -= 1
        yield level, start // fanout**level
        start += fanout**level


@dataclass(frozen=True)
class KeyedLog:
    """Rows of ``schema`` with one string column ``key``.

    ``merge`` makes one row of those with one key and must not care in which order or
    grouping they come; without it the smallest row counts. ``buckets`` and ``filter_bits`` (of a bucket on the lowest level) are fixed for the
    life of the table.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    buckets: int = 256
    filter_bits: int = 1 << 13
    fanout: int = FANOUT
    merge: Callable[[DataFrame], DataFrame] | None = None

    def _path(self, kind: str, level: int, number: int) -> str:
        return f"{self.folder}/{kind}/level={level}/number={number}"

    def _read(self, kind: str, level: int, number: int, schema) -> DataFrame | None:
        try:
            rows = self.spark.read.schema(schema).parquet(self._path(kind, level, number))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None      # batches need not start at 0 or be without gaps
        return rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _bits(self, level: int) -> Column:
        """Places of a key in its bucket's filter; higher levels hold more keys and have more bits."""
        size = F.lit(self.filter_bits * self.fanout**level)
        places = [F.pmod(F.xxhash64("key", F.lit(i)), size) for i in range(HASHES)]
        return F.transform(
            F.array(*places),
            lambda p: F.struct(
                F.floor(p / WORD).alias("word"),
                F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(p, F.lit(WORD)).cast("int")).alias("mask"),
            ),
        )

    def _write_segment(self, rows: DataFrame, level: int, number: int) -> None:
        placed = rows.withColumn("bucket", self._bucket())
        path = self._path("rows", level, number)
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        stored = self.spark.read.schema(placed.schema).parquet(path)
        bits = stored.select("bucket", F.explode(self._bits(level)).alias("b")).groupBy("bucket", "b.word").agg(
            F.bit_or("b.mask").alias("bits")
        )
        bits.repartition("bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(
            self._path("filters", level, number)
        )

    def _first(self, rows: DataFrame) -> DataFrame:
        if self.merge is not None:
            return self.merge(rows).select(*self.schema.names)
        values = [c for c in self.schema.names if c != "key"]
        if not values:
            return rows.select("key").distinct()
        return rows.groupBy("key").agg(F.min(F.struct(*values)).alias("v")).select(
            *[F.col("v." + c).alias(c) if c != "key" else F.col("key") for c in self.schema.names]
        )

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch's keys; null keys are left out. Completes the segments that end with this batch."""
        own = rows.where(F.col("key").isNotNull()).select(*self.schema.names)
        self._write_segment(self._first(own), 0, batch_id)
        level = 1
        while (batch_id + 1) % self.fanout**level == 0:
            number = (batch_id + 1) // self.fanout**level - 1
            below = range(number * self.fanout, (number + 1) * self.fanout)
            parts = [self._read("rows", level - 1, n, self.schema) for n in below]
            merged = reduce(DataFrame.unionByName, [p.select(*self.schema.names) for p in parts if p is not None])
            self._write_segment(self._first(merged), level, number)
            level += 1

    def retire(self, batch_id: int) -> None:
        """Remove the segments that the batch before completed into a larger one.

        For a batch that has begun: by then the one before is committed and is not
        replayed, and this batch reads the larger segment. What is read as of earlier batches
        is no longer there. Nothing is removed unless the larger segment exists.
        """
        level = 1
        while batch_id and batch_id % self.fanout**level == 0:
            number = batch_id // self.fanout**level - 1
            if self._read("filters", level, number, FILTER_SCHEMA) is not None:
                for below in range(number * self.fanout, (number + 1) * self.fanout):
                    for kind in ("rows", "filters"):
                        remove(self.spark, self._path(kind, level - 1, below))
            level += 1

    def may_hit(self, keys: DataFrame, level: int, number: int, touched: list[int]) -> list[int]:
        """Buckets of a segment in which a key may lie; at most as many as there are buckets."""
        filters = self._read("filters", level, number, FILTER_SCHEMA)
        if filters is None:
            return []
        asked = keys.select("key", "bucket", F.explode(self._bits(level)).alias("b")).select("key", "bucket", "b.word", "b.mask")
        opened = filters.where(F.col("bucket").isin(touched))
        hit = asked.join(opened, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
        # two hashes of a key may share a place, so what is compared is the number of its rows
        full = hit.groupBy("key", "bucket").count().where(F.col("count") == HASHES)
        return sorted(r["bucket"] for r in full.select("bucket").distinct().collect())

    def opened(self, keys: DataFrame, before: int) -> list[tuple[DataFrame, list[int]]]:
        """Rows of every segment of earlier batches, cut to the buckets that may hold a key."""
        placed = keys.where(F.col("key").isNotNull()).select("key").distinct().withColumn("bucket", self._bucket())
        touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())
        out = []
        if not touched:
            return out
        stored = StructType([*self.schema.fields]).add("bucket", "integer")
        for level, number in segments(before, self.fanout):
            hits = self.may_hit(placed, level, number, touched)
            if hits:
                out.append((self._read("rows", level, number, stored).where(F.col("bucket").isin(hits)), hits))
        return out

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """Stored rows of batches before ``before`` whose key is in ``keys`` (key), one for each key.

        ``keys`` is read several times and should be stored.
        """
        asked = keys.where(F.col("key").isNotNull()).select("key").distinct()
        found = [rows.drop("bucket").join(asked, "key", "left_semi") for rows, _ in self.opened(keys, before)]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self._first(reduce(DataFrame.unionByName, found))

    def all(self, before: int) -> DataFrame:
        """One row for every key of batches before ``before``."""
        parts = [self._read("rows", *segment, self.schema) for segment in segments(before, self.fanout)]
        held = [p.select(*self.schema.names) for p in parts if p is not None]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self._first(reduce(DataFrame.unionByName, held))

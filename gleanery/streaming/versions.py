"""Version history in key buckets, of which a micro-batch rewrites only those it adds to.

A batch writes the whole new content of every bucket that one of its items falls into
below its own folder, rows that are current apart from closed ones, and then a list
that names for each bucket the batch that wrote it last. Readers open the folders the list
names and nothing else: current rows without any window, and without the closed rows'
files. Nothing that a list names is ever overwritten, unlike with dynamic partition
overwrite, where a driver lost in the middle of a commit leaves folders already removed.
A replay reads the lists of earlier batches only, and so writes the same again. ``retire``
removes the folders that the newest list no longer names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gleanery.operators.history import enrichment_history, upsert
from gleanery.streaming.keyed import remove

POINTER_SCHEMA = "batch bigint, bucket int, written bigint"
VERSION = ("item_id", "version_id")


@dataclass(frozen=True)
class VersionTable:
    """Versions of ``schema`` (item_id, version_id, created_at, ...).

    ``buckets`` is fixed for the life of the table; a batch of b items rewrites at most b
    of them. The versions of one item lie in one bucket, those of one bucket in as
    many tasks as they need.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("item_id"), F.lit(self.buckets)).cast("int")

    def _lists(self, before: int, n: int) -> list[int]:
        """The last ``n`` batches before ``before`` that wrote a list, newest first."""
        try:
            lists = self.spark.read.schema(POINTER_SCHEMA).parquet(f"{self.folder}/pointers")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        found = lists.where(F.col("batch") < before).select("batch").distinct().orderBy(F.desc("batch")).limit(n)
        return [r["batch"] for r in found.collect()]

    def _listed(self, batch: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, written bigint").parquet(f"{self.folder}/pointers/batch={batch}")
        return {r["bucket"]: r["written"] for r in rows.collect()}

    def pointers(self, before: int) -> dict[int, int]:
        """The batch that last wrote each bucket, among batches before ``before``; one entry a bucket at most."""
        newest = self._lists(before, 1)
        return self._listed(newest[0]) if newest else {}

    def _open(self, named: dict[int, int], *kinds: str) -> DataFrame:
        """Rows of the named buckets; ``kinds`` are current and closed."""
        stored = StructType([*self.schema.fields]).add("superseded_at", self.schema["created_at"].dataType)
        out = None
        for kind in kinds:
            base = f"{self.folder}/{kind}"
            paths = [f"{base}/batch={batch}/bucket={bucket}" for bucket, batch in sorted(named.items())]
            if paths:
                rows = self.spark.read.schema(stored).parquet(*paths)
            else:
                rows = self.spark.createDataFrame([], stored)
            # rows without an id only keep the folders of buckets that have no such rows
            rows = rows.where(F.col("item_id").isNotNull()).withColumn("is_current", F.lit(kind == "current"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def add(self, new: DataFrame, batch_id: int) -> None:
        """Add versions, in any order of time; a version that is there already is replaced.

        Rows without item_id or version_id are left out. ``new`` is read several times and should be stored.
        """
        own = new.where(F.col("item_id").isNotNull() & F.col("version_id").isNotNull()).select(*self.schema.names)
        touched = {r["bucket"] for r in own.select(self._bucket().alias("bucket")).distinct().collect()}
        before = self.pointers(batch_id)
        if touched:
            known = self._open({b: n for b, n in before.items() if b in touched}, "current", "closed")
            every = upsert(known.select(*self.schema.names), own, VERSION, F.desc("created_at"))
            placed = enrichment_history(every).withColumn("bucket", self._bucket())
            # once for both writes, so that the window runs once
            path = f"{self.folder}/staged/batch={batch_id}"
            placed.write.mode("overwrite").parquet(path)
            stored = self.spark.read.schema(placed.schema).parquet(path)
            # a range keeps a bucket in few files and yet splits a large one
            for kind, part in (("current", stored.where("is_current")), ("closed", stored.where("not is_current"))):
                self._write(part.drop("is_current"), kind, batch_id, touched)
            stored.limit(0).write.mode("overwrite").parquet(path)
        named = {**before, **dict.fromkeys(touched, batch_id)}
        rows = self.spark.createDataFrame(sorted(named.items()), "bucket int, written bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointers/batch={batch_id}")

    def _write(self, rows: DataFrame, kind: str, batch_id: int, touched: set[int]) -> None:
        # every touched bucket gets a folder, also without closed rows: a list then names folders that exist
        marks = self.spark.createDataFrame([(b,) for b in sorted(touched)], "bucket int")
        empty = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "bucket"], "bucket")
        full = rows.unionByName(empty)
        full.repartitionByRange("bucket", "item_id").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.folder}/{kind}/batch={batch_id}"
        )

    def retire(self, batch_id: int) -> None:
        """Remove what the batch before replaced, and the list that named it.

        For a batch that has begun, so that the one before is committed and is not replayed.
        Readers as of earlier batches no longer find their rows.
        """
        lists = self._lists(batch_id, 2)
        if len(lists) < 2:
            return
        newest, before = lists
        named = self._listed(newest)
        for bucket, batch in self._listed(before).items():
            if named.get(bucket) != batch:
                for kind in ("current", "closed"):
                    remove(self.spark, f"{self.folder}/{kind}/batch={batch}/bucket={bucket}")
        remove(self.spark, f"{self.folder}/pointers/batch={before}")

    def current(self, before: int) -> DataFrame:
        """The newest version of every item after the batches before ``before``; reads no closed row."""
        return self._open(self.pointers(before), "current")

    def history(self, before: int) -> DataFrame:
        """All versions with superseded_at and is_current."""
        return self._open(self.pointers(before), "current", "closed")

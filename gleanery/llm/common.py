"""Helpers the operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.session import ensure_checkpoint_dir


BATCH_ROWS = 1000     # rows a Python worker gets at once; texts can be long
ROW_GROUP_BYTES = 1 << 24      # of a Parquet row group; what a task holds of a file it writes or reads


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows, so workers stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bounded_row_groups(spark: SparkSession) -> None:
    """Let Parquet row groups hold about ``ROW_GROUP_BYTES`` at most, which also lets several tasks read a file."""
    key = "parquet.block.size"
    if int(spark.conf.get(key, str(1 << 27))) > ROW_GROUP_BYTES:
        spark.conf.set(key, str(ROW_GROUP_BYTES))


def release() -> None:
    """Give memory that a task has freed back to the system; workers live on after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage at a copy in the folder all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def hex64(value) -> F.Column:
    """Sixteen lower-case hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """``needed`` columns, and all others inside one struct ``_rest``.

    Columns an operator adds can then not clash with columns it only passes on.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in needed]
    return df.select(*needed, F.struct(*rest or [F.lit(None).cast("int").alias("_none")]).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The ``columns`` that went into ``packed``, in their order."""
    return df.select(*[F.col(c) if c in needed else F.col(f"_rest.`{c}`").alias(c) for c in columns])

"""Keep an expensive expression from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps may use and filter on freely.

    The optimizer copies the expression of a plain projected column into every
    filter pushed below it and every nested field read from it. A one-element
    generator is a boundary it does not copy across, so parsing or scanning a
    whole text happens once per row.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [name for name in df.columns if name not in columns]
    staged = df.select(*df.columns, F.explode_outer(F.array(packed)).alias("_once"))
    return staged.select(*kept, *[F.col(f"_once.{name}").alias(name) for name in columns])

"""Typed reading and writing of the curation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gleanery import schemas
from gleanery.fixed_values import ENUMS


def read_table(
    spark: SparkSession, name: str, location: str, *, format: str = "parquet", **options: str
) -> DataFrame:
    """Read a curation table with its declared schema.

    File formats are read with the schema, so no inference pass runs. For JDBC
    the location is the connection URL and columns are cast on arrival.
    """
    schema = schemas.TABLES[name]
    if format == "jdbc":
        reader = spark.read.format("jdbc").option("url", location)
        loaded = reader.options(**({"dbtable": name} | options)).load()
        fields = StructType.fromDDL(schema)
        return loaded.select(*[F.col(field.name).cast(field.dataType) for field in fields])
    return spark.read.format(format).schema(schema).options(**options).load(location)


def stream_table(
    spark: SparkSession, name: str, location: str, *, format: str = "parquet", **options: str
) -> DataFrame:
    """The same table as an unbounded stream of new files."""
    return spark.readStream.format(format).schema(schemas.TABLES[name]).options(**options).load(location)


def write_table(
    df: DataFrame, location: str, *, format: str = "parquet", mode: str = "overwrite", partition_by=(), **options: str
) -> None:
    df.write.format(format).mode(mode).partitionBy(*partition_by).options(**options).save(location)


def invalid_enums(df: DataFrame, name: str) -> DataFrame:
    """Rows whose closed-set columns hold another value."""
    bad = F.lit(False)
    for column, enum in schemas.ENUM_COLUMNS.get(name, {}).items():
        bad = bad | (F.col(column).isNotNull() & ~F.col(column).isin(*ENUMS[enum]))
    return df.where(bad)

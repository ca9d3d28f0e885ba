"""Queries of the subpackage equal their SQL counterparts."""

import pytest

import __spark_entry__ as entry
from gleanery.llm import blocks, queries, substrings
from gleanery.llm.common import table
from tests.compare import differences, rows, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, connection, name):
    missing, extra, _, problem = differences(spark, connection, name, SF)
    assert problem is None and not missing and not extra


@pytest.mark.parametrize("module", [blocks, substrings])
def test_many_chunks_and_buckets_equal_sql(spark, connection, module):
    found = module.report(table(spark, SF, "documents"), chunk_bytes=20_000, bucket_bytes=30_000)
    result = connection.execute(module.SQL)
    names = [c[0] for c in result.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, result.fetchall())


def test_every_operator_is_registered():
    numbers = {name.split("_")[0] for name in entry.queries() if name.startswith("op")}
    assert numbers == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()

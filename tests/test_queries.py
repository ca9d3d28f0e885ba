"""Registered queries equal their SQL counterparts; plans keep their shape."""

import re

import pytest

import __spark_entry__ as entry
from gleanery.operators import selection, skew
from gleanery.plans import catalog, fixtures, oracle
from tests.compare import differences, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, connection, name):
    missing, extra, _, problem = differences(spark, connection, name, SF)
    assert problem is None and not missing and not extra


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan(spark, name):
    frame = entry.queries()[name](spark, SF)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_and_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|NestedLoop|Cartesian", text)


def test_candidates_are_limited_before_the_shuffle(spark):
    best = selection.rank_candidates(fixtures.items(spark, SF), fixtures.enrichments(spark, SF))
    text = best._jdf.queryExecution().executedPlan().toString()
    limit, shuffle = text.rindex("WindowGroupLimit"), text.index("Exchange hashpartitioning(audience")
    assert "Partial" in text[limit:limit + 300] and limit > shuffle
    assert "text" not in "".join(re.findall(r"ReadSchema: struct<[^>]*>", text))


def test_large_tables_are_narrowed_by_a_checked_broadcast(spark):
    ids = spark.range(10).withColumnRenamed("id", "item_id")
    wide = spark.range(1000).selectExpr("id as item_id", "repeat('x', 10) as body")
    small = skew.Narrow(ids).rows(wide, "item_id")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString() and small.count() == 10
    assert not skew.Narrow(ids, limit=5).small and skew.Narrow(ids, limit=5).rows(wide, "item_id").count() == 10


@pytest.mark.parametrize(
    ("name", "columns"),
    [("source_table", "event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string"),
     ("sync_cursor", "doc_id:bigint"), ("topic_titles", "doc_id:bigint")],
)
def test_scans_read_only_needed_columns(spark, name, columns):
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)))
    assert read and all(set(r.split(",")) <= set(columns.split(",")) for r in read)


def test_labels_after_a_quoted_title_equal_sql(spark, tmp_path):
    """A title cut right after a quote, before a label: the quote becomes a space, which is trimmed."""
    made = tables(SF)
    for name in ("documents", "labels"):
        columns = "* replace (case doc_id % 23 when 21 then repeat('a \"b\" ', 9) || 'wordy\" more' else text end as text)"
        made.execute(f"copy (select {columns if name == 'documents' else '*'} from {name}) to '{tmp_path}/{name}.parquet'")
    missing, extra, count, problem = differences(spark, tables(str(tmp_path)), "enrichment_validate", str(tmp_path))
    assert problem is None and count and not missing and not extra

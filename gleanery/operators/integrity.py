"""Uniqueness and reference checks as report rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str], check: str, where: str | None = None) -> DataFrame:
    """Keys that occur more than once; a key with a null part is never a duplicate.

    The key text joins the parts with a bar, and a bar or backslash inside a part is
    escaped, so different keys have different texts.
    """
    rows = df.where(where) if where else df
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    counted = rows.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")
    parts = [F.regexp_replace(F.col(key).cast("string"), r"[\\|]", r"\\$0") for key in keys]
    return counted.select(
        F.lit(check).alias("check_name"),
        (F.concat_ws("|", *parts) if len(keys) > 1 else F.col(keys[0]).cast("string")).alias("key_text"),
        "row_count",
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str) -> DataFrame:
    """Child keys without a parent; child rows are counted before the join."""
    counted = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("row_count"))
    known = parent.select(F.col(parent_key).alias(key))
    return counted.join(known, key, "left_anti").select(
        F.lit(check).alias("check_name"), F.col(key).cast("string").alias("key_text"), "row_count"
    )


def report(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


UNIQUE = (
    ("sources", ["source_type", "source_ref"], None),
    ("sync_state", ["source_id"], None),
    ("items", ["raw_asset_id"], None),
    ("items", ["canonical_url"], "canonical_url is not null"),
    ("enrichments", ["item_id"], "is_current"),
    ("item_groups", ["group_type", "tag"], None),
    ("item_group_members", ["group_id", "item_id"], None),
    ("inbox_selections", ["item_id"], "is_current"),
    ("notes", ["item_id"], None),
    ("destinations", ["destination_type", "target_ref"], None),
)
REFERENCES = (
    ("sync_state", "source_id", "sources", "source_id"),
    ("capture_entries", "source_id", "sources", "source_id"),
    ("raw_assets", "capture_entry_id", "capture_entries", "capture_entry_id"),
    ("items", "raw_asset_id", "raw_assets", "raw_asset_id"),
    ("enrichments", "item_id", "items", "item_id"),
    ("item_group_members", "group_id", "item_groups", "group_id"),
    ("item_group_members", "item_id", "items", "item_id"),
    ("inbox_selections", "item_id", "items", "item_id"),
    ("notes", "item_id", "items", "item_id"),
)


def _unique_name(name: str, keys: Sequence[str]) -> str:
    return f"unique {name}({','.join(keys)})"


def curation_report(tables: dict[str, DataFrame]) -> DataFrame:
    """All declared constraints of the curation tables that are given."""
    found = [
        duplicate_keys(tables[name], keys, _unique_name(name, keys), where)
        for name, keys, where in UNIQUE
        if name in tables
    ]
    found += [
        orphans(tables[child], key, tables[parent], parent_key, f"reference {child}.{key}")
        for child, key, parent, parent_key in REFERENCES
        if child in tables and parent in tables
    ]
    return report(*found)


def curation_report_delta(
    earlier: dict[str, DataFrame], added: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Violations after a change, given tables before it that had none.

    ``removed`` holds whole rows of ``earlier`` that go, ``added`` rows that come. Only keys
    of added rows are counted again, only added children look for their parents
    among all, and only children of removed parents are looked for among the old.
    Rows of a changed table are told apart by all constraint columns.
    """
    removed = removed or {}

    def after(name: str, columns: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
        """Rows of ``columns`` after the change, narrowed to ``keys`` where given."""
        parts = [t[name].select(*columns) for t in (earlier, added) if name in t]
        rows = reduce(DataFrame.unionByName, parts)
        if keys is not None:
            rows = rows.join(keys, keys.columns, "left_semi")
        if name not in removed:
            return rows
        gone = removed[name].select(*columns)
        if keys is not None:
            gone = gone.join(keys, keys.columns, "left_semi")
        return rows.exceptAll(gone)

    found = []
    for name, keys, where in UNIQUE:
        if name in added:
            new = added[name].where(where) if where else added[name]
            columns = [*keys, *(["is_current"] if where == "is_current" else [])]
            found.append(duplicate_keys(after(name, columns, new.select(*keys).distinct()), keys, _unique_name(name, keys), where))
    for child, key, parent, parent_key in REFERENCES:
        check = f"reference {child}.{key}"
        known = [t[parent] for t in (earlier, added) if parent in t]
        if child in added and known:
            wanted = added[child].select(F.col(key).alias(parent_key)).distinct()
            lost = orphans(added[child], key, after(parent, [parent_key], wanted), parent_key, check)
            # a key without a parent is reported with all its children
            keys = lost.select(F.col("key_text").alias("_key")).distinct()
            rows = after(child, [key]).join(keys, F.col(key).cast("string") == F.col("_key"), "left_semi")
            found.append(_counted(rows, key, check))
        if child in earlier and parent in removed:
            gone = removed[parent].select(parent_key).distinct()
            left = after(parent, [parent_key], gone).select(parent_key).distinct()
            missing = gone.join(left, parent_key, "left_anti").select(F.col(parent_key).alias(key))
            found.append(_counted(after(child, [key], missing), key, check))
    return report(*found).distinct()


def _counted(rows: DataFrame, key: str, check: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("row_count")).select(
        F.lit(check).alias("check_name"), F.col(key).cast("string").alias("key_text"), "row_count"
    )

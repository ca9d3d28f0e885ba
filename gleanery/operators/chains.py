"""Ordered greedy choice among rows that block each other, settled in logarithmic rounds.

A row is kept when no earlier kept row shares one of its two keys. Rows that have
exactly one earlier open neighbour form chains: each points to the row that may
block it, and the parity of its distance to a row that is surely kept decides.
Pointers double, so a chain of n rows takes about log n joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.operators.skew import first_n_per_key, lookup

KEYS = ("ext_key", "url_key")
JUMPS = 2      # pointer jumps between checkpoints


def _heads(rows: DataFrame, key: str) -> DataFrame:
    """First and second open row of every key, and its rows; both limits apply before the shuffle."""
    held = rows.where(F.col(key).isNotNull()).select(key, "pos", "row_id")
    ranked = first_n_per_key(held, [key], 2, "_place", F.col("pos"))
    heads = ranked.groupBy(key).agg(
        *[F.max(F.when(F.col("_place") == n, F.col("row_id"))).alias(f"{key}_{n}") for n in (1, 2)]
    )
    return heads.join(held.groupBy(key).agg(F.count("*").alias("n")), key)


def _links(rows: DataFrame, heads: dict[str, DataFrame]) -> DataFrame:
    """Every open row with ``ptr``, its only earlier neighbour, and ``role``: root, link or barrier."""
    seen = rows
    for key in KEYS:
        seen = lookup(seen, heads[key], key, [f"{key}_1", f"{key}_2"], weight="n", spread=["row_id"])

    def first(key: str) -> Column:
        return F.col(key).isNull() | (F.col(f"{key}_1") == F.col("row_id"))

    def second(key: str) -> Column:
        return F.coalesce(F.col(f"{key}_2") == F.col("row_id"), F.lit(False))

    ext, url = KEYS
    ptr = F.when(second(ext) & first(url), F.col(f"{ext}_1")).when(second(url) & first(ext), F.col(f"{url}_1"))
    role = F.when(first(ext) & first(url), "root").when(ptr.isNotNull(), "link").otherwise("barrier")
    return seen.select(*rows.columns, ptr.alias("ptr"), role.alias("role"))


def _jumped(active: DataFrame, every: DataFrame) -> DataFrame:
    """Active links moved to where their target points, with the parity of the way."""
    ahead = every.select(
        F.col("row_id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("odd").alias("_odd"), F.col("end").alias("_end")
    )
    return active.join(ahead, "ptr").select(
        "row_id", F.col("_ptr").alias("ptr"), (F.col("odd") != F.col("_odd")).alias("odd"), F.col("_end").alias("end")
    )


def _parities(roles: DataFrame) -> DataFrame:
    """(row_id, odd, end) of every link: ``end`` is the role its chain leads to, ``odd`` its distance there.

    Links whose end is known stay where they are, so a root is joined by its
    neighbours only, however long its chain.
    """
    targets = roles.where("role <> 'link'").select(F.col("row_id").alias("ptr"), F.col("role").alias("end"))
    links = (
        roles.where("role = 'link'").select("row_id", "ptr").join(targets, "ptr", "left")
        .select("row_id", "ptr", F.lit(True).alias("odd"), "end").checkpoint()
    )
    while not links.where("end is null").isEmpty():
        for _ in range(JUMPS):
            moved = _jumped(links.where("end is null"), links)
            links = links.where("end is not null").unionByName(moved)
        links = links.checkpoint()
    return links.drop("ptr")


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row ids certainly kept, rows still open): scope, row_id, pos, ext_key, url_key.

    Roots, which are first at each of their keys, and links at an even distance
    from a root are kept. Everything else that shares a key with a kept row is
    dropped. What stays open shares no key with a kept row, so it is a smaller
    problem of the same kind; at least the first open row of every scope is
    settled.
    """
    rows = rows.select("scope", "row_id", "pos", *KEYS).checkpoint()
    heads = {key: _heads(rows, key) for key in KEYS}
    roles = _links(rows, heads).checkpoint()
    ends = _parities(roles).where("end = 'root' and not odd").select("row_id")
    keepers = roles.where("role = 'root'").unionByName(roles.join(ends, "row_id", "left_semi").select(*roles.columns))
    seen = rows
    for key in KEYS:
        taken = keepers.where(F.col(key).isNotNull()).select(key, F.col("row_id").alias(f"{key}_by"))
        sized = taken.join(heads[key].select(key, "n"), key)
        seen = lookup(seen, sized, key, [f"{key}_by"], weight="n", spread=["row_id"])
    by = [F.col(f"{key}_by") for key in KEYS]
    kept = reduce(Column.__or__, [F.coalesce(b == F.col("row_id"), F.lit(False)) for b in by])
    open_ = reduce(Column.__and__, [b.isNull() for b in by])
    state = F.when(kept, "kept").when(open_, "open").otherwise("dropped")
    left = seen.select(*rows.columns, state.alias("state")).where("state <> 'dropped'").checkpoint()
    return left.where("state = 'kept'").select("row_id"), left.where("state = 'open'").drop("state")
